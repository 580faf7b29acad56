"""Raw lines to log entries and rejects, in one pass over the input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions import rfc3164, rfc5424
from logstrata.functions import structured_data as sd
from logstrata.functions.text import trim_line
from logstrata.functions.time import ntz
from logstrata.schema import ENTRY

FORMATS = ("auto", "rfc5424", "rfc3164")

#: Columns ``parse`` puts in the place of ``line``.
RESULT = ("log", "line", "format", "reason")

#: A bound for ``max_bytes``: lines of this size and more are rejected unparsed.
MAX_LINE_BYTES = 1024 * 1024


def log_format(fmt: str) -> str:
    """The format setting, case-insensitive; an unknown one means auto."""
    fmt = fmt.strip().lower()
    return fmt if fmt in FORMATS else "auto"


def _with_json(df: DataFrame) -> DataFrame:
    """Add ``_json``, the stored form of ``_data``, and ``_twice``.

    Most structured data is plain text, which a few string functions turn into
    JSON. Text with escapes or repeated names takes the general way.
    """
    data, pieces, elements = F.col("_data"), F.col("_pieces"), F.col("_elements")
    present = rfc5424.has_data(data)
    df = df.withColumn("_pieces", F.when(present, sd.pieces(data)))
    df = df.withColumn("_plain", F.when(pieces.isNotNull(), sd.pieces_to_json(pieces)))
    general = present & F.col("_plain").isNull()
    df = df.withColumn("_elements", F.when(general, sd.split_elements(data)))
    return df.withColumns(
        {
            "_twice": F.when(elements.isNotNull(), sd.has_duplicate_ids(elements))
            .when(pieces.isNotNull(), sd.pieces_repeat_ids(pieces))
            .otherwise(F.lit(False)),
            "_json": F.when(
                elements.isNotNull() & ~sd.has_duplicate_ids(elements),
                sd.to_json_text(elements),
            ).otherwise(F.col("_plain")),
        }
    )


def parse(
    lines: DataFrame,
    now: dt.datetime | Column,
    fmt: str = "auto",
    tz: str = "UTC",
    max_bytes: int | None = None,
) -> DataFrame:
    """Replace the column ``line`` by ``log``, ``line``, ``format``, ``reason``.

    Of ``log`` (an entry struct) and ``reason`` exactly one is set, and none
    for a blank line. ``line`` and ``format`` are kept for rejects and NULL for
    entries. Other input columns stay. To get at one kind of rows, use
    ``entries`` or ``rejects`` rather than a filter.

    ``now`` stands in for a missing time and gives the year of an RFC 3164
    line; on a stream, pass ``current_timestamp()`` computed before the sink,
    which is the same again when a batch is retried.
    """
    fmt = log_format(fmt)
    now = ntz(now)
    col = F.col
    rest = [c for c in lines.columns if c != "line"]

    size_ok = F.lit(True)
    if max_bytes is not None:
        size_ok = F.octet_length("line") < max_bytes
    text = F.coalesce(trim_line(col("line")), F.lit(""))
    df = lines.select(*rest, text.alias("line"), size_ok.alias("_ok"))

    # Both formats are split first and checked afterwards. That keeps each
    # generated method below the 8,000 bytes of code up to which Java compiles.
    not5 = F.lit(True)
    if fmt != "rfc3164":
        df = df.withColumn(
            "_parts5", F.when(col("_ok"), rfc5424.split_header(col("line")))
        )
        not5 = ~rfc5424.matched(col("_parts5"))
        df = df.withColumn("_data", F.when(~not5, rfc5424.data_text(col("_parts5"))))
    if fmt != "rfc5424":
        # A line with an RFC 5424 header has a digit where RFC 3164 wants a
        # month, so only lines without one are tried.
        parts = F.when(col("_ok") & not5, rfc3164.split_line(col("line")))
        df = df.withColumn("_parts3", parts)
        df = df.withColumn("_time3", rfc3164.split_time(col("_parts3")))

    if fmt == "rfc3164":
        df = df.withColumn("_fault5", F.lit("format"))
    else:
        df = _with_json(df)
        df = df.withColumn("_stamp5", rfc5424.timestamp(col("_parts5")))
        df = df.withColumn(
            "_fault5",
            rfc5424.fault(col("_parts5"), col("_data"), col("_twice"), col("_stamp5")),
        )
    if fmt == "rfc5424":
        df = df.withColumn("_fault3", F.lit("format"))
    else:
        df = df.withColumn("_stamp3", rfc3164.timestamp(col("_time3"), now, tz))
        df = df.withColumn("_fault3", rfc3164.fault(col("_parts3"), col("_stamp3")))

    # The last parser tried gives the reason.
    last = col("_fault5") if fmt == "rfc5424" else col("_fault3")
    reason = (
        F.when(col("line") == "", F.lit(None))
        .when(~col("_ok"), F.lit("too long"))
        .when(col("_fault5").isNull() | col("_fault3").isNull(), F.lit(None))
        .otherwise(last)
    )
    log = F.lit(None).cast(ENTRY.simpleString())
    if fmt != "rfc5424":
        taken = F.when(
            col("_ok") & col("_fault3").isNull(),
            rfc3164.entry(col("_parts3"), col("_stamp3")),
        )
        log = taken.cast(ENTRY.simpleString())
    if fmt != "rfc3164":
        entry = rfc5424.entry(
            col("_parts5"), col("_data"), col("_json"), col("_stamp5"), now
        )
        log = F.when(col("_ok") & col("_fault5").isNull(), entry).otherwise(log)
    reject = reason.isNotNull()
    return df.select(
        *rest,
        log.alias("log"),
        F.when(reject, col("line")).alias("line"),
        F.when(reject, F.lit(fmt)).alias("format"),
        reason.alias("reason"),
    )


# Both functions below unpack an array of one struct or none instead of
# filtering. A filter on a parse result is pushed below the parse, which
# repeats all of it in the condition and takes minutes to plan; a generator is
# not pushed.


def entries(parsed: DataFrame) -> DataFrame:
    """The accepted lines of ``parse`` as flat entry columns."""
    rest = [c for c in parsed.columns if c not in RESULT]
    taken = F.when(F.col("log").isNotNull(), F.array("log"))
    return parsed.select(*rest, F.inline(taken))


def rejects(parsed: DataFrame) -> DataFrame:
    """The lines of ``parse`` that no parser took."""
    rest = [c for c in parsed.columns if c not in RESULT]
    reject = F.array(F.struct("line", "format", "reason"))
    return parsed.select(*rest, F.inline(F.when(F.col("reason").isNotNull(), reject)))

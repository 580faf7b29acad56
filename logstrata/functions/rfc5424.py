"""RFC 5424 lines to columns.

No header field can hold white space, so a line is split at its first six
blanks, and the last piece keeps structured data and message whole. Whether the
pieces are a header is told by one pattern without groups that ends where the
header does: the message is never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logstrata.functions import structured_data as sd
from logstrata.functions.priority import facility_of, severity_of

_PRI = r"(?:1(?:[0-8]\d|9[01])|[1-9]\d?|0)"
_CLOCK = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?"
_STAMP = rf"\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)"

HEADER = (
    rf"^<{_PRI}>[1-9]\d{{0,2}} (?:-|{_STAMP})"
    r" [!-~]{1,255}+ [!-~]{1,48}+ [!-~]{1,128}+ [!-~]{1,32}+ (?s:.)"
)
_FIELDS = ("head", "stamp", "host", "app", "proc", "msgid", "rest")

#: Structured data at the start of the rest of a line, up to its end.
_LEADING_DATA = rf"(?s)^({sd.DATA})(?: .*+)?$"


def split_header(line: Column) -> Column:
    """Array of the header fields and the rest; NULL without a header."""
    return F.when(F.rlike(line, F.lit(HEADER)), F.split(line, " ", len(_FIELDS)))


def matched(parts: Column) -> Column:
    """True if ``split_header`` found a header."""
    return parts.isNotNull()


def field(parts: Column, name: str) -> Column:
    """One header field as text."""
    return F.get(parts, _FIELDS.index(name))


def _offset_minutes(offset: Column) -> Column:
    hours = F.substring(offset, 2, 2).try_cast("int")
    minutes = F.substring(offset, 5, 2).try_cast("int")
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    return sign * (hours * 60 + minutes)


def timestamp(parts: Column) -> Column:
    """UTC time of the line; NULL if it has none or names a day that does not exist."""
    stamp = field(parts, "stamp")
    in_utc = F.endswith(stamp, F.lit("Z"))
    cut = F.length(stamp) - F.when(in_utc, 1).otherwise(6)
    local = F.substring(stamp, F.lit(1), cut).try_cast("timestamp_ntz")
    minutes = _offset_minutes(F.substring(stamp, -6, 6))
    shifted = local - F.make_dt_interval(mins=minutes)
    return F.when(in_utc | (minutes == 0), local).otherwise(shifted)


def data_text(parts: Column) -> Column:
    """Structured data of the line: a dash, the elements, or '' if malformed."""
    rest = field(parts, "rest")
    nil = (rest == "-") | F.startswith(rest, F.lit("- "))
    return (
        F.when(nil, F.lit("-"))
        .when(
            F.startswith(rest, F.lit("[")), F.regexp_extract(rest, _LEADING_DATA, 1)
        )
        .otherwise(F.lit(""))
    )


def message(parts: Column, data: Column) -> Column:
    """Message text after the structured data; '' if there is none."""
    rest = field(parts, "rest")
    return F.substring(rest, F.length(data) + 2, F.length(rest))


def has_data(data: Column) -> Column:
    """True if there are elements."""
    return F.coalesce(F.startswith(data, F.lit("[")), F.lit(False))


def fault(parts: Column, data: Column, twice: Column, stamp: Column) -> Column:
    """Why the line is no RFC 5424 line; NULL if it is one.

    ``twice`` tells if an element id occurs twice.
    """
    has_stamp = field(parts, "stamp") != "-"
    return (
        F.when(~matched(parts), F.lit("format"))
        .when(has_stamp & stamp.isNull(), F.lit("timestamp"))
        .when(data == "", F.lit("structured data"))
        .when(twice, F.lit("structured data"))
    )


def entry(
    parts: Column, data: Column, json: Column, stamp: Column, now: Column
) -> Column:
    """The log entry of a faultless line."""
    head = field(parts, "head")
    pri = F.substring_index(F.substring(head, 2, 3), ">", 1).try_cast("int")
    return F.struct(
        severity_of(pri).alias("severity"),
        facility_of(pri).alias("facility"),
        F.substring_index(head, ">", -1).try_cast("int").alias("version"),
        F.coalesce(stamp, now).alias("timestamp"),
        field(parts, "host").alias("hostname"),
        field(parts, "app").alias("app_name"),
        field(parts, "proc").alias("procid"),
        field(parts, "msgid").alias("msgid"),
        F.coalesce(json, F.lit("-")).alias("structured_data"),
        message(parts, data).alias("msg"),
    )

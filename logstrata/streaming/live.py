"""Live tail: what is newer than the newest row seen."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logstrata.functions.time import from_ms, ntz, to_ms
from logstrata.operators import paging
from logstrata.sources import files

# Fixed value: pause between two polls.
POLL = "4 seconds"

_MS = dt.timedelta(milliseconds=1)
#: Latest batches whose state is kept.
_STATES = 3
_STATE = "cursor timestamp_ntz"


def _shown(page: DataFrame, target: str, cursor: dt.datetime) -> dt.datetime:
    """Write a page and give the cursor behind it, which the writing job observes."""
    seen = Observation()
    newest = F.max("timestamp").alias("newest")
    page.observe(seen, newest).write.mode("overwrite").parquet(target)
    value = seen.get["newest"]
    return cursor if value is None else from_ms(to_ms(value))


def poll(
    logs: DataFrame,
    cursor: dt.datetime,
    size: int = paging.DEFAULT_SIZE,
    filters: Mapping[str, Any] | None = None,
    target: str | None = None,
) -> tuple[DataFrame, dt.datetime]:
    """Rows newer than the cursor, newest first, and the cursor to go on with.

    If there are none, the cursor stays. With more than ``size`` new rows the
    newest are taken and the others are not shown later either. A cursor has
    whole milliseconds, so its own row comes again if it has a fraction.

    The table is read once, by the job that writes the page to the folder
    ``target`` (by default a new one) and observes its newest time; what is
    returned reads that page back and stays as it is when more rows arrive.
    """
    page = paging.page(logs, size, filters, cursor, "prev")
    spark, target = page.sparkSession, target or files.scratch(logs.sparkSession) + "/page"
    after = _shown(page, target, cursor)
    rows = spark.read.schema(page.schema).parquet(target)
    return rows.orderBy(*paging.ordering()), after


def _cursor_before(spark: SparkSession, root: str, batch: int) -> dt.datetime | None:
    """Cursor of the latest batch before this one that wrote its state."""
    numbers = [
        int(path.rsplit("=", 1)[1])
        for path in files.matching(spark, f"{root}/state/batch=*")
    ]
    earlier = sorted(number for number in numbers if number < batch)
    if not earlier:
        return None
    for number in earlier[:-_STATES]:  # no retry goes back further
        files.delete(spark, f"{root}/state/batch={number}")
    path = f"{root}/state/batch={max(earlier)}"
    return spark.read.schema(_STATE).parquet(path).first()["cursor"]


def start_tail(
    logs: DataFrame,
    root: str,
    checkpoint: str,
    start: dt.datetime,
    size: int = paging.DEFAULT_SIZE,
    filters: Mapping[str, Any] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Follow a stream of log rows and write each poll below ``root/rows``.

    Each batch is polled as if it were the table; older rows cannot be newer
    than the cursor, apart from the cursor's own millisecond, which is not
    shown again. The cursor is kept below ``root/state``, one folder per
    batch, so that a retried batch starts from the same cursor.
    """

    def show(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cursor = _cursor_before(spark, root, number) or start
        rows = paging.page(batch, size, filters, cursor, "prev")
        seen = _shown(rows, f"{root}/rows/batch={number}", cursor)
        state = spark.createDataFrame([(seen,)], _STATE)
        state.coalesce(1).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    writer = logs.writeStream.foreachBatch(show)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=POLL)
    return writer.start()


def flag_past(rows: DataFrame, start: dt.datetime) -> DataFrame:
    """Mark rows not newer than the start of live mode, by milliseconds."""
    return rows.withColumn("is_past", F.col("timestamp") < ntz(from_ms(to_ms(start)) + _MS))


def anchor(rows: DataFrame, start: dt.datetime) -> DataFrame:
    """The first row in page order that is not newer than the live start."""
    past = flag_past(rows, start).filter(F.col("is_past")).drop("is_past")
    return past.orderBy(*paging.ordering()).limit(1)

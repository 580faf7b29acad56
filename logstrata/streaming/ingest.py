"""Continuous ingest of a stream of lines into the stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from logstrata.functions.time import utc_now
from logstrata.sources import table

# Flush period, retention period and age.
FLUSH = "5 seconds"
RETENTION_MINUTES = 30 * 24 * 60
RETENTION_EVERY = dt.timedelta(minutes=30)

#: Batches between two upkeeps of the tables.
UPKEEP_BATCHES = 8


class WhileIdle(StreamingQueryListener):
    """Does something whenever a query has waited for input, until the query ends."""

    def __init__(self, spark: SparkSession, name: str, action: Callable[[SparkSession], None]):
        self.spark, self.name, self.action, self.query = spark, name, action, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query = event.id

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        if event.id == self.query:
            self.action(self.spark)

    def onQueryTerminated(self, event) -> None:
        if event.id == self.query:
            self.query = None
            self.spark.streams.removeListener(self)


def start_ingest(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    fmt: str = "auto",
    tz: str = "UTC",
    *,
    now: dt.datetime | None = None,
    max_bytes: int | None = None,
    retention_minutes: int | None = None,
    retention_every: dt.timedelta = RETENTION_EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Append a stream of lines to the tables below ``root``.

    A batch is what arrived within the flush period, or less if the source
    bounds it (``maxOffsetsPerTrigger``, ``maxBytesPerTrigger``). The batch
    number names the folders of a batch, so one that is retried after a crash
    replaces itself; the checkpoint alone knows which batches are done, and a
    table has one checkpoint. ``now`` fixes the receive time; by default it is
    the time recorded for the batch. Every few batches the files that batches
    left are merged by day.

    With ``retention_minutes``, expired rows are deleted at the start, between
    two batches and while the stream waits for input, when ``retention_every``
    has passed since the last retention, which the table keeps: jobs that are
    restarted or run once often share it. The ingest query is the only writer.
    """
    spark = lines.sparkSession
    received = utc_now() if now is None else F.lit(now.isoformat(" ")).cast("timestamp_ntz")
    stamped = lines.withColumn("received_at", received)

    def retain(session: SparkSession) -> None:
        clock = dt.datetime.now(dt.timezone.utc) if now is None else now
        if retention_minutes is not None and table.retention_due(
            session, root, clock, retention_minutes, retention_every
        ):
            table.retain(session, root, clock, retention_minutes)

    def append(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # The batches before this one are done, by the checkpoint.
        if number % UPKEEP_BATCHES == 0:
            table.upkeep(session, root)
        retain(session)
        table.write_batch(
            batch, root, number, F.col("received_at"), fmt, tz, max_bytes=max_bytes
        )

    retain(spark)
    name = f"ingest {root}"
    writer = stamped.writeStream.foreachBatch(append).queryName(name)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    if retention_minutes is not None:
        spark.streams.addListener(WhileIdle(spark, name, retain))
    return writer.trigger(processingTime=FLUSH).start()

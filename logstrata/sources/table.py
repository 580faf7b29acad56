"""The stored tables: logs and rejects by day, and the hourly rollup by day.

Layout below the table root::

    outcome=logs/dt=2024-01-20/span=7-7-0/     log rows of batch 7
    outcome=rejects/dt=2024-01-20/span=7-7-0/  lines no parser took
    rollup/dt=2024-01-20/span=7-7-0/           hourly counts of batch 7
    outcome=logs/dt=2024-01-20/span=0-31-1/    batches 0 to 31, merged
    _retained/<microseconds>_<batch>           what retention has deleted

A batch overwrites its own folders, so that a retry replaces what a first try
left; which batches are done is known to the checkpoint of the stream alone. A
folder's name says which batches it holds. A merged folder is used once Spark
has marked it as written, and stands for the folders within its span from then
on, which are removed by a later upkeep: at any time each row is read once.
Retention notes a cutoff that readers apply, and removes folders later, too.
There is one writer; readers need no lock, and retention may run beside both.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.time import bucket_start, floor_hour, ntz, utc
from logstrata.operators.parse import parse
from logstrata.schema import ENTRY_COLUMNS, REJECTS, ROLLUP, STORED
from logstrata.sources import files

LOGS_PART, REJECTS_PART, ROLLUP_PART = "outcome=logs", "outcome=rejects", "rollup"

#: Compressed bytes a merged file should have.
FILE_BYTES = 256 * 1024 * 1024
#: Folders of a day and a level that upkeep merges into one of the next level.
FAN = 32
#: Folders of a day that the rollup may have beside its merged one.
TAIL = 8
#: Columns whose values a row group can tell it lacks, and how many values it is laid out for.
BLOOM_COLUMNS, BLOOM_VALUES = ("hostname", "app_name", "procid", "msgid"), 50_000

_EPOCH = dt.datetime(1970, 1, 1)
_TICK = dt.timedelta(microseconds=1)


# --- Folders -------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Folder:
    """Rows of one day that the batches ``first`` to ``last`` wrote."""

    path: str
    day: dt.date
    first: int
    last: int
    level: int


def _day(text: str) -> dt.date:
    """Day of a partition folder; the nearest Python date beyond years 1-9999."""
    if text.startswith(("-", "0000")):
        return dt.date.min
    return dt.date.max if text.startswith("+") else dt.date.fromisoformat(text)


def _folder(path: str) -> Folder:
    day, span = (part.split("=", 1)[1] for part in path.rsplit("/", 2)[1:])
    return Folder(path, _day(day), *map(int, span.split("-")))


def _listed(spark: SparkSession, root: str, part: str) -> tuple[list[Folder], list[str]]:
    """The folders in use of a part, and the paths of those that are not.

    Not in use are merges that did not end and what a larger span stands for.
    """
    paths = files.matching(spark, f"{root}/{part}/dt=*/span=*")
    whole = {p.rsplit("/", 1)[0] for p in files.matching(spark, f"{root}/{part}/dt=*/span=*/_SUCCESS")}
    found = [f for f in map(_folder, paths) if f.level == 0 or f.path in whole]
    found.sort(key=lambda f: (f.path.rsplit("/", 1)[0], f.first, -f.last, -f.level))
    used, parent, reached = [], None, -1
    for folder in found:
        if folder.path.rsplit("/", 1)[0] != parent:
            parent, reached = folder.path.rsplit("/", 1)[0], -1
        if folder.last > reached:
            used.append(folder)
            reached = folder.last
    return used, sorted(set(paths) - {f.path for f in used})


def _read(
    spark: SparkSession, root: str, part: str, schema: str, folders: list[Folder]
) -> DataFrame:
    schema = f"{schema}, dt date, span string"
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{root}/{part}")
    return reader.parquet(*[f.path for f in folders])


def _ddl(struct) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in struct.fields)


# --- What retention has deleted ------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Cutoff:
    """Rows before ``moment`` are deleted if a batch up to ``batch`` wrote them."""

    moment: dt.datetime
    batch: int

    def hides(self, folder: Folder) -> bool:
        return folder.day < self.moment.date() and folder.last <= self.batch

    def leaves(self) -> Column:
        return (F.col("timestamp") >= ntz(self.moment)) | (F.col("ingest_batch") > self.batch)


def cutoff(spark: SparkSession, root: str) -> Cutoff | None:
    """What the latest retention has deleted; None if there was none."""
    names = [p.rsplit("/", 1)[1] for p in files.matching(spark, f"{root}/_retained/*")]
    if not names:
        return None
    micros, batch = max(tuple(map(int, n.split("_"))) for n in names)
    return Cutoff(_EPOCH + micros * _TICK, batch)


def _in_use(spark: SparkSession, root: str, part: str) -> tuple[list[Folder], Cutoff | None]:
    edge = cutoff(spark, root)
    used, _ = _listed(spark, root, part)
    return [f for f in used if edge is None or not edge.hides(f)], edge


# --- Reading -------------------------------------------------------------------


def _logs_of(
    spark: SparkSession, root: str, folders: list[Folder], edge: Cutoff | None
) -> DataFrame:
    rows = _read(spark, root, LOGS_PART, _ddl(STORED), folders)
    return rows if edge is None else rows.filter(edge.leaves())


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """The log table with ``dt``, its partition, and ``ingest_batch``.

    ``row_id`` is the pair (ingest_batch, position), which a row keeps when
    folders are merged.
    """
    rows = _logs_of(spark, root, *_in_use(spark, root, LOGS_PART))
    row_id = F.struct("ingest_batch", "position").alias("row_id")
    return rows.select(row_id, *ENTRY_COLUMNS, "dt", "ingest_batch")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The rejected lines, with ``dt``, the day they came, and ``ingest_batch``."""
    used, _ = _listed(spark, root, REJECTS_PART)
    schema = f"{_ddl(REJECTS)}, ingest_batch long"
    return _read(spark, root, REJECTS_PART, schema, used).drop("span")


def _rollup_of(
    spark: SparkSession, root: str, folders: list[Folder], edge: Cutoff | None
) -> DataFrame:
    """Hourly counts of folders, but of the hours that a cutoff has reached."""
    rows = _read(spark, root, ROLLUP_PART, _ddl(ROLLUP), folders)
    if edge is not None:
        later = F.split("span", "-")[1].cast("long") > edge.batch
        rows = rows.filter(later | (F.col("hour") >= ntz(_next_hour(edge))))
    return rows.drop("dt", "span")


def _next_hour(edge: Cutoff) -> dt.datetime:
    """The first hour that the cutoff does not cut."""
    hour = floor_hour(edge.moment)
    return hour if hour == edge.moment else hour + dt.timedelta(hours=1)


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Hourly counts; an hour may have several rows to be added up.

    An hour that a cutoff lies in is counted again from the log table.
    """
    used, edge = _in_use(spark, root, ROLLUP_PART)
    rows = _rollup_of(spark, root, used, edge)
    if edge is None or _next_hour(edge) == edge.moment:
        return rows
    logs = _logs_of(spark, root, *_in_use(spark, root, LOGS_PART))
    ts, low = F.col("timestamp"), edge.moment
    cut = (ts >= ntz(low)) & (ts < ntz(_next_hour(edge))) & (F.col("dt") == F.lit(low.date()))
    return rows.unionByName(hourly(logs.filter(cut & (F.col("ingest_batch") <= edge.batch))))


def hourly(logs: DataFrame) -> DataFrame:
    """Log rows counted per hour, severity and facility."""
    hour = bucket_start(F.col("timestamp"), "hour").alias("hour")
    return logs.groupBy(hour, "severity", "facility").agg(
        F.count(F.lit(1)).alias("total")
    )


def log_days(spark: SparkSession, root: str) -> list[dt.date]:
    """Days the log table has rows of, oldest first."""
    return sorted({f.day for f in _in_use(spark, root, LOGS_PART)[0]})


# --- Writing -------------------------------------------------------------------


def _writer(rows: DataFrame):
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    if "hostname" in rows.columns:
        for name in BLOOM_COLUMNS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", BLOOM_VALUES)
    return writer


def write_batch(
    lines: DataFrame,
    root: str,
    batch: int,
    now: dt.datetime | Column,
    fmt: str = "auto",
    tz: str = "UTC",
    *,
    max_bytes: int | None = None,
    cluster: bool = False,
) -> None:
    """Parse a batch of lines and append entries and rejects, in one job.

    Lines mostly arrive in time order, so each task sorts its own rows and
    nothing is shuffled. ``cluster`` is for input in no such order: it brings
    the rows of a day together first. Days may differ in size by any factor,
    since adaptive execution splits the large ones.

    A batch that is written again replaces what an earlier try left, as Spark
    overwrites the partitions that it writes to; folders of days that the lines
    no longer have go before. Of a batch that is merged by now, nothing changes.
    """
    spark = lines.sparkSession
    parsed = parse(lines, now, fmt, tz, max_bytes)
    parsed = parsed.withColumn("position", F.monotonically_increasing_id())
    # Blank lines are neither. The position keeps this filter above the parse.
    parsed = parsed.filter(F.col("log").isNotNull() | F.col("reason").isNotNull())
    is_log = F.col("log").isNotNull()
    received = F.to_date(ntz(now))
    own = f"{batch}-{batch}-0"
    rows = parsed.select(
        F.lit(batch).cast("long").alias("ingest_batch"),
        "position",
        *[F.col(f"log.{c}").alias(c) for c in ENTRY_COLUMNS],
        "line",
        "format",
        "reason",
        F.when(is_log, F.lit("logs")).otherwise(F.lit("rejects")).alias("outcome"),
        F.when(is_log, F.to_date("log.timestamp")).otherwise(received).alias("dt"),
        F.lit(own).alias("span"),
    )
    if cluster:
        rows = rows.hint("rebalance", "outcome", "dt")
    keys = ["outcome", "dt", "span"]
    rows = rows.sortWithinPartitions(*keys, "timestamp")
    for part in (LOGS_PART, REJECTS_PART, ROLLUP_PART):
        for path in files.matching(spark, f"{root}/{part}/dt=*/span={own}"):
            files.delete(spark, path)
    _partitions(rows, keys).parquet(root)
    written = files.matching(spark, f"{root}/{LOGS_PART}/dt=*/span={own}")
    if written:
        # Counted from the three columns that were just written.
        stored = _read(spark, root, LOGS_PART, _ddl(STORED), list(map(_folder, written)))
        hours = hourly(stored).withColumn("dt", F.to_date("hour")).repartition("dt")
        hours = hours.withColumn("span", F.lit(own))
        _partitions(hours, ["dt", "span"]).parquet(f"{root}/{ROLLUP_PART}")


def _partitions(rows: DataFrame, keys: list[str]):
    """A writer that replaces only the partitions that get rows."""
    return _writer(rows).option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


# --- Upkeep --------------------------------------------------------------------


def _merge(folders: list[Folder], rows: DataFrame) -> None:
    """Write the rows of some folders of a day as one, which stands for them once it is whole."""
    first, last = min(f.first for f in folders), max(f.last for f in folders)
    span = f"span={first}-{last}-{max(f.level for f in folders) + 1}"
    _writer(rows).parquet(f"{folders[0].path.rsplit('/', 1)[0]}/{span}")


def _merge_logs(
    spark: SparkSession, root: str, folders: list[Folder], edge: Cutoff | None, file_bytes: int
) -> None:
    """Few files that each cover a stretch of time.

    Splitting by (time, batch, position) keeps the files even although one
    moment may hold any share of the rows.
    """
    keys = ["timestamp", "ingest_batch", "position"]
    parts = -(-sum(files.size(spark, f.path) for f in folders) // file_bytes)
    rows = _logs_of(spark, root, folders, edge).drop("dt", "span")
    rows = rows.repartitionByRange(max(parts, 1), *keys).sortWithinPartitions(*keys)
    _merge(folders, rows)


def _merge_rejects(
    spark: SparkSession, root: str, folders: list[Folder], edge: Cutoff | None, file_bytes: int
) -> None:
    parts = -(-sum(files.size(spark, f.path) for f in folders) // file_bytes)
    schema = f"{_ddl(REJECTS)}, ingest_batch long"
    rows = _read(spark, root, REJECTS_PART, schema, folders).drop("dt", "span")
    _merge(folders, rows.repartition(max(parts, 1)))


def _merge_rollup(
    spark: SparkSession, root: str, folders: list[Folder], edge: Cutoff | None, file_bytes: int
) -> None:
    """One file of the hours of a day, at most a few thousand rows."""
    rows = _rollup_of(spark, root, folders, edge).groupBy("hour", "severity", "facility")
    _merge(folders, rows.agg(F.sum("total").alias("total")).coalesce(1))


def _by_day(folders: list[Folder]) -> list[list[Folder]]:
    days: dict[str, list[Folder]] = {}
    for folder in folders:
        days.setdefault(folder.path.rsplit("/", 1)[0], []).append(folder)
    return list(days.values())


def _latest_level(folders: list[Folder]) -> list[Folder]:
    """The latest ``FAN`` folders of a day if all are of one level; a row is merged few times."""
    latest = folders[-FAN:]
    return latest if len(latest) == FAN and len({f.level for f in latest}) == 1 else []


def _long_tail(folders: list[Folder]) -> list[Folder]:
    return folders if len(folders) > TAIL + 1 else []


_UPKEEP: dict[str, tuple[Callable, Callable]] = {
    LOGS_PART: (_latest_level, _merge_logs),
    REJECTS_PART: (_latest_level, _merge_rejects),
    ROLLUP_PART: (_long_tail, _merge_rollup),
}


def upkeep(spark: SparkSession, root: str, file_bytes: int = FILE_BYTES) -> None:
    """Remove folders that are no longer read, and merge what batches left in small files.

    The writer calls this between batches. What a merge or a cutoff put out of
    use goes with the next upkeep, so that a reader that began before can end.
    """
    for part, (due, merge) in _UPKEEP.items():
        used, unused = _listed(spark, root, part)
        edge = cutoff(spark, root)
        for path in unused:
            files.delete(spark, path)
        for folders in _by_day([f for f in used if edge is None or not edge.hides(f)]):
            if chosen := due(folders):
                merge(spark, root, chosen, edge, file_bytes)


def compact_day(
    spark: SparkSession, root: str, day: dt.date, file_bytes: int = FILE_BYTES
) -> None:
    """Merge all log folders of a day."""
    used, edge = _in_use(spark, root, LOGS_PART)
    for folders in _by_day([f for f in used if f.day == day]):
        _merge_logs(spark, root, folders, edge, file_bytes)


def compact_rollup(spark: SparkSession, root: str) -> None:
    """Merge the rollup of each day into one file."""
    used, edge = _in_use(spark, root, ROLLUP_PART)
    for folders in _by_day(used):
        _merge_rollup(spark, root, folders, edge, FILE_BYTES)


# --- Retention -----------------------------------------------------------------


def retention_due(
    spark: SparkSession, root: str, now: dt.datetime, minutes: int, every: dt.timedelta
) -> bool:
    """Whether the last retention is long enough ago."""
    edge = cutoff(spark, root)
    return edge is None or utc(now) - dt.timedelta(minutes=minutes) >= edge.moment + every


def retain(spark: SparkSession, root: str, now: dt.datetime, minutes: int) -> int:
    """Delete log rows older than the retention age; the count is returned.

    A row exactly at the cutoff stays, and so does an older one that comes
    later, until the next retention. Nothing is rewritten: the cutoff is noted,
    which readers apply from then on, the days before it by not opening their
    folders. Those go with the next retention.
    """
    moment = utc(now) - dt.timedelta(minutes=minutes)
    used, _ = _listed(spark, root, LOGS_PART)
    before = cutoff(spark, root)
    if not used or (before is not None and moment < before.moment):
        return 0
    expired = (F.col("dt") <= F.lit(moment.date())) & (F.col("timestamp") < ntz(moment))
    deleted = read_logs(spark, root).filter(expired).count()
    after = Cutoff(moment, max(f.last for f in used))
    name = f"{(moment - _EPOCH) // _TICK}_{after.batch}"
    files.create(spark, f"{root}/_retained/{name}")
    for path in files.matching(spark, f"{root}/_retained/*"):
        if path.rsplit("/", 1)[1] != name:
            files.delete(spark, path)
    if before is not None:
        for part in (LOGS_PART, ROLLUP_PART):
            for folder in _listed(spark, root, part)[0]:
                if before.hides(folder):
                    files.delete(spark, folder.path)
    return deleted

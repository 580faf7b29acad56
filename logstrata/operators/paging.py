"""Sorted pages of the log table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logstrata.functions import structured_data as sd
from logstrata.functions.time import day, epoch_ms, ntz
from logstrata.operators.filters import to_int64, where
from logstrata.sources import files

DEFAULT_SIZE = 50

#: Largest page that goes to the driver; a larger one is written to a table.
COLLECTED = 100_000

#: Names a page may be sorted by: API names and column names -> column.
SORT_COLUMNS = {
    "id": "row_id",
    "row_id": "row_id",
    "timestamp": "timestamp",
    "severity": "severity",
    "facility": "facility",
    "hostname": "hostname",
    "appName": "app_name",
    "app_name": "app_name",
    "procId": "procid",
    "procid": "procid",
    "msgId": "msgid",
    "msgid": "msgid",
    "structured_data": "structured_data",
    "message": "msg",
    "msg": "msg",
}

PAGE_COLUMNS = [
    "row_id",
    "facility",
    "severity",
    "timestamp",
    "hostname",
    "app_name",
    "procid",
    "msgid",
    "structured_data",
    "msg",
]


def read_sort(text: str | None) -> tuple[str, bool]:
    """``column.asc`` or ``column.<other>`` to (column, ascending).

    Blank or malformed text means newest first. A name that is no column
    raises, instead of reaching the query.
    """
    parts = (text or "").split(".")
    if len(parts) != 2:
        return "timestamp", False
    if parts[0] not in SORT_COLUMNS:
        raise ValueError(f"cannot sort by {parts[0]!r}")
    return SORT_COLUMNS[parts[0]], parts[1] == "asc"


def read_size(text: str | int | None) -> int:
    """Page size; anything but a positive integer means the default."""
    size = to_int64(str(text)) if text is not None else None
    return size if size and size > 0 else DEFAULT_SIZE


def ordering(
    sort: tuple[str, bool] = ("timestamp", False), backwards: bool = False
) -> list[Column]:
    """Sort keys: NULLs last both ways, ties broken by row id; or all of it backwards."""
    column, ascending = sort
    keys = [F.col(column), F.col("row_id")] if column != "row_id" else [F.col("row_id")]
    if backwards:
        return [k.desc_nulls_first() if ascending else k.asc_nulls_first() for k in keys]
    if ascending:
        return [k.asc_nulls_last() for k in keys]
    return [k.desc_nulls_last() for k in keys]


def page(
    logs: DataFrame,
    size: int = DEFAULT_SIZE,
    filters: Mapping[str, Any] | None = None,
    cursor: dt.datetime | None = None,
    direction: str = "next",
    sort: tuple[str, bool] = ("timestamp", False),
) -> DataFrame:
    """One page: filter, order, limit.

    The plan is a per-task top-k and a merge of the tasks' best rows, so
    nothing but ``size`` rows per task is shuffled. ``next`` takes rows older
    than the cursor, ``prev`` newer ones, in the same order: a ``prev`` page
    holds the newest rows, not those nearest to the cursor. The cursor acts on
    the timestamp whatever the sort column.
    """
    rows = logs.filter(where(logs, filters, cursor, direction))
    return _first(rows.select(PAGE_COLUMNS).orderBy(*ordering(sort)), size)


def _first(rows: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows; a size that Spark's limit cannot take is none."""
    return rows.limit(size) if size < 2**31 else rows


def taken(
    rows: DataFrame,
    size: int,
    sort: tuple[str, bool] = ("timestamp", False),
    project: Callable[[DataFrame], DataFrame] = lambda page: page,
) -> list[Row] | DataFrame:
    """The rows of a page: a list, or beyond ``COLLECTED`` rows a table that was written."""
    if size <= COLLECTED:
        return project(rows).collect()
    path = files.scratch(rows.sparkSession) + "/page"
    rows.write.parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return project(written.orderBy(*ordering(sort)))


def page_stable(
    logs: DataFrame,
    size: int = DEFAULT_SIZE,
    filters: Mapping[str, Any] | None = None,
    after: tuple[dt.datetime, int | tuple[int, int]] | None = None,
) -> DataFrame:
    """Newest-first page after the row with this (timestamp, row id).

    A row id is a number, or the (batch, position) of a stored table.

    Unlike a cursor of whole milliseconds this neither skips nor repeats rows
    that share one.
    """
    rows = logs.filter(where(logs, filters))
    if after is not None:
        ts, row_id = ntz(after[0]), _row_id(after[1])
        older = F.col("timestamp") < ts
        tied = (F.col("timestamp") == ts) & (F.col("row_id") < row_id)
        rows = rows.filter((F.col("timestamp") <= ts) & (older | tied))
        if "dt" in logs.columns:
            rows = rows.filter(F.col("dt") <= day(after[0]))
    return _first(rows.select(PAGE_COLUMNS).orderBy(*ordering()), size)


def _row_id(value: int | tuple[int, int]) -> Column:
    if not isinstance(value, tuple):
        return F.lit(value)
    batch, position = (F.lit(part).cast("long") for part in value)
    return F.struct(batch.alias("ingest_batch"), position.alias("position"))


def page_cursors(rows: DataFrame) -> DataFrame:
    """Cursors of a newest-first page: its oldest and newest millisecond."""
    return rows.agg(
        F.min(epoch_ms(F.col("timestamp"))).alias("next_cursor"),
        F.max(epoch_ms(F.col("timestamp"))).alias("prev_cursor"),
    )


def project(rows: DataFrame) -> DataFrame:
    """Rows under their API names, structured data parsed (NULL if empty)."""
    parsed = sd.parse(F.col("structured_data"))
    return rows.select(
        F.col("row_id").alias("id"),
        "facility",
        "severity",
        "timestamp",
        "hostname",
        F.col("app_name").alias("appName"),
        F.col("procid").alias("procId"),
        F.col("msgid").alias("msgId"),
        F.col("msg").alias("message"),
        F.when(F.size(parsed) > 0, parsed).alias("structuredData"),
    )


class Pages(Iterator[DataFrame]):
    """Pages that come one by one, or all together."""

    def joined(self) -> DataFrame:
        """The rows of all pages in page order."""
        raise NotImplementedError


def concat_pages(pages: list[DataFrame] | Pages) -> DataFrame:
    """Pages one after another, without removing duplicates."""
    if isinstance(pages, Pages):
        return pages.joined()
    joined = pages[0]
    for rows in pages[1:]:
        joined = joined.unionByName(rows)
    return joined

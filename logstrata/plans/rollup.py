"""Counts, facets and charts from the hourly rollup.

The rollup has a few hundred rows per hour whatever the log volume. Filters on
severity and facility can be answered from it: whole hours from the rollup,
and the at most two hours that a bound cuts from the log table itself, so that
the answer is that of a full scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logstrata.functions.time import bucket_start, day, floor_hour, ntz, utc
from logstrata.operators.aggregates import bucket_unit, chart_points, chart_range, facets_of
from logstrata.operators.filters import (
    CODE_FILTERS,
    TIME_FILTERS,
    read_direction,
    where,
    without_range,
)
from logstrata.sources.table import hourly

_HOUR = dt.timedelta(hours=1)
_TICK = dt.timedelta(microseconds=1)


def covers(filters: Mapping[str, Any] | None) -> bool:
    """True if the rollup can answer these filters."""
    used = {key for key, value in (filters or {}).items() if value is not None}
    return used <= {*CODE_FILTERS, *TIME_FILTERS}


def _check(filters: Mapping[str, Any] | None) -> None:
    if not covers(filters):
        raise ValueError("the rollup has no column for one of these filters")


def _ceil_hour(value: dt.datetime) -> dt.datetime:
    start = floor_hour(value)
    return start if start == value else start + _HOUR


def between(
    rollup: DataFrame,
    logs: DataFrame,
    filters: Mapping[str, Any] | None,
    low: dt.datetime | None,
    high: dt.datetime | None,
) -> DataFrame:
    """Rollup rows of the times ``low <= t < high``; None is no bound.

    An hour that a bound cuts is counted from the log table.
    """
    codes = without_range(filters)
    first = None if low is None else _ceil_hour(low)
    last = None if high is None else floor_hour(high)
    ts, hour = F.col("timestamp"), F.col("hour")
    partitioned = "dt" in logs.columns

    def scan(start: dt.datetime, end: dt.datetime) -> DataFrame:
        rows = logs.filter(where(logs, codes) & (ts >= ntz(start)) & (ts < ntz(end)))
        if partitioned:
            rows = rows.filter(F.col("dt").between(day(start), day(end)))
        return hourly(rows)

    if first is not None and last is not None and first >= last:
        return scan(low, high)
    whole = rollup.filter(where(rollup, codes))
    if first is not None:
        whole = whole.filter(hour >= ntz(first))
    if last is not None:
        whole = whole.filter(hour < ntz(last))
    if low is not None and low < first:
        whole = whole.unionByName(scan(low, first))
    if high is not None and last < high:
        whole = whole.unionByName(scan(last, high))
    return whole


def facets(rollup: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Both facets, without touching the log table."""
    _check(filters)
    rows = rollup.filter(where(rollup, without_range(filters)))
    return facets_of(rows.groupBy("severity", "facility").agg(F.sum("total").alias("total")))


def chart(
    rollup: DataFrame,
    logs: DataFrame,
    filters: Mapping[str, Any] | None,
    cursor: dt.datetime,
    unit: str | None = None,
) -> DataFrame:
    """The severity chart; units longer than an hour are re-cut from hours."""
    _check(filters)
    start, end = chart_range(filters, cursor)
    unit = unit or bucket_unit(start, end)
    rows = between(rollup, logs, filters, start, end + _TICK)
    return chart_points(rows, bucket_start(F.col("hour"), unit), F.col("total"))


def _bounds(
    filters: Mapping[str, Any] | None, cursor: dt.datetime | None, direction: str
) -> tuple[dt.datetime | None, dt.datetime | None]:
    """The times ``low <= t < high`` that filters and cursor leave; None is no bound."""
    lows, highs = [], []
    if (filters or {}).get("startDate") is not None:
        lows.append(utc(filters["startDate"]))
    if (filters or {}).get("endDate") is not None:
        highs.append(utc(filters["endDate"]) + _TICK)
    if cursor is not None and read_direction(direction) == "prev":
        lows.append(utc(cursor) + _TICK)
    elif cursor is not None:
        highs.append(utc(cursor))
    return max(lows, default=None), min(highs, default=None)


def page_edge(
    rollup: DataFrame,
    size: int,
    filters: Mapping[str, Any] | None,
    cursor: dt.datetime | None,
    direction: str,
    ascending: bool,
) -> dt.datetime | None:
    """The hour in which a page sorted by time is full; None if whole hours do not fill it.

    Running sums over the hours from the sorted end on; hours that a bound cuts
    are not counted, so that the page is full there at the latest. One row an
    hour is summed up, some 9,000 for a year.
    """
    _check(filters)
    low, high = _bounds(filters, cursor, direction)
    rows, hour = rollup.filter(where(rollup, without_range(filters))), F.col("hour")
    if low is not None:
        rows = rows.filter(hour >= ntz(_ceil_hour(low)))
    if high is not None:
        rows = rows.filter(hour < ntz(floor_hour(high)))
    hours = rows.groupBy("hour").agg(F.sum("total").alias("total"))
    order = hour.asc() if ascending else hour.desc()
    so_far = F.sum("total").over(Window.orderBy(order))
    full = hours.withColumn("so_far", so_far).filter(F.col("so_far") >= size)
    first = full.agg(F.min("hour") if ascending else F.max("hour")).first()
    return first[0]


def counts(
    rollup: DataFrame,
    logs: DataFrame,
    filters: Mapping[str, Any] | None = None,
    cursor: dt.datetime | None = None,
    direction: str = "next",
) -> DataFrame:
    """Filtered and total row count."""
    _check(filters)
    rows = between(rollup, logs, filters, *_bounds(filters, cursor, direction))
    none = F.lit(0).cast("long")
    both = rows.select(F.col("total").alias("f"), none.alias("t")).unionByName(
        rollup.select(none.alias("f"), F.col("total").alias("t"))
    )
    return both.agg(
        F.coalesce(F.sum("f"), none).alias("filtered_count"),
        F.coalesce(F.sum("t"), none).alias("total_count"),
    )

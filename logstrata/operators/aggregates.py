"""Counts, facets and the severity chart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.time import bucket_start, epoch_ms, floor_hour, utc
from logstrata.operators.filters import where, without_range
from logstrata.schema import SEVERITY_NAMES

_DAY = dt.timedelta(days=1)
_HOUR = dt.timedelta(hours=1)

#: Chart columns with the severity code each counts, as the response has them.
SERIES = [(name, code) for code, name in reversed(list(enumerate(SEVERITY_NAMES)))]


def counts(
    logs: DataFrame,
    filters: Mapping[str, Any] | None = None,
    cursor: dt.datetime | None = None,
    direction: str = "next",
) -> DataFrame:
    """Filtered (cursor included) and total row count.

    Two counts: the filtered one reads what its filters leave, the total no
    column at all.
    """
    none = F.lit(0).cast("long")
    filtered = logs.filter(where(logs, filters, cursor, direction))
    both = filtered.agg(F.count(F.lit(1)).alias("f")).select("f", none.alias("t")).unionByName(
        logs.agg(F.count(F.lit(1)).alias("t")).select(none.alias("f"), "t")
    )
    return both.agg(
        F.coalesce(F.sum("f"), none).alias("filtered_count"),
        F.coalesce(F.sum("t"), none).alias("total_count"),
    )


def code_totals(rows: DataFrame) -> DataFrame:
    """Rows per (severity, facility): the small table both facets come from."""
    return rows.groupBy("severity", "facility").agg(F.count(F.lit(1)).alias("total"))


def facets_of(totals: DataFrame) -> DataFrame:
    """Long facets (field, value, total) of (severity, facility, total) rows."""
    long = totals.select(
        F.stack(
            F.lit(2),
            F.lit("severity"),
            F.col("severity"),
            F.col("total"),
            F.lit("facility"),
            F.col("facility"),
            F.col("total"),
        ).alias("field", "value", "total")
    )
    return long.groupBy("field", "value").agg(F.sum("total").alias("total"))


def facets(logs: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Severity and facility facets; the time range is not applied.

    Rows are first counted per pair of codes, so that one scan and one small
    shuffle serve both facets. Grouping sets would copy every row instead.
    """
    rows = logs.filter(where(logs, without_range(filters)))
    return facets_of(code_totals(rows))


def facet(
    logs: DataFrame, field: str, filters: Mapping[str, Any] | None = None
) -> DataFrame:
    """One facet (value, total); the time range is not applied."""
    rows = logs.filter(where(logs, without_range(filters)))
    return rows.groupBy(F.col(field).alias("value")).agg(
        F.count(F.lit(1)).alias("total")
    )


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Values of any column with their counts."""
    return rows.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("total")
    )


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value of any column."""
    return rows.agg(
        F.min(column).alias("min_value"), F.max(column).alias("max_value")
    )


def chart_range(
    filters: Mapping[str, Any] | None, cursor: dt.datetime
) -> tuple[dt.datetime, dt.datetime]:
    """Range of the chart. Without both ends: a day up to the cursor's hour.

    The default end is cut to the hour and the start is not, so the first
    bucket is a part of an hour.
    """
    start = (filters or {}).get("startDate")
    end = (filters or {}).get("endDate")
    if start is None or end is None:
        return utc(cursor) - _DAY, floor_hour(cursor) + _HOUR
    return utc(start), utc(end)


def bucket_unit(start: dt.datetime, end: dt.datetime) -> str:
    """Bucket width for a range, which bounds the number of points."""
    length = end - start
    # Longest range per bucket width.
    if length <= 3 * _DAY:
        return "hour"
    if length <= 21 * _DAY:
        return "day"
    if length <= 180 * _DAY:
        return "week"
    return "month"


def chart_filters(
    filters: Mapping[str, Any] | None, start: dt.datetime, end: dt.datetime
) -> dict[str, Any]:
    """The filters with the chart's own range."""
    return {**(filters or {}), "startDate": start, "endDate": end}


def _series(total: Column) -> list[Column]:
    return [
        F.sum(F.when(F.col("severity") == code, total).otherwise(0)).alias(name)
        for name, code in SERIES
    ]


def chart_points(rows: DataFrame, bucket: Column, total: Column) -> DataFrame:
    """Chart of rows that stand for ``total`` log rows each, oldest first."""
    points = rows.groupBy(bucket.alias("bucket")).agg(*_series(total))
    named = [F.col(name) for name, _ in SERIES]
    return points.select(epoch_ms(F.col("bucket")).alias("ts"), *named).orderBy("ts")


def chart(
    logs: DataFrame,
    filters: Mapping[str, Any] | None,
    cursor: dt.datetime,
    unit: str | None = None,
) -> DataFrame:
    """Counts per time bucket and severity; empty buckets are absent.

    The cursor only sets the default range. ``unit`` overrides the bucket
    width chosen from the length of the range.
    """
    start, end = chart_range(filters, cursor)
    unit = unit or bucket_unit(start, end)
    rows = logs.filter(where(logs, chart_filters(filters, start, end)))
    return chart_points(rows, bucket_start(F.col("timestamp"), unit), F.lit(1))

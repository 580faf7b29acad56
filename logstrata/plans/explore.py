"""The explorer report: page, counts, facets, chart and cursors of a request."""

from __future__ import annotations

import concurrent.futures
import dataclasses
import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from logstrata.functions.time import bucket_start
from logstrata.operators import aggregates, paging
from logstrata.operators.filters import where, without_range
from logstrata.plans import rollup as rollups
from logstrata.plans.request import Request, cursors, read_request
from logstrata.plans.walk import page_by_days

__all__ = ["Report", "Request", "explore", "read_request", "respond", "summary"]


@dataclasses.dataclass
class Report:
    """The parts of a report, as DataFrames that have not run yet."""

    page: DataFrame
    counts: DataFrame
    facets: DataFrame
    chart: DataFrame


def summary(logs: DataFrame, request: Request) -> DataFrame:
    """Everything but the page, from a single scan.

    Rows are counted per (chart bucket, severity, facility), with one count
    for each of the report's scopes: ``filtered`` uses all filters and the
    cursor, ``total`` nothing, ``faceted`` the filters without the time range,
    and the chart the filters with its own range (the bucket is NULL outside
    it). The result has at most a few thousand rows.
    """
    start, end = aggregates.chart_range(request.filters, request.cursor)
    unit = aggregates.bucket_unit(start, end)
    in_chart = where(logs, aggregates.chart_filters(request.filters, start, end))
    in_page = where(logs, request.filters, request.cursor, request.direction)
    in_facets = where(logs, without_range(request.filters))
    bucket = F.when(in_chart, bucket_start(F.col("timestamp"), unit))
    return logs.groupBy(bucket.alias("bucket"), "severity", "facility").agg(
        F.count_if(in_page).alias("filtered"),
        F.count_if(in_facets).alias("faceted"),
        F.count(F.lit(1)).alias("total"),
    )


def _from_summary(page: DataFrame, sums: DataFrame) -> Report:
    none = F.lit(0).cast("long")
    counted = sums.agg(
        F.coalesce(F.sum("filtered"), none).alias("filtered_count"),
        F.coalesce(F.sum("total"), none).alias("total_count"),
    )
    faceted = sums.filter(F.col("faceted") > 0).select(
        "severity", "facility", F.col("faceted").alias("total")
    )
    charted = sums.filter(F.col("bucket").isNotNull())
    return Report(
        page=page,
        counts=counted,
        facets=aggregates.facets_of(faceted),
        chart=aggregates.chart_points(charted, F.col("bucket"), F.col("total")),
    )


def _counts(logs: DataFrame, request: Request, rollup: DataFrame | None) -> DataFrame:
    """Filtered count of the log table, total of the rollup if there is one."""
    if rollup is None:
        return aggregates.counts(logs, request.filters, request.cursor, request.direction)
    none = F.lit(0).cast("long")
    rows = logs.filter(where(logs, request.filters, request.cursor, request.direction))
    both = rows.agg(F.count(F.lit(1)).alias("f")).select("f", none.alias("t")).unionByName(
        rollup.select(none.alias("f"), F.col("total").alias("t"))
    )
    return both.agg(
        F.sum("f").alias("filtered_count"), F.coalesce(F.sum("t"), none).alias("total_count")
    )


def explore(
    logs: DataFrame, request: Request, rollup: DataFrame | None = None
) -> Report:
    """The report of a request.

    With a rollup that covers the filters, counts, facets and chart do not
    scan the log table. Without, each part of a table partitioned by ``dt`` is a
    scan of its own, of the days and values that its filters leave; the total
    comes from the rollup all the same. Logs that have no partitions are
    aggregated once, by ``summary``.
    """
    page = paging.page(
        logs,
        request.size,
        request.filters,
        request.cursor,
        request.direction,
        request.sort,
    )
    if rollup is None and "dt" not in logs.columns:
        return _from_summary(page, summary(logs, request))
    if rollup is None or not rollups.covers(request.filters):
        return Report(
            page=page,
            counts=_counts(logs, request, rollup),
            facets=aggregates.facets(logs, request.filters),
            chart=aggregates.chart(logs, request.filters, request.cursor),
        )
    return Report(
        page=page,
        counts=rollups.counts(
            rollup, logs, request.filters, request.cursor, request.direction
        ),
        facets=rollups.facets(rollup, request.filters),
        chart=rollups.chart(rollup, logs, request.filters, request.cursor),
    )


def respond(
    logs: DataFrame,
    request: Request,
    rollup: DataFrame | None = None,
    days: list[dt.date] | None = None,
) -> dict[str, Any]:
    """Run a report and return it as one plain object.

    ``days`` lists the partitions of a table partitioned by ``dt``; a page
    sorted by time is then read from as few of them as fill it.

    Only the page and counts per bucket and code reach the driver; a page of
    more than ``paging.COLLECTED`` rows is written, and ``data`` is then a
    DataFrame. The jobs of the parts run at the same time.
    """
    report = explore(logs, request, rollup)
    if rollup is None and "dt" not in logs.columns:
        sums = summary(logs, request)
        spark = logs.sparkSession
        report = _from_summary(
            report.page, spark.createDataFrame(sums.collect(), sums.schema)
        )

    def page_rows() -> list[Row] | DataFrame:
        if days is None or request.sort[0] != "timestamp":
            return paging.taken(report.page, request.size, request.sort, paging.project)
        return page_by_days(logs, days, request, paging.project, rollup)

    parts = {
        "rows": page_rows,
        "counts": report.counts.first,
        "facets": report.facets.orderBy("field", "value").collect,
        "chart": report.chart.collect,
    }
    inherit = inheritable_thread_target(logs.sparkSession)
    with concurrent.futures.ThreadPoolExecutor(len(parts)) as pool:
        jobs = {name: pool.submit(inherit(job)) for name, job in parts.items()}
        done = {name: job.result() for name, job in jobs.items()}
    facets: dict[str, list] = {"severity": [], "facility": []}
    for row in done["facets"]:
        facets[row["field"]].append({"value": row["value"], "total": row["total"]})
    rows = done["rows"]
    ends = [*rows.take(1), *rows.tail(1)] if isinstance(rows, DataFrame) else rows
    next_cursor, prev_cursor = cursors(ends)
    return {
        "data": rows,
        "totalRowCount": done["counts"]["total_count"],
        "filterRowCount": done["counts"]["filtered_count"],
        "chartData": [row.asDict() for row in done["chart"]],
        "facets": facets,
        "nextCursor": next_cursor,
        "prevCursor": prev_cursor,
    }

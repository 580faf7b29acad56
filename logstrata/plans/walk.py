"""Pages of a large table: newest days first, and page after page."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from logstrata.functions.time import day, epoch_ms, from_ms, ntz, to_ms, utc
from logstrata.operators import paging
from logstrata.operators.filters import where
from logstrata.plans import rollup as rollups
from logstrata.plans import steps
from logstrata.plans.request import Request
from logstrata.sources import files

#: How much further back each try of a day-wise page looks.
_GROWTH = 4


def _asked_days(days: list[dt.date], request: Request) -> list[dt.date]:
    """The days the bounds of a request leave."""
    low = [request.filters.get("startDate")]
    high = [request.filters.get("endDate")]
    (low if request.direction == "prev" else high).append(request.cursor)
    lows = [utc(bound).date() for bound in low if bound is not None]
    highs = [utc(bound).date() for bound in high if bound is not None]
    return [
        d
        for d in sorted(days)
        if all(d >= bound for bound in lows) and all(d <= bound for bound in highs)
    ]


def page_by_days(
    logs: DataFrame,
    days: list[dt.date],
    request: Request,
    project: Callable[[DataFrame], DataFrame] = lambda page: page,
    rollup: DataFrame | None = None,
) -> list[Row] | DataFrame:
    """A page sorted by time, read from as few days as hold enough rows.

    ``logs`` is partitioned by ``dt`` and ``days`` lists its partitions. Where
    the rollup covers the filters, its running sums tell in which hour the page
    is full, and the page is one scan of the hours from there on. Otherwise the
    day at the sorted end is read first, then four times as many, until the page
    is full or no day is left. The rows are those of a full scan.
    """
    column, ascending = request.sort
    if column != "timestamp":
        raise ValueError("only a page sorted by time can be read by days")

    def page(rows: DataFrame) -> list[Row] | DataFrame:
        asked = request.filters, request.cursor, request.direction, request.sort
        found = paging.page(rows, request.size, *asked)
        return paging.taken(found, request.size, request.sort, project)

    if rollup is not None and rollups.covers(request.filters):
        return page(_full_from(logs, rollup, request))
    if request.size > paging.COLLECTED:
        return page(logs)
    asked = _asked_days(days, request)
    if not ascending:
        asked.reverse()
    take = 1
    while True:
        rows = logs
        if take < len(asked):
            # Open towards the sorted end, so that nothing before the first
            # rows of the page can be left out.
            edge, on_day = F.lit(asked[take - 1]), F.col("dt")
            rows = logs.filter(on_day <= edge if ascending else on_day >= edge)
        found = page(rows)
        if len(found) == request.size or take >= len(asked):
            return found
        take *= _GROWTH


def _full_from(logs: DataFrame, rollup: DataFrame, request: Request) -> DataFrame:
    """The rows from the hour on in which the page is full."""
    ascending = request.sort[1]
    hour = rollups.page_edge(
        rollup, request.size, request.filters, request.cursor, request.direction, ascending
    )
    if hour is None:
        return logs
    ts, on_day = F.col("timestamp"), F.col("dt")
    if ascending:
        end = hour + dt.timedelta(hours=1)
        return logs.filter((ts < ntz(end)) & (on_day <= day(end)))
    return logs.filter((ts >= ntz(hour)) & (on_day >= day(hour)))


class Walk(paging.Pages):
    """Next pages from the request's cursor on, as a scrolling reader asks.

    Pages keep the request's sort. Each starts below the last row's millisecond
    of the page before it, whatever the sort column, as a reader's cursor does;
    sorted by another column than the time, pages can therefore skip rows. The
    walk ends when the rows fetched reach the filtered count of the latest page,
    or a page is empty. That count includes the cursor and so shrinks on the
    way; use ``extract`` for all rows.

    As an iterator it asks for page after page. A page is read once: it is kept
    while its number of rows, its last row and the count are found, of which
    alone the driver sees one row each. ``joined`` gives the rows of all pages,
    also of those that were taken before; newest first it takes as many jobs for
    any number of pages.
    """

    def __init__(self, logs: DataFrame, request: Request):
        self._logs, self._request = logs, request
        self._pages = _asked(logs, request)

    def __next__(self) -> DataFrame:
        return next(self._pages)

    def joined(self) -> DataFrame:
        if self._request.sort == ("timestamp", False) and self._request.size > 0:
            return _newest_first(self._logs, self._request)
        pages = list(_asked(self._logs, self._request))
        return paging.concat_pages(pages) if pages else _none(self._logs)


def walk(logs: DataFrame, request: Request) -> Walk:
    """The pages from the request's cursor on; see ``Walk``."""
    return Walk(logs, request)


def _asked(logs: DataFrame, request: Request) -> Iterator[DataFrame]:
    """Page after page of a walk."""
    fetched = 0
    while True:
        page = paging.page(
            logs, request.size, request.filters, request.cursor, "next", request.sort
        ).cache()
        try:
            rows = page.count()
            if not rows:
                return
            backwards = paging.ordering(request.sort, backwards=True)
            last = page.orderBy(*backwards).select("timestamp").first()["timestamp"]
            yield page
        finally:
            page.unpersist()
        fetched += rows
        matching = logs.filter(where(logs, request.filters, request.cursor)).count()
        if fetched >= matching:
            return
        request = dataclasses.replace(request, cursor=from_ms(to_ms(last)))


def _newest_first(logs: DataFrame, request: Request) -> DataFrame:
    """All pages of a newest-first walk: every row down to the end of the last
    page, less the rest of each millisecond in which a page ends."""
    ends = steps.page_ends(logs, request)
    last = ends.agg(F.min("ms")).first()[0]
    if last is None:
        return _none(logs)
    starts = [request.filters.get("startDate"), from_ms(last)]
    starts = [utc(start) for start in starts if start is not None]
    filters = {**request.filters, "startDate": max(starts, default=None)}
    rows = logs.filter(where(logs, filters, request.cursor)).select(
        *paging.PAGE_COLUMNS, epoch_ms(F.col("timestamp")).alias("ms")
    )
    cut = ends.filter("taken < n").select("ms", "taken")
    within = Window.partitionBy("ms").orderBy(*paging.ordering(request.sort))
    ranked = rows.join(cut, "ms").withColumn("place", F.row_number().over(within))
    # The page size bounds ``taken``; as a constant it lets tasks drop rows early.
    taken = F.col("place") <= F.col("taken")
    if request.size < 2**31:
        taken = (F.col("place") <= request.size) & taken
    whole = rows.join(cut, "ms", "left_anti").select(paging.PAGE_COLUMNS)
    kept = whole.unionByName(ranked.filter(taken).select(paging.PAGE_COLUMNS))
    return kept.orderBy(*paging.ordering(request.sort))


def _none(logs: DataFrame) -> DataFrame:
    return logs.select(paging.PAGE_COLUMNS).limit(0)


def page_bounds(
    logs: DataFrame,
    size: int,
    filters: dict[str, Any] | None = None,
    sort: tuple[str, bool] = ("timestamp", False),
) -> DataFrame:
    """page (from 0), n_rows, first_id and last_id of all pages of ``size`` rows.

    The sort keys of the matching rows are dealt out by ranges, sorted and
    written once; the number of rows in each range, of which there are as many
    as tasks, gives the rank of every row without a sort in one place. These are
    the pages of ``extract``, each of which then is a range of its own.
    """
    spark, column = logs.sparkSession, sort[0]
    keys = logs.filter(where(logs, filters)).select(*dict.fromkeys([column, "row_id"]))
    ordered = keys.orderBy(*paging.ordering(sort)).select(
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("place"),
        "row_id",
    )
    path = files.scratch(spark) + "/keys"
    ordered.write.parquet(path)
    ordered = spark.read.schema(ordered.schema).parquet(path)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = F.broadcast(parts.select("part", before.alias("start")))
    rank = F.col("start") + F.col("place")
    ranked = ordered.join(starts, "part").select(rank.alias("rank"), "row_id")
    pages = ranked.groupBy(F.expr(f"rank div {size}").alias("page"))
    return pages.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by("row_id", "rank").alias("first_id"),
        F.max_by("row_id", "rank").alias("last_id"),
    )


def extract(
    logs: DataFrame, filters: dict[str, Any], sort: tuple[str, bool] = ("timestamp", False)
) -> DataFrame:
    """All matching rows in page order, as one distributed sort."""
    rows = logs.filter(where(logs, filters)).select(paging.PAGE_COLUMNS)
    return rows.orderBy(*paging.ordering(sort))

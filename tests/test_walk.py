import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import registry
from logstrata.operators import paging
from logstrata.plans import explore, walk
from tests.test_query import NOW, T, US, make

MS = dt.timedelta(milliseconds=1)


def rows_of(spark, n, step=211 * US):
    """Rows of which some share a millisecond, each tenth comes twice, and each seventh has no id."""
    rows = [(i, T + i * step + (i // 30) * MS) for i in range(n)]
    rows += rows[::10]
    logs = make(spark, rows)
    return logs.withColumn("row_id", F.when(F.col("row_id") % 7 != 0, F.col("row_id")))


@pytest.fixture
def ranges(spark):
    """Small tables dealt out by ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("size", [7, 16, 60, 110, 2**40])
def test_a_joined_walk_is_that_of_page_after_page(spark, ranges, size):
    logs = rows_of(spark, 100).withColumn("dt", F.to_date("timestamp")).repartition(3).cache()
    middle = T + 9 * MS + 300 * US
    for filters, cursor in (({}, NOW), ({"startDate": T + 2 * MS + 500 * US, "hostname": "h"}, middle)):
        request = explore.Request(cursor=cursor, size=size, filters=filters)
        pages = [page.collect() for page in walk.walk(logs, request)]
        joined = paging.concat_pages(walk.walk(logs, request))
        assert joined.collect() == [row for page in pages for row in page]
    logs.unpersist()


def test_a_walk_sorted_otherwise_is_joined_too(spark, logs):
    request = explore.Request(cursor=NOW, size=30, filters={"severity": [3]}, sort=("hostname", False))
    pages = [page.collect() for page in walk.walk(logs, request)]
    joined = paging.concat_pages(walk.walk(logs, request)).collect()
    assert sorted(map(str, joined)) == sorted(str(row) for page in pages for row in page)


@pytest.mark.parametrize("sort", [("timestamp", False), ("hostname", True)])
def test_a_walk_over_nothing_has_no_rows(spark, logs, sort):
    request = explore.Request(cursor=NOW, filters={"hostname": "nobody"}, sort=sort)
    joined = paging.concat_pages(walk.walk(logs, request))
    assert joined.columns == paging.PAGE_COLUMNS and joined.collect() == []


def jobs_of(spark, group, action):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        found = action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return found, len(context.statusTracker().getJobIdsForGroup(group))


def test_page_walk_takes_no_job_for_each_page(spark):
    """Page after page it took three jobs or more for each of the 41."""
    n = 8_000
    logs = make(spark, [(i, T + i * MS, {"hostname": "host-5"}) for i in range(n)]).cache()
    logs.count()
    found, jobs = jobs_of(spark, "page_walk", lambda: registry.page_walk(logs).collect())
    logs.unpersist()
    assert [row["row_id"] for row in found] == list(range(n - 1, n - 4_101, -1))
    assert 0 < jobs < 40, jobs

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logstrata.functions.time import to_ms
from logstrata.operators import aggregates, filters, paging, ranges
from logstrata.plans import explore, walk

NOW = dt.datetime(2024, 1, 31)
A, B = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)


def test_read_filters_is_lenient():
    assert filters.read_filters({"severity": "emergency,warning", "hostname": ""}) == {}
    assert filters.read_filters({"severity": "0,+1,x, 2,1_0", "facility": "-1"}) == {
        "severity": [0, 1],
        "facility": [-1],
    }
    span = f"{to_ms(A)}-{to_ms(B)}"
    assert filters.read_filters({"timestamp": span}) == {"startDate": A, "endDate": B}
    for bad in ("5", "1-2-3", "-5-7", "a-b", "1-", "1-99999999999999999999"):
        assert filters.read_filters({"timestamp": bad}) == {}


def test_read_cursor():
    latest = NOW + dt.timedelta(minutes=1)
    assert filters.read_cursor(None, NOW) == latest
    assert filters.read_cursor("soon", NOW) == latest
    assert filters.read_cursor(str(to_ms(latest) + 1), NOW) == latest
    assert filters.read_cursor(str(to_ms(A)), NOW) == A
    assert filters.read_cursor("9" * 18, NOW) == latest


def test_read_sort_and_size():
    assert paging.read_sort(None) == ("timestamp", False)
    assert paging.read_sort("timestamp") == ("timestamp", False)
    assert paging.read_sort("a.b.c") == ("timestamp", False)
    assert paging.read_sort("appName.asc") == ("app_name", True)
    assert paging.read_sort("severity.down") == ("severity", False)
    with pytest.raises(ValueError):
        paging.read_sort("row_id;drop.asc")
    assert [paging.read_size(s) for s in (None, "", "x", "0", "-1", "1_0")] == [50] * 6
    assert paging.read_size("7") == 7


def test_empty_list_is_no_filter(logs):
    assert logs.filter(filters.where(logs, {"severity": []})).count() == logs.count()
    assert logs.filter(filters.where(logs, None)).count() == logs.count()
    assert logs.filter(filters.where(logs, {"severity": [2**40]})).count() == 0


def test_range_is_inclusive_and_reopened_one_is_not(spark):
    ms = dt.timedelta(milliseconds=1)
    times = [A - ms, A, A + ms / 2, A + ms, B - ms, B, B + ms]
    rows = spark.createDataFrame([(t,) for t in times], "timestamp timestamp_ntz")
    inside = rows.filter(filters.where(rows, {"startDate": A, "endDate": B}))
    assert sorted(r[0] for r in inside.collect()) == times[1:6]
    again = rows.filter(filters.in_open_range(F.col("timestamp"), A, B))
    assert sorted(r[0] for r in again.collect()) == times[3:5]
    same = rows.filter(filters.in_open_range(F.col("timestamp"), A, None))
    assert sorted(r[0] for r in same.collect()) == times[1:4]


def test_named_ranges():
    now = dt.datetime(2024, 3, 1, 13, 45)
    assert ranges.named("Last hour", now) == (now - dt.timedelta(hours=1), now)
    start, end = ranges.named("last 7 days", now)
    assert start == dt.datetime(2024, 2, 23)
    assert end == dt.datetime(2024, 3, 1, 23, 59, 59, 999000)
    assert ranges.around(now, "day") == ranges.named("today", now)
    with pytest.raises(ValueError):
        ranges.named("last year", now)


def test_chart_units_at_their_limits():
    end, ms = NOW, dt.timedelta(milliseconds=1)
    for days, unit, longer in ((3, "hour", "day"), (21, "day", "week"), (180, "week", "month")):
        start = end - dt.timedelta(days=days)
        assert aggregates.bucket_unit(start, end) == unit
        assert aggregates.bucket_unit(start - ms, end) == longer


def test_chart_default_replaces_a_half_given_range():
    cursor = dt.datetime(2024, 1, 20, 13, 45)
    want = (dt.datetime(2024, 1, 19, 13, 45), dt.datetime(2024, 1, 20, 14))
    assert aggregates.chart_range({}, cursor) == want
    assert aggregates.chart_range({"startDate": A}, cursor) == want


def test_predicates_reach_the_file_scan(spark, logs, tmp_path, capsys):
    path = str(tmp_path / "t")
    dated = logs.withColumn("dt", F.to_date("timestamp"))
    dated.write.partitionBy("dt").parquet(path)
    stored = spark.read.parquet(path)
    given = {"severity": [0, 3], "startDate": A, "endDate": B}
    page = paging.page(stored, 10, given, dt.datetime(2024, 1, 11))
    page.explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    pushed = plan[plan.index("PushedFilters"):].splitlines()[0]
    assert "In(severity, [0,3])" in pushed
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThan(timestamp" in pushed
    days = plan[plan.index("PartitionFilters"):].splitlines()[0]
    assert ">= 2024-01-10" in days and "<= 2024-01-11" in days
    assert page.collect() == paging.page(logs, 10, given, dt.datetime(2024, 1, 11)).collect()


def test_report_parts_read_what_their_filters_leave(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    logs.withColumn("dt", F.to_date("timestamp")).write.partitionBy("dt").parquet(path)
    stored = spark.read.parquet(path)
    given = {"hostname": "host-5", "severity": [0, 3], "startDate": A, "endDate": B}
    request = explore.Request(cursor=B, filters=given)
    report = explore.explore(stored, request)

    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "FileScan" in line]

    counted, total = scans(report.counts)
    (charted,), (faceted,) = scans(report.chart), scans(report.facets)
    for scan in (counted, charted):
        assert "dt#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    for scan in (counted, charted, faceted):
        assert "EqualTo(hostname,host-5)" in scan and "In(severity, [0,3])" in scan
    assert "ReadSchema: struct<>" in total and "PushedFilters: []" in total
    plain = explore.explore(logs, request)
    for part in ("counts", "facets", "chart"):
        rows = [sorted(map(str, getattr(r, part).collect())) for r in (report, plain)]
        assert rows[0] == rows[1]
    total_only = spark.createDataFrame([(A, 0, 0, 5), (B, 1, 1, 6)],
                                       "hour timestamp_ntz, severity int, facility int, total long")
    with_rollup = explore.explore(stored, request, total_only).counts.first()
    assert with_rollup["total_count"] == 11
    assert with_rollup["filtered_count"] == report.counts.first()["filtered_count"]


def test_page_size_beyond_an_integer(logs):
    for size in (2**31, 2**62):
        assert paging.page(logs, size).count() == logs.count()
    first = paging.page(logs, 2**31).first()
    assert paging.page_stable(logs, 2**40).first() == first


def test_stable_page_of_a_zoned_time(spark, logs):
    dated = logs.withColumn("dt", F.to_date("timestamp"))
    zone = dt.timezone(dt.timedelta(hours=-5))
    local = dt.datetime(2024, 1, 20, 23, 30, tzinfo=zone)
    want = paging.page_stable(dated, 20, None, (dt.datetime(2024, 1, 21, 4, 30), 0)).collect()
    assert paging.page_stable(dated, 20, None, (local, 0)).collect() == want
    assert want[0]["timestamp"].day == 21


def test_walk_keeps_the_sort(logs):
    for sort in (("timestamp", True), ("hostname", False)):
        request = explore.Request(cursor=B, size=30, filters={"severity": [3]}, sort=sort)
        first = next(walk.walk(logs, request)).collect()
        assert first == paging.page(logs, 30, {"severity": [3]}, B, "next", sort).collect()

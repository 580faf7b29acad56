import datetime as dt

import pytest

from logstrata.functions.time import to_ms
from logstrata.operators import aggregates, enrich, paging
from logstrata.operators.filters import where
from logstrata.plans import explore, rollup, walk
from logstrata.schema import LOGS
from logstrata.sources.table import hourly

NOW = dt.datetime(2024, 1, 31)
T = dt.datetime(2024, 1, 20, 12)
US = dt.timedelta(microseconds=1)


def make(spark, rows):
    """Log rows from (row_id, timestamp, overrides)."""
    out = []
    for row_id, ts, *rest in rows:
        row = {
            "row_id": row_id, "severity": 3, "facility": 1, "version": 1, "timestamp": ts,
            "hostname": "h", "app_name": "a", "procid": "p", "msgid": "m",
            "structured_data": "-", "msg": "x", **(rest[0] if rest else {}),
        }
        out.append(tuple(row[f.name] for f in LOGS.fields))
    return spark.createDataFrame(out, LOGS)


def ids(page):
    return [row["row_id"] for row in page.collect()]


def test_prev_page_is_newest_first_and_repeats_the_cursor_row(spark):
    logs = make(spark, [(i, T + i * dt.timedelta(seconds=1) + 7 * US) for i in range(9)])
    cursor = dt.datetime(2024, 1, 20, 12, 0, 4)
    assert ids(paging.page(logs, 2, {}, cursor, "prev")) == [8, 7]
    assert ids(paging.page(logs, 9, {}, cursor, "prev")) == [8, 7, 6, 5, 4]
    assert ids(paging.page(logs, 9, {}, cursor, "sideways")) == [3, 2, 1, 0]


def test_millisecond_cursor_skips_where_the_stable_page_does_not(spark):
    logs = make(spark, [(i, T + i * 100 * US) for i in range(4)] + [(9, T)])
    request = explore.Request(cursor=NOW, size=2)
    walked = [r for page in walk.walk(logs, request) for r in ids(page)]
    assert walked == [3, 2]
    seen, after = [], None
    while rows := paging.page_stable(logs, 2, {}, after).collect():
        seen += [row["row_id"] for row in rows]
        after = (rows[-1]["timestamp"], rows[-1]["row_id"])
    assert seen == [3, 2, 1, 9, 0]


def test_sort_puts_null_last_both_ways(spark):
    logs = make(spark, [(1, T, {"procid": None}), (2, T), (3, T, {"procid": "q"})])
    assert ids(paging.page(logs, 9, sort=("procid", True))) == [2, 3, 1]
    assert ids(paging.page(logs, 9, sort=("procid", False))) == [3, 2, 1]


def test_future_rows_are_counted_but_not_shown(spark):
    logs = make(spark, [(1, NOW - US), (2, NOW + dt.timedelta(hours=1))])
    reply = explore.respond(logs, explore.read_request({}, NOW))
    assert [row["id"] for row in reply["data"]] == [1]
    assert (reply["filterRowCount"], reply["totalRowCount"]) == (1, 2)
    assert reply["facets"]["severity"] == [{"value": 3, "total": 2}]


def test_empty_table(spark):
    reply = explore.respond(make(spark, []), explore.read_request({}, NOW))
    assert reply["data"] == [] and reply["chartData"] == []
    assert reply["nextCursor"] is None and reply["prevCursor"] is None
    assert (reply["filterRowCount"], reply["totalRowCount"]) == (0, 0)
    empty = hourly(make(spark, []))
    counted = rollup.counts(empty, make(spark, []), {}, NOW).first()
    assert tuple(counted) == (0, 0)


def test_before_the_epoch(spark):
    old = dt.datetime(1969, 12, 31, 23, 30, 0, 500)
    logs = make(spark, [(1, old)])
    span = {"startDate": old - dt.timedelta(hours=1), "endDate": old}
    point = aggregates.chart(logs, span, NOW).first()
    assert point["ts"] == -3_600_000 and point["error"] == 1
    cursors = paging.page_cursors(logs).first()
    assert cursors["next_cursor"] == to_ms(old) == -1_800_000


def test_request_to_report_matches_its_parts(logs):
    params = {
        "severity": "0,3",
        "timestamp": f"{to_ms(dt.datetime(2024, 1, 8))}-{to_ms(dt.datetime(2024, 1, 25))}",
        "cursor": str(to_ms(dt.datetime(2024, 1, 20))),
        "size": "5",
    }
    request = explore.read_request(params, NOW)
    hours = hourly(logs)
    for rolled in (None, hours):
        reply = explore.respond(logs, request, rolled)
        rows = paging.page(logs, 5, request.filters, request.cursor).collect()
        assert [r["id"] for r in reply["data"]] == [r["row_id"] for r in rows]
        counted = aggregates.counts(logs, request.filters, request.cursor).first()
        assert reply["filterRowCount"] == counted["filtered_count"]
        assert reply["totalRowCount"] == counted["total_count"]
        chart = aggregates.chart(logs, request.filters, request.cursor).collect()
        assert reply["chartData"] == [row.asDict() for row in chart]
        facets = {(f, r["value"]): r["total"] for f, rs in reply["facets"].items() for r in rs}
        long = aggregates.facets(logs, request.filters).collect()
        assert facets == {(r["field"], r["value"]): r["total"] for r in long}
        assert reply["nextCursor"] == to_ms(rows[-1]["timestamp"])
        assert reply["prevCursor"] == to_ms(rows[0]["timestamp"])


def test_totals_agree_across_operators(logs):
    given = {"hostname": "host-2"}
    n = logs.filter(where(logs, given)).count()
    by_field = {}
    for row in aggregates.facets(logs, given).collect():
        by_field[row["field"]] = by_field.get(row["field"], 0) + row["total"]
    assert by_field == {"severity": n, "facility": n}
    span = {**given, "startDate": dt.datetime(2024, 1, 1), "endDate": NOW}
    for unit in ("hour", "day", "week", "month"):
        points = aggregates.chart(logs, span, NOW, unit).collect()
        assert sum(sum(row[1:]) for row in points) == n
        assert [p["ts"] for p in points] == sorted(p["ts"] for p in points)


CUTS = [
    (None, None),
    (dt.datetime(2024, 1, 5, 3, 20), None),
    (None, dt.datetime(2024, 1, 9, 4, 59, 59, 999999)),
    (dt.datetime(2024, 1, 5, 3), dt.datetime(2024, 1, 5, 4)),
    (dt.datetime(2024, 1, 5, 3, 10), dt.datetime(2024, 1, 5, 3, 50)),
    (dt.datetime(2024, 1, 5, 3, 10), dt.datetime(2024, 1, 5, 4, 10)),
    (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25, 0, 0, 0, 1)),
    (dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 5)),
]


@pytest.mark.parametrize("start, end", CUTS)
def test_rollup_counts_equal_the_scan(logs, start, end):
    given = {"severity": [1, 2, 5], "startDate": start, "endDate": end}
    for direction in ("next", "prev"):
        cursor = dt.datetime(2024, 1, 15, 7, 7, 7)
        want = aggregates.counts(logs, given, cursor, direction).first()
        got = rollup.counts(hourly(logs), logs, given, cursor, direction).first()
        assert tuple(got) == tuple(want)
    if start and end:
        for unit in ("hour", "week"):
            want = aggregates.chart(logs, given, NOW, unit).collect()
            assert rollup.chart(hourly(logs), logs, given, NOW, unit).collect() == want


def test_rollup_refuses_filters_it_has_no_column_for(logs):
    assert not rollup.covers({"hostname": "h"})
    with pytest.raises(ValueError):
        rollup.facets(hourly(logs), {"hostname": "h"})


def test_summary_is_one_scan(logs):
    request = explore.read_request({"severity": "1"}, NOW)
    df = explore.summary(logs, request)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Expand" not in plan


def test_unknown_code_keeps_its_row(spark):
    logs = make(spark, [(1, T, {"severity": 9}), (2, T)])
    rows = {r["row_id"]: r for r in enrich.with_labels(logs).collect()}
    assert rows[1]["severity_name"] is None and rows[1]["facility_name"] == "User"
    assert rows[2]["severity_name"] == "error" and rows[2]["priority"] == 11


def test_structured_data_maps(spark):
    texts = ["-", "", "{bad", "[1]", '{"b":{"y":"1"},"a":{}}', '{"a":1}']
    logs = make(spark, [(i, T, {"structured_data": t}) for i, t in enumerate(texts)])
    rows = {r["id"]: r["structuredData"] for r in paging.project(logs).collect()}
    assert rows == {**dict.fromkeys(range(6)), 4: {"b": {"y": "1"}, "a": {}}}
    lines = {r["row_id"]: r["structured_text"] for r in enrich.sd_text(logs).collect()}
    assert lines == {**dict.fromkeys(range(6), "-"), 4: "b:{y=1}, a:{}"}
    assert [tuple(r) for r in enrich.sd_rows(logs).collect()] == [(4, "b", "y", "1")]


def test_session_time_zone_does_not_matter(spark, logs):
    span = {"startDate": dt.datetime(2024, 1, 3), "endDate": dt.datetime(2024, 1, 20, 5, 30)}

    def parts():
        found = [aggregates.chart(logs, span, NOW, u).collect() for u in ("hour", "week", "month")]
        found.append(rollup.chart(hourly(logs), logs, span, NOW, "day").collect())
        return found + [paging.page_cursors(paging.page(logs, 5)).collect()]

    want = parts()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert parts() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

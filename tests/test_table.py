import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from logstrata.operators import paging
from logstrata.plans import explore, walk
from logstrata.schema import ENTRY_COLUMNS
from logstrata.sources import files, lines, table

NOW = dt.datetime(2024, 1, 31)
DAY = dt.timedelta(days=1)


def line(ts, text="x"):
    return f"<11>1 {ts.isoformat()}Z host app 1 ID - {text}"


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def content(df):
    return sorted(tuple(r) for r in df.select(ENTRY_COLUMNS).collect())


def messages(spark, root):
    return sorted(r["msg"] for r in table.read_logs(spark, root).collect())


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def test_nothing_written_yet(spark, root):
    assert table.read_logs(spark, root).count() == 0
    assert table.read_rejects(spark, root).count() == 0
    assert table.read_rollup(spark, root).count() == 0
    assert table.retain(spark, root, NOW, 1) == 0


def test_write_splits_entries_and_rejects(spark, root):
    texts = [line(NOW, "a"), "junk", line(NOW - DAY, "b"), " "]
    table.write_batch(frame(spark, texts), root, 0, NOW)
    assert messages(spark, root) == ["a", "b"]
    rejected = table.read_rejects(spark, root).collect()
    assert [(r["line"], r["format"], r["reason"], r["dt"]) for r in rejected] == [
        ("junk", "auto", "format", NOW.date())
    ]
    assert table.log_days(spark, root) == [(NOW - DAY).date(), NOW.date()]


def test_retried_batch_replaces_itself(spark, root):
    table.write_batch(frame(spark, [line(NOW, "a")]), root, 0, NOW)
    table.write_batch(frame(spark, [line(NOW, "b"), line(NOW - DAY, "c"), "junk"]), root, 1, NOW)
    table.write_batch(frame(spark, [line(NOW, "b")]), root, 1, NOW)
    assert messages(spark, root) == ["a", "b"]
    assert table.read_rejects(spark, root).count() == 0
    assert table.read_rollup(spark, root).agg(F.sum("total")).first()[0] == 2


def test_row_ids_are_unique_across_tasks_and_batches(spark, root, logs):
    raw = fx.raw_5424(logs).select("line")
    for batch in (0, 1, 10**6):
        table.write_batch(raw.repartition(7), root, batch, NOW)
    ids = table.read_logs(spark, root).select("row_id")
    assert ids.distinct().count() == ids.count() == 3 * logs.count()
    assert ids.filter("row_id.position < 0").count() == 0
    assert {r[0] for r in ids.select("row_id.ingest_batch").distinct().collect()} == {0, 1, 10**6}


@pytest.mark.parametrize("position", [0, 2**31 << 31, 2**63 - 1])
def test_pages_by_row_ids_of_any_size(spark, position):
    """Ties are walked by (batch, position), whatever their size."""
    places = [(b, p) for b in (0, 10**6, 2**62) for p in sorted({0, 5, position})]
    logs = spark.createDataFrame([((b, p), NOW) for b, p in places],
        "row_id struct<ingest_batch: bigint, position: bigint>, timestamp timestamp_ntz")
    for name in paging.PAGE_COLUMNS:
        if name not in logs.columns:
            logs = logs.withColumn(name, F.lit("1"))
    seen, after = [], None
    while rows := paging.page_stable(logs, 2, {}, after).collect():
        seen += [tuple(row["row_id"]) for row in rows]
        after = (rows[-1]["timestamp"], rows[-1]["row_id"])
    assert seen == sorted(places, reverse=True)


def test_a_long_line_is_stored(spark, root):
    text = "x" * (2 << 20)
    table.write_batch(frame(spark, [line(NOW, text)]), root, 0, NOW)
    assert messages(spark, root) == [text]


def totals(spark, root):
    return table.read_rollup(spark, root).agg(F.sum("total")).first()[0] or 0


def stop_at(monkeypatch, wanted):
    """A crash before the wanted call of an operation on folders."""
    for name in ("delete", "create"):
        real = getattr(files, name)

        def stop(spark, path, name=name, real=real):
            if wanted(name, path):
                raise KeyboardInterrupt
            real(spark, path)

        monkeypatch.setattr(files, name, stop)


def test_merge_that_stopped_half_way(spark, root):
    """A folder that Spark did not finish is not read, and written again."""
    for batch in range(3):
        table.write_batch(frame(spark, [line(NOW, str(batch)), "junk"]), root, batch, NOW)
    day = f"{root}/outcome=logs/dt={NOW.date()}"
    table.compact_day(spark, root, NOW.date())
    files.delete(spark, f"{day}/span=0-2-1/_SUCCESS")
    assert messages(spark, root) == ["0", "1", "2"]
    table.compact_day(spark, root, NOW.date())
    assert messages(spark, root) == ["0", "1", "2"]
    table.upkeep(spark, root)
    assert [f.rsplit("=")[-1] for f in files.matching(spark, f"{day}/span=*")] == ["0-2-1"]
    assert messages(spark, root) == ["0", "1", "2"] and totals(spark, root) == 3


def test_upkeep_that_stopped_half_way(spark, root, monkeypatch):
    for batch in range(4):
        table.write_batch(frame(spark, [line(NOW, str(batch))]), root, batch, NOW)
    table.compact_day(spark, root, NOW.date())
    table.compact_rollup(spark, root)
    for gone in range(4):
        with monkeypatch.context() as patch:
            left = iter(range(gone))
            stop_at(patch, lambda name, path: "span=" in path and next(left, None) is None)
            with pytest.raises(KeyboardInterrupt):
                table.upkeep(spark, root)
        assert messages(spark, root) == ["0", "1", "2", "3"] and totals(spark, root) == 4


def test_compaction_before_a_retry(spark, root):
    texts = [line(NOW, str(i)) for i in range(10)]
    table.write_batch(frame(spark, texts), root, 0, NOW)
    table.compact_day(spark, root, NOW.date())
    table.write_batch(frame(spark, texts), root, 0, NOW)
    assert len(messages(spark, root)) == totals(spark, root) == 10
    ids = {tuple(r["row_id"]) for r in table.read_logs(spark, root).collect()}
    assert {batch for batch, _ in ids} == {0} and len(ids) == 10
    table.write_batch(frame(spark, texts), root, 1, NOW)
    table.compact_day(spark, root, NOW.date())
    table.compact_rollup(spark, root)
    table.write_batch(frame(spark, texts), root, 1, NOW)
    assert len(messages(spark, root)) == totals(spark, root) == 20
    assert ids < {tuple(r["row_id"]) for r in table.read_logs(spark, root).collect()}


def test_batch_that_crashed_between_its_tables(spark, root, monkeypatch):
    table.write_batch(frame(spark, [line(NOW, "a")]), root, 0, NOW)
    with monkeypatch.context() as patch:
        patch.setattr(table, "hourly", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.write_batch(frame(spark, [line(NOW, "b"), "junk"]), root, 1, NOW)
    table.write_batch(frame(spark, [line(NOW, "b"), "junk"]), root, 1, NOW)
    assert messages(spark, root) == ["a", "b"] and totals(spark, root) == 2
    assert table.read_rejects(spark, root).count() == 1


def test_retention_stopped_half_way(spark, root, monkeypatch):
    old, new = NOW - 9 * DAY, NOW - dt.timedelta(minutes=5)
    texts = [line(old, "a")] * 3 + [line(NOW - dt.timedelta(minutes=70), "b"), line(new, "c")]
    table.write_batch(frame(spark, texts), root, 0, NOW)
    with monkeypatch.context() as patch:
        stop_at(patch, lambda name, path: name == "create")
        with pytest.raises(KeyboardInterrupt):
            table.retain(spark, root, NOW, 60)
    assert messages(spark, root) == ["a"] * 3 + ["b", "c"] and totals(spark, root) == 5
    assert table.retain(spark, root, NOW, 60) == 4
    assert messages(spark, root) == ["c"] and totals(spark, root) == 1
    for part in ("_retained", "dt="):
        with monkeypatch.context() as patch:
            stop_at(patch, lambda name, path: name == "delete" and part in path)
            with pytest.raises(KeyboardInterrupt):
                table.retain(spark, root, NOW + dt.timedelta(seconds=30), 60)
        assert messages(spark, root) == ["c"] and totals(spark, root) == 1
    assert table.retain(spark, root, NOW + dt.timedelta(seconds=60), 60) == 0
    table.retain(spark, root, NOW + dt.timedelta(seconds=90), 60)
    assert not files.matching(spark, f"{root}/outcome=logs/dt={old.date()}/span=*")
    assert len(files.matching(spark, f"{root}/_retained/*")) == 1


def test_a_reader_during_retention_and_upkeep_keeps_its_rows(spark, root, monkeypatch):
    """What a reader has planned to read stays there until the upkeep after the next."""
    edge = NOW - dt.timedelta(minutes=90)
    for batch in range(3):
        texts = [line(NOW - 9 * DAY, f"old{batch}"), line(edge, f"edge{batch}"), line(NOW, f"new{batch}")]
        table.write_batch(frame(spark, texts), root, batch, NOW)
    reader, hours = table.read_logs(spark, root), table.read_rollup(spark, root)
    monkeypatch.setattr(table, "FAN", 3)
    monkeypatch.setattr(table, "TAIL", 1)
    assert table.retain(spark, root, NOW, 60) == 6
    table.upkeep(spark, root)
    table.compact_day(spark, root, NOW.date())
    assert reader.count() == hours.agg(F.sum("total")).first()[0] == 9
    assert messages(spark, root) == ["new0", "new1", "new2"] and totals(spark, root) == 3
    # A late row before the cutoff stays until the next retention.
    table.write_batch(frame(spark, [line(edge, "late"), line(NOW - 9 * DAY, "old")]), root, 3, NOW)
    table.upkeep(spark, root)
    table.upkeep(spark, root)
    assert messages(spark, root) == ["late", "new0", "new1", "new2", "old"]
    assert totals(spark, root) == 5
    assert table.retain(spark, root, NOW, 60) == 2
    assert messages(spark, root) == ["new0", "new1", "new2"] and totals(spark, root) == 3


def test_rollup_counts_the_hour_of_the_cutoff_again(spark, root, monkeypatch):
    monkeypatch.setattr(table, "TAIL", 0)
    minutes = [dt.timedelta(minutes=m) for m in range(0, 180, 10)]
    for batch in range(2):
        table.write_batch(frame(spark, [line(NOW - m, "x") for m in minutes]), root, batch, NOW)
    for step in (0, 5, 15, 30, 60, 61):
        now = NOW + dt.timedelta(minutes=step)
        table.retain(spark, root, now, 95)
        if step % 2:
            table.upkeep(spark, root)
        want = {}
        for row in table.hourly(table.read_logs(spark, root)).collect():
            want[tuple(row)[:3]] = row["total"]
        got = table.read_rollup(spark, root).groupBy("hour", "severity", "facility")
        assert {tuple(r)[:3]: r["n"] for r in got.agg(F.sum("total").alias("n")).collect()} == want
        assert sum(want.values()) == 2 * sum(NOW - m >= now - dt.timedelta(minutes=95) for m in minutes)


def test_upkeep_leaves_few_files(spark, root):
    """After 50 batches the rollup has one file a day and a short tail."""
    for batch in range(50):
        texts = [line(NOW, f"{batch}"), line(NOW - DAY, f"{batch}"), "junk"]
        table.write_batch(frame(spark, texts).coalesce(1), root, batch, NOW)
        if batch % 8 == 7:
            table.upkeep(spark, root)
    table.upkeep(spark, root)
    for day in (NOW, NOW - DAY):
        folders = files.matching(spark, f"{root}/rollup/dt={day.date()}/span=*")
        files_of = files.matching(spark, f"{root}/rollup/dt={day.date()}/span=*/*.parquet")
        assert len(files_of) == len(folders) <= 1 + table.TAIL
        assert len(files.matching(spark, f"{root}/outcome=logs/dt={day.date()}/span=*")) <= 50 - 32 + 1
    assert totals(spark, root) == len(messages(spark, root)) == 100
    assert table.read_rejects(spark, root).count() == 50


def test_absent_values_skip_row_groups(spark, root):
    """Values that no row group has are not read, although they lie between others."""
    texts = [f"<11>1 {NOW.isoformat()}Z host{i} app{i} {i} ID{i} - x" for i in range(0, 60_000, 2)]
    table.write_batch(frame(spark, texts).coalesce(1), root, 0, NOW)

    def rows_read(column, value):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            found = table.read_logs(spark, root).filter(F.col(column) == value)
            found.collect()
            plan = found._jdf.queryExecution().executedPlan()
            leaf = plan.collectLeaves().head()
            return leaf.metrics().get("numOutputRows").get().value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    for column, name in (("hostname", "host"), ("app_name", "app"), ("procid", ""), ("msgid", "ID")):
        assert rows_read(column, f"{name}501") == 0
        assert rows_read(column, f"{name}500") > 0


def test_clustered_write_holds_the_same_rows(spark, tmp_path, logs):
    raw = fx.raw_mixed(logs).select("line")
    for name, cluster in (("plain", False), ("clustered", True)):
        table.write_batch(raw, str(tmp_path / name), 0, NOW, cluster=cluster)
    plain, clustered = (
        content(table.read_logs(spark, str(tmp_path / n))) for n in ("plain", "clustered")
    )
    assert plain == clustered and len(plain) > 0


def test_files_are_sorted_by_time(spark, root, logs):
    raw = fx.raw_5424(logs.orderBy(F.rand(1))).select("line")
    table.write_batch(raw, root, 0, NOW)
    stored = table.read_logs(spark, root).select(
        F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), "timestamp"
    )
    rows = stored.orderBy("f", "n").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["f"] != b["f"] or a["timestamp"] <= b["timestamp"]


def test_retention_keeps_the_cutoff_row(spark, root):
    cutoff = NOW - dt.timedelta(minutes=90)
    tick = dt.timedelta(microseconds=1)
    times = {
        "old": NOW - 9 * DAY, "before": cutoff - tick, "at": cutoff, "after": cutoff + tick,
        "future": NOW + 400 * DAY,
    }
    table.write_batch(frame(spark, [line(t, n) for n, t in times.items()]), root, 0, NOW)
    assert table.retain(spark, root, NOW, 90) == 2
    assert messages(spark, root) == ["after", "at", "future"]
    assert table.read_rollup(spark, root).agg(F.sum("total")).first()[0] == 3
    assert table.retain(spark, root, NOW, 90) == 0


def test_retention_can_empty_a_day(spark, root):
    noon = dt.datetime(2024, 1, 30, 12)
    table.write_batch(frame(spark, [line(noon, "a"), line(noon + DAY, "b")]), root, 0, NOW)
    assert table.retain(spark, root, noon + dt.timedelta(minutes=61), 60) == 1
    assert messages(spark, root) == ["b"]


def test_years_beyond_python_dates(spark, root):
    texts = [
        "<11>1 0000-01-01T00:00:00Z h a 1 m - ancient",
        "<11>1 9999-12-31T23:00:00-05:00 h a 1 m - far",
        line(NOW, "now"),
    ]
    table.write_batch(frame(spark, texts), root, 0, NOW)
    days = table.log_days(spark, root)
    assert len(days) == 3
    stored = table.read_logs(spark, root).withColumn("timestamp", F.col("timestamp") + F.expr(
        "make_ym_interval(case when msg = 'far' then -100 else 0 end)"))
    assert stored.count() == 3
    assert table.retain(spark, root, NOW, 60) == 1
    assert [r["msg"] for r in table.read_logs(spark, root).select("msg").collect()].count("far") == 1


def test_compaction(spark, root, logs):
    raw = fx.raw_5424(logs).select("line")
    for batch in range(3):
        part = raw.filter(F.pmod(F.hash("line"), F.lit(3)) == batch)
        table.write_batch(part, root, batch, NOW)
    before = content(table.read_logs(spark, root))
    day = dt.date(2024, 1, 20)
    table.compact_day(spark, root, day, file_bytes=2000)
    table.compact_rollup(spark, root)
    assert content(table.read_logs(spark, root)) == before
    table.upkeep(spark, root)
    folders = files.matching(spark, f"{root}/outcome=logs/dt={day}/span=*")
    assert [f.rsplit("=", 1)[1] for f in folders] == ["0-2-1"]
    assert len(files.matching(spark, f"{folders[0]}/*.parquet")) > 1
    assert table.read_rollup(spark, root).agg(F.sum("total")).first()[0] == len(before)
    table.write_batch(frame(spark, [line(dt.datetime(2024, 1, 20), "late")]), root, 3, NOW)
    table.compact_day(spark, root, day)
    assert len(content(table.read_logs(spark, root))) == len(before) + 1


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("size", [1, 40, 100_000])
def test_page_by_days_equals_the_full_scan(spark, root, logs, ascending, size):
    table.write_batch(fx.raw_5424(logs).select("line"), root, 0, NOW)
    stored, days = table.read_logs(spark, root), table.log_days(spark, root)
    for direction in ("next", "prev"):
        request = explore.Request(
            cursor=dt.datetime(2024, 1, 20, 5),
            size=size,
            direction=direction,
            filters={"facility": [3, 4, 5], "startDate": dt.datetime(2024, 1, 4)},
            sort=("timestamp", ascending),
        )
        want = paging.page(
            stored, size, request.filters, request.cursor, direction, request.sort
        ).collect()
        assert walk.page_by_days(stored, days, request) == want
        if size == 40 and not ascending:
            rollup = table.read_rollup(spark, root)
            plain = explore.respond(stored, request)
            assert explore.respond(stored, request, rollup, days) == plain


@pytest.mark.parametrize("ascending", [True, False])
def test_the_rollup_tells_where_a_page_is_full(spark, root, logs, ascending, monkeypatch):
    table.write_batch(fx.raw_5424(logs).select("line"), root, 0, NOW)
    stored, days = table.read_logs(spark, root), table.log_days(spark, root)
    rollup = table.read_rollup(spark, root)
    scanned = []

    def page(rows, *rest):
        scanned.append(rows)
        return real(rows, *rest)

    real = paging.page
    monkeypatch.setattr(paging, "page", page)
    for size in (1, 60, 10_000):
        for direction in ("next", "prev"):
            request = explore.Request(
                cursor=dt.datetime(2024, 1, 20, 5, 30), size=size, direction=direction,
                filters={"severity": [1, 2, 3], "endDate": dt.datetime(2024, 1, 28, 7, 7)},
                sort=("timestamp", ascending),
            )
            want = real(stored, size, request.filters, request.cursor, direction, request.sort).collect()
            del scanned[:]
            assert walk.page_by_days(stored, days, request, rollup=rollup) == want
            assert len(scanned) == 1
            if size == 60:
                read = real(scanned[0], size, request.filters, request.cursor, direction, request.sort)
                plan = read._jdf.queryExecution().executedPlan().toString()
                assert "PartitionFilters: [isnotnull(dt" in plan
                opened = {r[0] for r in scanned[0].select("dt").distinct().collect()}
                assert len(opened) < len(days)


def test_a_large_page_is_written(spark, root, logs, monkeypatch):
    table.write_batch(fx.raw_5424(logs).select("line"), root, 0, NOW)
    stored = table.read_logs(spark, root)
    request = explore.Request(cursor=NOW, size=2**40)
    want = [r["row_id"] for r in stored.orderBy(*paging.ordering()).select("row_id").collect()]
    for days, rollup in ((None, None), (table.log_days(spark, root), None), (table.log_days(spark, root), table.read_rollup(spark, root))):
        data = explore.respond(stored, request, rollup, days)["data"]
        assert [r["id"] for r in data.select("id").collect()] == want


@pytest.mark.parametrize("sort", [("timestamp", False), ("hostname", True), ("row_id", True)])
def test_page_bounds_are_those_of_the_pages(spark, root, logs, sort):
    table.write_batch(fx.raw_5424(logs).select("line").repartition(3), root, 0, NOW)
    stored = table.read_logs(spark, root)
    ids = [r["row_id"] for r in walk.extract(stored, {}, sort).select("row_id").collect()]
    got = {r["page"]: tuple(r)[1:] for r in walk.page_bounds(stored, 77, {}, sort).collect()}
    pages = [ids[i : i + 77] for i in range(0, len(ids), 77)]
    assert got == {n: (len(p), p[0], p[-1]) for n, p in enumerate(pages)}
    assert walk.page_bounds(stored, 77, {"hostname": "nobody"}).collect() == []


def test_line_ends(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_bytes(b"a\r\n\r\nb\rc\n  \nd")
    got = lines.clean(lines.text_lines(spark, str(path))).collect()
    assert [r["line"] for r in got] == ["a", "b\rc", "d"]
    grams = spark.createDataFrame([(bytearray(b"a\r\nb\n\n c \n"),), (bytearray(b""),)], "value binary")
    got = lines.clean(lines.datagram_lines(grams)).collect()
    assert [r["line"] for r in got] == ["a", "b", "c"]
    kept = lines.message_lines(grams).collect()
    assert kept[0]["line"] == "a\r\nb\n\n c \n"

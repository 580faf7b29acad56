import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from logstrata.operators import paging
from logstrata.sources import lines, table
from logstrata.sources.generate import burst_lines, seed_lines, seed_slots
from logstrata.operators.parse import entries, parse
from logstrata.streaming.ingest import start_ingest
from logstrata.streaming.live import anchor, flag_past, poll, start_tail

NOW = dt.datetime(2024, 1, 31)
SECOND = dt.timedelta(seconds=1)


def line(ts, text):
    return f"<11>1 {ts.isoformat()}Z host app 1 ID - {text}\n"


def ingest(spark, folder, **options):
    stream = lines.text_lines(spark, str(folder / "in"), stream=True, maxFilesPerTrigger="1")
    query = start_ingest(
        stream, str(folder / "table"), str(folder / "check"), available_now=True, **options
    )
    query.awaitTermination()
    return query


def messages(spark, folder):
    return sorted(r["msg"] for r in table.read_logs(spark, str(folder / "table")).collect())


def test_ingest_resumes_and_counts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text(line(NOW, "a") + "junk\n" + line(NOW, "b"))
    (inbox / "2.txt").write_text(line(NOW, "c"))
    ingest(spark, tmp_path)
    assert messages(spark, tmp_path) == ["a", "b", "c"]
    (inbox / "3.txt").write_text(line(NOW + 2 * SECOND, "d"))
    ingest(spark, tmp_path)
    root = str(tmp_path / "table")
    assert messages(spark, tmp_path) == ["a", "b", "c", "d"]
    assert [r["line"] for r in table.read_rejects(spark, root).collect()] == ["junk"]
    hours = table.read_rollup(spark, root).groupBy("hour").agg(F.sum("total"))
    assert [tuple(r) for r in hours.collect()] == [(NOW, 4)]
    batches = table.read_logs(spark, root).select("ingest_batch").distinct()
    assert batches.count() == 3


def test_batch_that_crashed_before_its_commit_is_not_doubled(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text(line(NOW, "a"))
    root = str(tmp_path / "table")
    # What a first try of batch 0 left behind.
    lost = spark.createDataFrame([(line(NOW, "a"),), (line(NOW - 86400 * SECOND, "z"),)], "line string")
    table.write_batch(lost, root, 0, NOW)
    ingest(spark, tmp_path)
    assert messages(spark, tmp_path) == ["a"]


def test_receive_time_stands_in_for_a_missing_one(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text("<11>1 - h a p m - x\n<11>1 - h a p m - y\n")
    began = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ingest(spark, tmp_path)
    ended = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = table.read_logs(spark, str(tmp_path / "table")).collect()
    times = {r["timestamp"] for r in rows}
    assert len(rows) == 2 and len(times) == 1
    assert began - SECOND <= times.pop() <= ended


def test_live_poll(spark):
    rows = [(i, NOW + i * SECOND + dt.timedelta(microseconds=5)) for i in range(5)]
    logs = spark.createDataFrame(rows, "row_id long, timestamp timestamp_ntz")
    for name in paging.PAGE_COLUMNS:
        if name not in logs.columns:
            logs = logs.withColumn(name, F.lit("1"))
    page, cursor = poll(logs, NOW - SECOND, size=2)
    assert [r["row_id"] for r in page.collect()] == [4, 3]
    assert cursor == NOW + 4 * SECOND
    page, again = poll(logs, cursor, size=2)
    assert [r["row_id"] for r in page.collect()] == [4] and again == cursor
    page, same = poll(logs, NOW + 9 * SECOND, size=2)
    assert page.count() == 0 and same == NOW + 9 * SECOND
    flags = {r["row_id"]: r["is_past"] for r in flag_past(logs, NOW + SECOND).collect()}
    assert flags == {0: True, 1: True, 2: False, 3: False, 4: False}
    assert anchor(logs, NOW + SECOND).first()["row_id"] == 1


def test_live_stream_keeps_its_cursor(spark, tmp_path):
    schema = "row_id long, facility int, severity int, timestamp timestamp_ntz, " + ", ".join(
        f"{c} string" for c in paging.PAGE_COLUMNS[4:]
    )

    def put(name, moments):
        rows = [(i, 1, 2, NOW + i * SECOND, *"hapmsx") for i in moments]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def follow():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        root = str(tmp_path / "tail")
        query = start_tail(stream, root, f"{root}/check", NOW, size=2, available_now=True)
        query.awaitTermination()
        shown = spark.read.parquet(f"{root}/rows").collect()
        return sorted(r["row_id"] for r in shown)

    put("a", [0, 1, 2, 3])
    assert follow() == [2, 3]
    put("b", [1, 3, 5])
    assert follow() == [2, 3, 5]


@pytest.mark.parametrize("total, workers", [(10, 3), (2500, 2), (3, 5), (1, 1)])
def test_burst(spark, total, workers):
    rows = burst_lines(spark, total, workers, NOW, batch=1000)
    got = rows.orderBy("slot").collect()
    share, extra = divmod(total, workers)
    want = [
        (w, i % 1000) for w in range(workers) for i in range(share + (1 if w < extra else 0))
    ]
    assert [r["worker"] for r in got] == [w for w, _ in want]
    for row, (w, i) in zip(got, want):
        assert f" MSG{w}-{i} - Log message {i} from worker {w}" in row["line"]
    assert entries(parse(rows, NOW)).count() == total


def test_seed(spark):
    slots = seed_slots(spark, NOW.date(), days=5)
    rows = seed_lines(slots)
    taken = entries(parse(rows.drop("timestamp"), NOW)).cache()
    n = rows.count()
    assert taken.count() == n and 500 <= n <= 5000
    per_day = taken.groupBy(F.to_date("timestamp")).count().collect()
    assert len(per_day) == 5 and all(100 <= r[1] <= 1000 for r in per_day)
    assert taken.join(rows.select("slot", F.col("timestamp").alias("t")), "slot").filter(
        "t <> timestamp"
    ).count() == 0
    assert taken.select("severity").distinct().count() == 8
    assert taken.select("facility").distinct().count() == 20
    assert taken.select("app_name").distinct().count() == 10
    assert slots.select("slot").distinct().count() == slots.count()


def test_expired_rows_go_when_a_job_runs_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("<11>1 2021-01-01T00:00:00Z h a p m - old\n<11>1 - h a p m - new\n")
    now = dt.datetime(2024, 1, 20)
    for minutes, want in ((0, ["new", "old"]), (1, ["new"])):
        query = start_ingest(
            lines.text_lines(spark, str(tmp_path / "in"), stream=True), str(tmp_path / "table"),
            str(tmp_path / "check"), now=now + dt.timedelta(minutes=minutes),
            retention_minutes=43200, available_now=True,
        )
        query.awaitTermination()
        assert messages(spark, tmp_path) == want


def test_an_idle_stream_deletes_expired_rows(spark, tmp_path):
    """Rows expire while a running stream gets no input."""
    inbox, root = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    soon = now - dt.timedelta(seconds=60 - 25)
    (inbox / "1.txt").write_text(line(soon, "expires") + line(now + dt.timedelta(days=1), "stays"))
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "500ms")
    query = start_ingest(
        lines.text_lines(spark, str(inbox), stream=True), root, str(tmp_path / "check"),
        retention_minutes=1, retention_every=SECOND,
    )
    try:
        seen = []
        for _ in range(120):
            query.processAllAvailable()
            seen.append(messages(spark, tmp_path))
            if seen[-1] == ["stays"]:
                break
            time.sleep(0.5)
        assert ["expires", "stays"] in seen and seen[-1] == ["stays"]
        assert query.lastProgress["batchId"] <= 1
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")


def test_upkeep_of_a_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(20):
        (inbox / f"{i}.txt").write_text(line(NOW, f"{i:02}") + "junk\n")
    ingest(spark, tmp_path)
    assert messages(spark, tmp_path) == [f"{i:02}" for i in range(20)]
    root = str(tmp_path / "table")
    assert table.read_rollup(spark, root).agg(F.sum("total")).first()[0] == 20
    from logstrata.sources import files

    folders = files.matching(spark, f"{root}/rollup/dt=*/span=*")
    assert any(f.endswith("-1") for f in folders)


def test_few_live_states_are_kept(spark, tmp_path):
    from logstrata.sources import files
    from logstrata.streaming import live

    root = str(tmp_path / "tail")
    for number in range(12):
        live._cursor_before(spark, root, number)
        state = spark.createDataFrame([(NOW + number * SECOND,)], "cursor timestamp_ntz")
        state.coalesce(1).write.parquet(f"{root}/state/batch={number}")
    assert live._cursor_before(spark, root, 12) == NOW + 11 * SECOND
    assert len(files.matching(spark, f"{root}/state/batch=*")) <= 4

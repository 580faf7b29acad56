import datetime as dt
import json

from logstrata.operators.parse import MAX_LINE_BYTES, entries, log_format, parse, rejects

NOW = dt.datetime(2025, 1, 5, 12)
AT = dt.datetime(2023, 10, 1, 12, 34, 56)


def run(spark, lines, fmt="auto", now=NOW, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    parsed = parse(df, now, fmt, **options)
    taken = {row["n"]: row for row in entries(parsed).collect()}
    left = {row["n"]: row for row in rejects(parsed).collect()}
    assert not taken.keys() & left.keys()
    return taken, left


def values(row):
    return tuple(row)[1:]


GOLDEN = [
    (
        "<13>1 2023-10-01T12:34:56Z example-host example-app 1234 5678 - Test log message",
        (5, 1, 1, AT, "example-host", "example-app", "1234", "5678", "-", "Test log message"),
    ),
    (
        '<165>1 2023-10-01T12:34:56Z host1 app1 2345 ID01 [exampleSDID@32473 iut="3" '
        'eventSource="Application"] Message with structured data',
        (
            5, 20, 1, AT, "host1", "app1", "2345", "ID01",
            '{"exampleSDID@32473":{"eventSource":"Application","iut":"3"}}',
            "Message with structured data",
        ),
    ),
    (
        "<0>1 2023-10-01T12:34:56Z host2 kernel 0 - - Kernel panic - not syncing",
        (0, 0, 1, AT, "host2", "kernel", "0", "-", "-", "Kernel panic - not syncing"),
    ),
    (
        "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8",
        (
            2, 4, 1, dt.datetime(2025, 10, 11, 22, 14, 15), "mymachine", "su", "-", "-", "-",
            "'su root' failed for lonvick on /dev/pts/8",
        ),
    ),
    (
        "<190>Nov  6 09:01:02 esphome-device esphome[1234]: Sensor reading: 42",
        (
            6, 23, 1, dt.datetime(2025, 11, 6, 9, 1, 2), "esphome-device", "esphome", "1234",
            "-", "-", "Sensor reading: 42",
        ),
    ),
    (
        "<134>Feb  1 11:37:00 modbus-ble-bridge mdns: [C][mdns:124]: mDNS:\n\n  Hostname: x",
        (
            6, 16, 1, dt.datetime(2025, 2, 1, 11, 37), "modbus-ble-bridge", "mdns", "-", "-",
            "-", "[C][mdns:124]: mDNS:\n\n  Hostname: x",
        ),
    ),
    (
        "<34>Dec 31 23:59:59 testhost app: Year boundary test",
        (
            2, 4, 1, dt.datetime(2024, 12, 31, 23, 59, 59), "testhost", "app", "-", "-", "-",
            "Year boundary test",
        ),
    ),
]


def test_golden_lines(spark):
    taken, left = run(spark, [line for line, _ in GOLDEN])
    assert not left
    for n, (_, want) in enumerate(GOLDEN):
        assert values(taken[n]) == want


def test_each_format_takes_only_its_own_lines(spark):
    lines = [line for line, _ in GOLDEN]
    taken, left = run(spark, lines, "rfc5424")
    assert sorted(taken) == [0, 1, 2] and sorted(left) == [3, 4, 5, 6]
    assert {row["format"] for row in left.values()} == {"rfc5424"}
    taken, left = run(spark, lines, "RFC3164 ")
    assert sorted(taken) == [3, 4, 5, 6] and sorted(left) == [0, 1, 2]
    assert log_format("nonsense") == "auto"


BAD_3164 = [
        ("<192>Oct 11 22:14:15 mymachine su: test", "priority"),
        ("<999>Oct 11 22:14:15 mymachine su: test", "priority"),
        ("<34>Invalid 99 99:99:99 mymachine su: test", "format"),
        ("<34>Inv 99 99:99:99 mymachine su: test", "timestamp"),
        ("<34>Feb 30 10:00:00 h su: test", "timestamp"),
        ("<34>Oct 0 10:00:00 h su: test", "timestamp"),
        ("<34>Oct 11 24:00:00 h su: test", "timestamp"),
        ("<34>Oct 11 10:60:00 h su: test", "timestamp"),
        ("<34>Oct 11 10:00:60 h su: test", "timestamp"),
        ("<34>Oct\t11 10:00:00 h su: test", "timestamp"),
        ("<34>Oct 11 10:00:00 h no tag here", "format"),
        ("<34>Oct 11\n10:00:00 h su: test", "timestamp"),
        ("no syslog at all", "format"),
        ("\x01", "format"),
]


def test_rejected_rfc3164(spark):
    taken, left = run(spark, [line for line, _ in BAD_3164])
    assert not taken
    assert [tuple(left[n])[1:] for n in sorted(left)] == [
        (line, "auto", reason) for line, reason in BAD_3164
    ]


BAD_5424 = [
        ("<192>1 - h a p m - x", "format"),
        ("<01>1 - h a p m - x", "format"),
        ("<1>0 - h a p m - x", "format"),
        ("<1>1234 - h a p m - x", "format"),
        ("<1>1 2024-02-30T00:00:00Z h a p m - x", "timestamp"),
        ("<1>1 2024-13-01T00:00:00Z h a p m - x", "timestamp"),
        ("<1>1 2024-01-01T24:00:00Z h a p m - x", "format"),
        ("<1>1 2024-01-01T00:00:00 h a p m - x", "format"),
        ("<1>1 2024-01-01T00:00:00.1234567Z h a p m - x", "format"),
        ("<1>1 - " + "h" * 256 + " a p m - x", "format"),
        ("<1>1 - h " + "a" * 49 + " p m - x", "format"),
        ("<1>1 - h a " + "p" * 129 + " m - x", "format"),
        ("<1>1 - h a p " + "m" * 33 + " - x", "format"),
        ("<1>1 - hé a p m - x", "format"),
        ("<1>1 - h a p m", "format"),
        ("<1>1 - h a p m x", "structured data"),
        ("<1>1 - h a p m -x", "structured data"),
        ('<1>1 - h a p m [a x="1] hi', "structured data"),
        ('<1>1 - h a p m [a  x="1"] hi', "structured data"),
        ('<1>1 - h a p m [a x="]"] hi', "structured data"),
        ('<1>1 - h a p m [a x="1"]hi', "structured data"),
        ('<1>1 - h a p m [a x="1"][a x="2"] hi', "structured data"),
]


def test_rejected_rfc5424(spark):
    taken, left = run(spark, [line for line, _ in BAD_5424], "rfc5424")
    assert not taken
    assert [tuple(left[n])[1:] for n in sorted(left)] == [
        (line, "rfc5424", reason) for line, reason in BAD_5424
    ]


def test_absent_parts(spark):
    taken, _ = run(spark, ["<34>1 - - - - - -", "<191>999 - h a p m -"])
    assert values(taken[0]) == (2, 4, 1, NOW, "-", "-", "-", "-", "-", "")
    assert values(taken[1])[:3] == (7, 23, 999)


def test_offsets_become_utc(spark):
    lines = [
        "<1>1 2024-01-01T00:30:00.5+01:00 h a p m - x",
        "<1>1 2024-01-01T00:30:00-05:30 h a p m - x",
    ]
    taken, _ = run(spark, lines)
    assert taken[0]["timestamp"] == dt.datetime(2023, 12, 31, 23, 30, 0, 500000)
    assert taken[1]["timestamp"] == dt.datetime(2024, 1, 1, 6)


def test_leap_day_and_time_zone(spark):
    line = "<34>Feb 29 10:00:00 h su: x"
    assert run(spark, [line])[0][0]["timestamp"] == dt.datetime(2025, 3, 1, 10)
    leap = run(spark, [line], now=dt.datetime(2024, 3, 1))[0][0]["timestamp"]
    assert leap == dt.datetime(2024, 2, 29, 10)
    # In New York it is still December, so the year is the old one throughout.
    eve = dt.datetime(2025, 1, 1, 2)
    lines = ["<34>Dec 31 20:00:00 h su: x", "<34>Jul  1 20:00:00 h su: x"]
    taken, _ = run(spark, lines, now=eve, tz="America/New_York")
    assert taken[0]["timestamp"] == dt.datetime(2025, 1, 1, 1)
    assert taken[1]["timestamp"] == dt.datetime(2024, 7, 2, 0)


def test_pid_and_spacing(spark):
    lines = [
        "<34>Oct  1 10:00:00\th \t su[a b\nc]:\n  x  ",
        "<34>Oct 01 10:00:00 h su[1]:",
        "<34>Oct   1 10:00:00 [::1] a/b.c-d_e: [x]: y",
    ]
    taken, left = run(spark, lines)
    assert not left
    assert (taken[0]["procid"], taken[0]["msg"]) == ("a b\nc", "x")
    assert (taken[1]["procid"], taken[1]["msg"]) == ("1", "")
    assert (taken[2]["hostname"], taken[2]["app_name"]) == ("[::1]", "a/b.c-d_e")
    assert taken[2]["msg"] == "[x]: y"


def test_structured_data_text(spark):
    line = (
        r'<1>1 - h a p m [b y="2" x="1" y="3"][a q="\"\]\\\n <&>'
        + chr(0x2028)
        + '"][c] [not data] x'
    )
    taken, _ = run(spark, [line])
    text = taken[0]["structured_data"]
    quoted = '"]\\\\n <&>'.replace("\\\\", "\\" * 2) + chr(0x2028)
    want = {"a": {"q": quoted}, "b": {"x": "1", "y": "3"}, "c": {}}
    assert json.loads(text) == want
    assert list(json.loads(text)) == ["a", "b", "c"]
    escapes = "".join("\\u%04x" % ord(c) for c in "<&>" + chr(0x2028))
    assert escapes in text and "<" not in text
    assert taken[0]["msg"] == "[not data] x"


def test_plain_and_general_structured_data_agree(spark):
    import random

    from pyspark.sql import functions as F

    from logstrata.functions import structured_data as sd

    rng = random.Random(7)
    names = ["a", "a-b", "a.b", "ab", "A", "a~", "b", "z#"]
    texts = []
    for _ in range(300):
        ids = rng.sample(names, rng.randint(1, 4))
        texts.append(
            "".join(
                f"[{i}"
                + "".join(
                    f' {k}="{rng.choice(["", "1", "x y", "[=:", "caf" + chr(233)])}"'
                    for k in rng.choices(names, k=rng.randint(0, 4))
                )
                + "]"
                for i in ids
            )
        )
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = df.select("t", sd.pieces(F.col("t")).alias("p"), sd.split_elements(F.col("t")).alias("e"))
    rows = df.select(
        "t", sd.pieces_to_json(F.col("p")).alias("fast"), sd.to_json_text(F.col("e")).alias("slow")
    ).collect()
    fast = [r for r in rows if r["fast"] is not None]
    assert len(fast) > 100
    assert [r for r in fast if r["fast"] != r["slow"]] == []


def test_white_space_and_blank_lines(spark):
    taken, left = run(spark, [None, " \u3000\t", "\u00a0<1>1 - h a p m - x \x85\r"])
    assert list(taken) == [2] and not left
    assert taken[2]["msg"] == "x"


def test_line_limit(spark):
    head = "<1>1 - h a p m - "
    fits = head + "x" * (2**20 - 1 - len(head))
    taken, left = run(spark, [fits, fits + "x"], max_bytes=MAX_LINE_BYTES)
    assert taken[0]["msg"] == fits[len(head):]
    assert left[1]["reason"] == "too long" and left[1]["line"] == fits + "x"
    taken, left = run(spark, [fits + "x"])
    assert not left and len(taken[0]["msg"]) == len(fits) + 1 - len(head)


def test_hostile_lines_do_not_kill_the_executor(spark):
    head = "<1>1 - h a p m "
    lines = [
        head + '[a x="' + "y" * 1_000_000 + '"] m',
        head + "[a" + "".join(f' k{i}="v"' for i in range(20_000)) + "] m",
        head + "[a" + ' k="v"' * 20_000 + "] m",
        head + '[a x="' + '\\"' * 20_000 + '"] m',
        head + "".join(f'[e{i} k="v"]' for i in range(5_000)) + " m",
        head + '[a x="' + "y" * 1_000_000,
        head + '[a x="' + "\\" * 99_999 + '"] m',
        "<34>Oct 11 10:00:00 h" + " " * 500_000 + "su[" + "[" * 500_000,
        "<34>Oct 11 10:00:00 " + "h" * 1_000_000,
        "x" + " " * 1_000_000 + "x",
    ]
    taken, left = run(spark, lines)
    assert sorted(taken) == [0, 1, 2, 3, 4] and sorted(left) == [5, 6, 7, 8, 9]
    assert len(json.loads(taken[1]["structured_data"])["a"]) == 20_000
    assert json.loads(taken[2]["structured_data"]) == {"a": {"k": "v"}}
    assert len(json.loads(taken[4]["structured_data"])) == 5_000


def test_session_time_zone_does_not_matter(spark):
    lines = [line for line, _ in GOLDEN]
    want, _ = run(spark, lines)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got, _ = run(spark, lines)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_no_python_worker_and_one_pass(spark):
    df = spark.range(10).selectExpr("cast(id as string) as line")
    plan = entries(parse(df, NOW))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("split(regexp_replace(line") <= 2

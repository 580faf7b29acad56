"""Generated RFC 5424 lines: a varied seed set and a uniform burst.

Both are functions of a row number, so a lost task writes the same lines
again and any number of tasks can share the work.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.time import utc

# The pools the seed lines draw from.
FACILITIES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 16, 17, 18, 19, 20, 21, 22, 23]
APPS = [
    "nginx",
    "postgresql",
    "mongodb",
    "redis",
    "api-server",
    "auth-service",
    "user-service",
    "payment-service",
    "notification-service",
    "background-worker",
]
HOSTS = [
    "prod-web-01",
    "prod-web-02",
    "prod-db-01",
    "prod-cache-01",
    "staging-web-01",
    "staging-db-01",
    "dev-server-01",
]
USERS = ["alice", "bob", "charlie", "dave", "eve", "frank", "grace", "henry"]
STRUCTURED_DATA = [
    "-",
    '[exampleSDID@32473 iut="3" eventSource="Application" eventID="%d"]',
    '[origin@6875 ip="%s" port="%d"]',
    '[meta@1234 version="1.1" timestamp="%s"]',
]
MESSAGES = [
    "User %s logged in successfully",
    "Failed login attempt for user %s from IP %s",
    "Database connection error: %s",
    "API request completed in %dms",
    "Cache miss for key: %s",
    "Memory usage at %d%%",
    "CPU load average: %d",
    "Disk space warning: %d%% used on /dev/%s",
    "Background job %s completed in %ds",
    "Service %s restarted successfully",
    "New user registered: %s",
    "Payment processed: $%d.%d",
    "Email sent to %s",
    "Config changed: %s = %s",
    "Security alert: %s",
]

# Size of the seed set.
SEED_DAYS = 60
SEED_PER_DAY = (100, 1000)

#: Hex digits per draw; 16**7 values, far more than any pool has.
_DIGITS = 7
_PER_HASH = 4

#: Draws a seed line takes, by name, in order.
DRAWS = (
    ["second", "facility", "severity", "host", "app", "proc", "msgid"]
    + ["data", "data_number", "ip1", "ip2", "ip3", "ip4", "message"]
    + [f"{part}{i}" for i in (1, 2) for part in ("number", "kind", "user", "service")]
    + [f"word{i}_ip{j}" for i in (1, 2) for j in (1, 2, 3, 4)]
)


def _raw_draws() -> list[Column]:
    """A column per draw, each a slice of one of the row's hashes.

    They are columns so that a draw used in many branches is decoded once.
    """
    columns = []
    for index, name in enumerate(DRAWS):
        hashed, part = divmod(index, _PER_HASH)
        digits = F.substring(F.col(f"_hash{hashed}"), part * _DIGITS + 1, _DIGITS)
        columns.append(F.conv(digits, 16, 10).cast("long").alias(f"_{name}"))
    return columns


def draw(name: str, low: int, high: int) -> Column:
    """Number in low..high."""
    return F.col(f"_{name}") % (high - low + 1) + low


def _choice(name: str, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(name, 0, len(values) - 1))


def _address(prefix: str) -> Column:
    parts = [draw(f"{prefix}{i}", 1 if i == 1 else 0, 255) for i in (1, 2, 3, 4)]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def _word(i: int) -> Column:
    service = F.concat(F.lit("service_"), draw(f"service{i}", 1, 100).cast("string"))
    kind = draw(f"kind{i}", 0, 2)
    return (
        F.when(kind == 0, _choice(f"user{i}", USERS))
        .when(kind == 1, _address(f"word{i}_ip"))
        .otherwise(service)
    )


def _filled(template: str, words: list[Column], numbers: list[Column]) -> Column:
    """A template with its markers replaced, as one concatenation."""
    words, numbers = list(words), list(numbers)
    parts = []
    for piece in re.split(r"(%s|%d)", template):
        if piece == "%s":
            parts.append(words.pop(0))
        elif piece == "%d":
            parts.append(numbers.pop(0).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _one_of(name: str, columns: list[Column]) -> Column:
    which = draw(name, 0, len(columns) - 1)
    chosen = F.when(which == 0, columns[0])
    for i, column in enumerate(columns[1:], 1):
        chosen = chosen.when(which == i, column)
    return chosen


def seed_slots(
    spark: SparkSession, end: dt.date, days: int = SEED_DAYS, seed: int = 0
) -> DataFrame:
    """(slot, day) of a seed set: 100 to 1,000 slots for each day up to end."""
    numbered = spark.range(days).withColumn("day", F.date_sub(F.lit(end), F.col("id").cast("int")))
    return slots_of(numbered, seed)


def slots_of(days: DataFrame, seed: int = 0) -> DataFrame:
    """(slot, day) for numbered days (id, day), each of its own size."""
    low, high = SEED_PER_DAY
    drawn = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("day"), "id")), 1, 7)
    size = F.pmod(F.conv(drawn, 16, 10).cast("long"), F.lit(high - low + 1)) + low
    slots = days.select("id", "day", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("n"))
    return slots.select((F.col("id") * high + F.col("n")).alias("slot"), "day")


def seed_set(slots: DataFrame, seed: int = 0) -> DataFrame:
    """The lines of all slots in time order."""
    return seed_lines(slots, seed).orderBy("timestamp", "slot")


def seed_lines(slots: DataFrame, seed: int = 0) -> DataFrame:
    """One varied line per (slot, day), at a random second of the day."""
    hashes = -(-len(DRAWS) // _PER_HASH)
    key = F.concat_ws(":", F.lit(seed), F.col("slot"))
    df = slots.select(
        "slot",
        "day",
        *[F.md5(F.concat_ws(":", key, F.lit(i))).alias(f"_hash{i}") for i in range(hashes)],
    )
    df = df.select("slot", "day", *_raw_draws())
    facility = F.get(F.array(*[F.lit(f) for f in FACILITIES]), draw("facility", 0, 19))
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(
        secs=draw("second", 0, 24 * 60 * 60 - 1)
    )
    stamp = F.replace(at.cast("string"), F.lit(" "), F.lit("T"))
    data = _one_of(
        "data",
        [
            _filled(t, [_address("ip")], [draw("data_number", 1000, 9999)])
            for t in STRUCTURED_DATA
        ],
    )
    numbers = [draw(f"number{i}", 1, 1000) for i in (1, 2)]
    message = _one_of(
        "message", [_filled(t, [_word(1), _word(2)], numbers) for t in MESSAGES]
    )
    line = F.concat_ws(
        " ",
        F.concat(F.lit("<"), facility * 8 + draw("severity", 0, 7), F.lit(">1")),
        F.concat(stamp, F.lit(".000+00:00")),
        _choice("host", HOSTS),
        _choice("app", APPS),
        draw("proc", 1000, 9999).cast("string"),
        F.concat(F.lit("MSG"), draw("msgid", 10000, 99999).cast("string")),
        data,
        message,
    )
    return df.select("slot", at.alias("timestamp"), line.alias("line"))


def burst_lines(
    spark: SparkSession,
    total: int,
    workers: int,
    now: dt.datetime,
    *,
    batch: int = 1000,
    facility: int = 1,
    severity: int = 6,
    host: str = "localhost",
    app: str = "bench",
    proc: int = 1,
) -> DataFrame:
    """``total`` uniform lines (slot, worker, line) split over workers.

    The first ``total % workers`` workers send one line more. Message ids
    count from 0 within each batch of a worker.
    """
    share, extra = divmod(total, workers)
    slots = spark.range(0, total, 1, workers).withColumnRenamed("id", "slot")
    head = extra * (share + 1)
    worker = F.when(F.col("slot") < head, F.expr(f"slot div {share + 1}")).otherwise(
        F.expr(f"(slot - {head}) div {max(share, 1)}") + extra
    )
    first = F.when(F.col("worker") < extra, F.col("worker") * (share + 1)).otherwise(
        F.col("worker") * share + extra
    )
    df = slots.withColumn("worker", worker)
    number = ((F.col("slot") - first) % batch).cast("string")
    name = F.col("worker").cast("string")
    line = F.concat_ws(
        " ",
        F.lit(f"<{facility * 8 + severity}>1"),
        F.lit(utc(now).isoformat(timespec="milliseconds") + "Z"),
        F.lit(host),
        F.lit(app),
        F.lit(str(proc)),
        F.concat(F.lit("MSG"), name, F.lit("-"), number),
        F.lit("-"),
        F.concat(F.lit("Log message "), number, F.lit(" from worker "), name),
    )
    return df.select("slot", "worker", line.alias("line"))

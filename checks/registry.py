"""Every registered query with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import CURSOR, NOW
from logstrata.functions import structured_data as sd
from logstrata.functions.priority import facility_of, priority_of, severity_of
from logstrata.functions.time import to_ms
from logstrata.operators import aggregates, enrich, filters, paging, parse, ranges
from logstrata.plans import explore, rollup, walk
from logstrata.schema import (
    ENTRY_COLUMNS,
    FACILITY_LABELS,
    FACILITY_NAMES,
    LOG_COLUMNS,
    SEVERITY_LABELS,
    SEVERITY_NAMES,
)
from logstrata.sources import files, generate, lines, table
from logstrata.streaming import ingest, live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROW = ", ".join(paging.PAGE_COLUMNS)
ENTRY = ", ".join(ENTRY_COLUMNS)


def with_logs(sql: str) -> str:
    """SQL over the log rows."""
    return f"WITH logs AS ({fx.LOGS}) {sql}"


def query(name: str, sql: str | None, logs: bool = True) -> Callable[[Query], Query]:
    """Register a query; its SQL reads the log rows as ``logs``."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_logs(sql) if logs else sql
        return function

    return register


def log_query(name: str, sql: str) -> Callable:
    """Register a query that is a function of the log rows alone."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf: function(fx.logs(spark, sf)))
        return function

    return register


def in_table(spark: SparkSession, rows: DataFrame) -> str:
    """Raw RFC 5424 lines of the log rows, ingested into a new table."""
    root = files.scratch(spark) + "/table"
    table.write_batch(fx.raw_5424(rows).select("line"), root, 0, NOW)
    return root


# --- Sources and sinks -----------------------------------------------------

_RAW = f"SELECT {fx.RAW_5424} AS line FROM logs"


@query("src_lines", _RAW)
def src_lines(spark, sf):
    path = files.scratch(spark) + "/text"
    padded = F.concat(F.lit(" \u3000"), "line", F.lit("\t\r\n"))
    fx.raw_5424(fx.logs(spark, sf)).select(padded).write.text(path)
    return lines.clean(lines.text_lines(spark, path))


@query("src_datagrams", _RAW)
def src_datagrams(spark, sf):
    datagrams = fx.raw_datagrams(fx.logs(spark, sf)).select("value")
    return lines.clean(lines.datagram_lines(datagrams))


_PARSED_3164 = """SELECT row_id, severity, facility, version,
 date_trunc('second', timestamp) AS timestamp, hostname, app_name, procid,
 '-' AS msgid, '-' AS structured_data, msg FROM logs"""

_MIXED = f"""SELECT row_id, {ENTRY} FROM logs WHERE row_id % 8 < 4
 UNION ALL SELECT row_id, {ENTRY} FROM ({_PARSED_3164}) WHERE row_id % 8 BETWEEN 4 AND 6"""

_REJECTED = f"""SELECT {fx.JUNK} AS line, 'auto' AS format, {fx.JUNK_REASON} AS reason
 FROM logs WHERE row_id % 8 = 7"""


@query("ingest_batch", f"SELECT {ENTRY} FROM ({_MIXED})")
def ingest_batch(spark, sf):
    root = files.scratch(spark) + "/table"
    mixed = fx.raw_mixed(fx.logs(spark, sf)).select("line")
    table.write_batch(mixed, root, 0, NOW)
    return table.read_logs(spark, root).select(ENTRY_COLUMNS)


@query("ingest_clustered", f"SELECT {ENTRY} FROM ({_MIXED})")
def ingest_clustered(spark, sf):
    root = files.scratch(spark) + "/table"
    mixed = fx.raw_mixed(fx.logs(spark, sf)).select("line")
    table.write_batch(mixed, root, 0, NOW, cluster=True)
    return table.read_logs(spark, root).select(ENTRY_COLUMNS)


def _ingest_stream(spark, sf):
    scratch = files.scratch(spark)
    mixed = fx.raw_mixed(fx.logs_of(fx.events_stream(spark, sf))).select("line")
    started = ingest.start_ingest(
        mixed, f"{scratch}/table", f"{scratch}/checkpoint", now=NOW, available_now=True
    )
    started.awaitTermination()
    return f"{scratch}/table"


@query("ingest_stream", f"SELECT {ENTRY} FROM ({_MIXED})")
def ingest_stream(spark, sf):
    return table.read_logs(spark, _ingest_stream(spark, sf)).select(ENTRY_COLUMNS)


@query("ingest_rejects", _REJECTED)
def ingest_rejects(spark, sf):
    rejected = table.read_rejects(spark, _ingest_stream(spark, sf))
    return rejected.select("line", "format", "reason")


@query("parse_rejects", _REJECTED)
def parse_rejects(spark, sf):
    mixed = fx.raw_mixed(fx.logs(spark, sf)).select("line")
    return parse.rejects(parse.parse(mixed, NOW))


_RETENTION = 20160
_CUTOFF = "TIMESTAMP '2024-01-17 00:10:00'"
_RETAIN_AT = NOW + dt.timedelta(minutes=10)


@query("retention_keep", f"SELECT {ENTRY} FROM logs WHERE timestamp >= {_CUTOFF}")
def retention_keep(spark, sf):
    root = in_table(spark, fx.logs(spark, sf))
    table.retain(spark, root, _RETAIN_AT, _RETENTION)
    return table.read_logs(spark, root).select(ENTRY_COLUMNS)


@query(
    "retention_deleted",
    f"SELECT COUNT(*) AS deleted FROM logs WHERE timestamp < {_CUTOFF}",
)
def retention_deleted(spark, sf):
    root = in_table(spark, fx.logs(spark, sf))
    deleted = table.retain(spark, root, _RETAIN_AT, _RETENTION)
    return spark.createDataFrame([(deleted,)], "deleted long")


@query("retention_stream", f"SELECT {ENTRY} FROM logs WHERE timestamp >= {_CUTOFF}")
def retention_stream(spark, sf):
    """A stream that runs once, and again without new lines when retention is due."""
    folder = files.scratch(spark)
    fx.raw_5424(fx.logs(spark, sf)).select("line").write.text(f"{folder}/in")
    for now in (NOW, _RETAIN_AT):
        started = ingest.start_ingest(
            lines.text_lines(spark, f"{folder}/in", stream=True),
            f"{folder}/table",
            f"{folder}/checkpoint",
            now=now,
            retention_minutes=_RETENTION,
            available_now=True,
        )
        started.awaitTermination()
    return table.read_logs(spark, f"{folder}/table").select(ENTRY_COLUMNS)


_HOURLY = """SELECT date_trunc('hour', timestamp) AS hour, severity, facility,
 COUNT(*) AS total FROM {rows} GROUP BY 1, 2, 3"""


def _merged(hours: DataFrame) -> DataFrame:
    return hours.groupBy("hour", "severity", "facility").agg(F.sum("total").alias("total"))


@query(
    "retention_rollup",
    _HOURLY.format(rows=f"(SELECT * FROM logs WHERE timestamp >= {_CUTOFF})"),
)
def retention_rollup(spark, sf):
    root = in_table(spark, fx.logs(spark, sf))
    table.retain(spark, root, _RETAIN_AT, _RETENTION)
    return _merged(table.read_rollup(spark, root))


@query("compact_day", f"SELECT {ENTRY} FROM logs")
def compact_day(spark, sf):
    root = in_table(spark, fx.logs(spark, sf))
    table.compact_day(spark, root, CURSOR.date())
    return table.read_logs(spark, root).select(ENTRY_COLUMNS)


def _sql_pick(slot: str, values: list) -> str:
    texts = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"([{', '.join(texts)}])[CAST({slot} AS BIGINT) + 1]"


def _seed_sql() -> str:
    """The seed generator, written for DuckDB."""

    def draw(name: str, low: int, high: int) -> str:
        hashed, part = divmod(generate.DRAWS.index(name), 4)
        key = f"md5('0:' || CAST(slot AS VARCHAR) || ':{hashed}')"
        digits = f"substr({key}, {part * 7 + 1}, 7)"
        return f"(CAST('0x' || {digits} AS BIGINT) % {high - low + 1} + {low})"

    def ip(prefix: str) -> str:
        parts = [draw(f"{prefix}{i}", 0 if i > 1 else 1, 255) for i in (1, 2, 3, 4)]
        return "concat_ws('.', " + ", ".join(parts) + ")"

    def word(i: int) -> str:
        user = _sql_pick(draw(f"user{i}", 0, 7), generate.USERS)
        service = f"'service_' || {draw(f'service{i}', 1, 100)}"
        kind = draw(f"kind{i}", 0, 2)
        return f"CASE {kind} WHEN 0 THEN {user} WHEN 1 THEN {ip(f'word{i}_ip')} ELSE {service} END"

    def fill(template: str, words: list[str], numbers: list[str]) -> str:
        for marker, values in (("%s", words), ("%d", numbers)):
            for value in values:
                template = template.replace(marker, f"' || {value} || '", 1)
        return f"'{template}'"

    numbers = [draw("number1", 1, 1000), draw("number2", 1, 1000)]
    data = [
        fill(t, [ip("ip")], [draw("data_number", 1000, 9999)])
        for t in generate.STRUCTURED_DATA
    ]
    messages = [fill(t, [word(1), word(2)], numbers) for t in generate.MESSAGES]

    def choose(name: str, options: list[str]) -> str:
        cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
        return f"CASE {draw(name, 0, len(options) - 1)} {cases} END"

    facility = _sql_pick(draw("facility", 0, 19), generate.FACILITIES)
    at = f"CAST(day AS TIMESTAMP) + to_seconds({draw('second', 0, 86399)})"
    low, high = generate.SEED_PER_DAY
    size = f"CAST('0x' || substr(md5('0:day:' || id), 1, 7) AS BIGINT) % {high - low + 1} + {low}"
    return f"""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
    numbered AS (SELECT day, CAST((SELECT MAX(day) FROM days) - day AS BIGINT) AS id FROM days),
    slots AS (SELECT id * {high} + unnest(range(1, {size} + 1)) AS slot, day FROM numbered)
    SELECT slot, {at} AS timestamp,
      '<' || ({facility} * 8 + {draw("severity", 0, 7)}) || '>1 '
      || replace(CAST({at} AS VARCHAR), ' ', 'T') || '.000+00:00 '
      || {_sql_pick(draw("host", 0, 6), generate.HOSTS)} || ' '
      || {_sql_pick(draw("app", 0, 9), generate.APPS)} || ' '
      || {draw("proc", 1000, 9999)} || ' MSG' || {draw("msgid", 10000, 99999)} || ' '
      || {choose("data", data)} || ' ' || {choose("message", messages)} AS line
      FROM slots"""


@query("gen_seed", _seed_sql(), logs=False)
def gen_seed(spark, sf):
    """A seed set of the days that have events, in time order."""
    days = fx.table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    last = days.agg(F.max("day")).first()[0]
    numbered = days.select(F.datediff(F.lit(last), "day").cast("long").alias("id"), "day")
    return generate.seed_set(generate.slots_of(numbered))


_WORKERS = 7


@query(
    "gen_burst",
    f"""WITH n AS (SELECT COUNT(*) AS n FROM events),
    split AS (SELECT w, n // {_WORKERS} + CASE WHEN w < n % {_WORKERS} THEN 1 ELSE 0 END AS size
              FROM n, range({_WORKERS}) AS t(w)),
    sent AS (SELECT w, unnest(range(size)) AS i FROM split)
    SELECT row_number() OVER (ORDER BY w, i) - 1 AS slot, w AS worker,
      '<14>1 2024-01-31T00:00:00.000Z localhost bench 1 MSG' || w || '-' || i % 1000
      || ' - Log message ' || i % 1000 || ' from worker ' || w AS line FROM sent""",
    logs=False,
)
def gen_burst(spark, sf):
    total = fx.table(spark, sf, "events").count()
    return generate.burst_lines(spark, total, _WORKERS, NOW)


# --- Parsing ---------------------------------------------------------------


def _parsed(rows: DataFrame, fmt: str) -> DataFrame:
    return parse.entries(parse.parse(rows, NOW, fmt))


@log_query("parse_rfc5424", f"SELECT row_id, {ENTRY} FROM logs")
def parse_rfc5424(logs):
    return _parsed(fx.raw_5424(logs), "rfc5424")


@log_query("parse_rfc3164", _PARSED_3164)
def parse_rfc3164(logs):
    return _parsed(fx.raw_3164(logs), "rfc3164")


@log_query("parse_auto", _MIXED)
def parse_auto(logs):
    return _parsed(fx.raw_mixed(logs), "auto")


@query(
    "parse_documents",
    """SELECT doc_id, 'doc@1' AS sd_id, 'text' AS key, text AS value FROM documents
    UNION ALL SELECT doc_id, 'doc@1', 'lang', lang FROM documents""",
    logs=False,
)
def parse_documents(spark, sf):
    raw = fx.raw_documents(fx.table(spark, sf, "documents"))
    taken = parse.entries(parse.parse(raw, NOW, max_bytes=None))
    return enrich.sd_rows(taken.withColumnRenamed("doc_id", "row_id")).withColumnRenamed(
        "row_id", "doc_id"
    )


@query(
    "pri_decode",
    """SELECT event_id, CAST(CASE WHEN event_id % 10 = 9 THEN 0 ELSE event_id % 192 // 8 END
      AS INT) AS facility,
    CAST(CASE WHEN event_id % 10 = 9 THEN 0 ELSE event_id % 192 % 8 END AS INT) AS severity
    FROM events""",
    logs=False,
)
def pri_decode(spark, sf):
    pri = F.when(F.col("event_id") % 10 != 9, (F.col("event_id") % 192).cast("int"))
    return fx.table(spark, sf, "events").select(
        "event_id", facility_of(pri).alias("facility"), severity_of(pri).alias("severity")
    )


@log_query("priority", "SELECT row_id, facility * 8 + severity AS priority FROM logs")
def priority(logs):
    return logs.select(
        "row_id", priority_of(F.col("facility"), F.col("severity")).alias("priority")
    )


@log_query("sd_to_json", "SELECT row_id, structured_data FROM logs")
def sd_to_json(logs):
    return _parsed(fx.raw_5424(logs), "auto").select("row_id", "structured_data")


@log_query(
    "sd_parse",
    """SELECT row_id, CAST(row_id % 3 AS INT) AS elements,
    CASE row_id % 3 WHEN 1 THEN '10.0.0.' || CAST(CAST(procid AS BIGINT) % 256 AS VARCHAR)
    END AS ip,
    CASE row_id % 3 WHEN 2 THEN CAST(row_id AS VARCHAR) END AS event_id FROM logs""",
)
def sd_parse(logs):
    parsed = sd.parse(F.col("structured_data"))
    at = lambda sd_id, key: F.get(
        F.map_values(F.map_filter(F.try_element_at("m", F.lit(sd_id)), lambda k, _: k == key)), 0
    )
    return logs.select("row_id", parsed.alias("m")).select(
        "row_id",
        F.size("m").alias("elements"),
        at("origin@6875", "ip").alias("ip"),
        at("exampleSDID@32473", "eventID").alias("event_id"),
    )


@log_query(
    "sd_explode",
    """SELECT row_id, 'origin@6875' AS sd_id, 'ip' AS key,
      '10.0.0.' || CAST(CAST(procid AS BIGINT) % 256 AS VARCHAR) AS value
      FROM logs WHERE row_id % 3 = 1
    UNION ALL SELECT row_id, 'origin@6875', 'port', CAST(row_id % 1000 AS VARCHAR)
      FROM logs WHERE row_id % 3 = 1
    UNION ALL SELECT row_id, 'exampleSDID@32473', 'eventID', CAST(row_id AS VARCHAR)
      FROM logs WHERE row_id % 3 = 2
    UNION ALL SELECT row_id, 'exampleSDID@32473', 'eventSource', 'Application'
      FROM logs WHERE row_id % 3 = 2
    UNION ALL SELECT row_id, 'exampleSDID@32473', 'iut', '3' FROM logs WHERE row_id % 3 = 2
    UNION ALL SELECT row_id, 'meta@1234', 'version', '1.1' FROM logs WHERE row_id % 3 = 2""",
)
def sd_explode(logs):
    return enrich.sd_rows(logs)


@log_query(
    "sd_flatten",
    """SELECT row_id, CASE row_id % 3 WHEN 0 THEN '-'
    WHEN 1 THEN 'origin@6875:{ip=10.0.0.' || CAST(CAST(procid AS BIGINT) % 256 AS VARCHAR)
      || ', port=' || CAST(row_id % 1000 AS VARCHAR) || '}'
    ELSE 'exampleSDID@32473:{eventID=' || CAST(row_id AS VARCHAR)
      || ', eventSource=Application, iut=3}, meta@1234:{version=1.1}' END
    AS structured_text FROM logs""",
)
def sd_flatten(logs):
    return enrich.sd_text(logs)


_API = """row_id AS id, facility, severity, timestamp, hostname, app_name AS "appName",
 procid AS "procId", msgid AS "msgId", msg AS message,
 CASE WHEN structured_data <> '-' THEN structured_data END AS "structuredData" """


@log_query("page_projection", f"SELECT {_API} FROM logs")
def page_projection(logs):
    rows = paging.project(logs)
    return rows.withColumn("structuredData", F.to_json("structuredData"))


# --- Filters ---------------------------------------------------------------


def filter_query(name: str, given: dict, sql: str) -> None:
    """Register a plain filter."""
    log_query(name, f"SELECT {ROW} FROM logs WHERE {sql}")(
        lambda logs: logs.filter(filters.where(logs, given)).select(paging.PAGE_COLUMNS)
    )


_START, _END = dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 15, 18, 30)
_RANGE = {"startDate": _START, "endDate": _END}
_RANGE_SQL = f"timestamp >= TIMESTAMP '{_START}' AND timestamp <= TIMESTAMP '{_END}'"

filter_query("filter_severity", {"severity": [0, 3]}, "severity IN (0, 3)")
filter_query("filter_facility", {"facility": [1, 16, 23]}, "facility IN (1, 16, 23)")
filter_query("filter_hostname", {"hostname": "host-3"}, "hostname = 'host-3'")
filter_query("filter_procid", {"procId": "12"}, "procid = '12'")
filter_query("filter_app", {"appName": "error"}, "app_name = 'error'")
filter_query("filter_msgid", {"msgId": "MSG7"}, "msgid = 'MSG7'")
filter_query("filter_range", _RANGE, _RANGE_SQL)
filter_query(
    "filter_all",
    {**_RANGE, "severity": [1, 2, 3], "facility": list(range(12)), "hostname": "host-2"},
    f"severity IN (1, 2, 3) AND facility < 12 AND hostname = 'host-2' AND {_RANGE_SQL}",
)
filter_query(
    "filter_lenient",
    filters.read_filters(
        {
            "severity": "emergency,warning",
            "facility": "x,4,,5",
            "hostname": "",
            "timestamp": str(to_ms(_START)),
        }
    ),
    "facility IN (4, 5)",
)


@log_query(
    "cursor_clamp", f"SELECT {ROW} FROM logs WHERE timestamp < TIMESTAMP '2024-01-25 12:01:00'"
)
def cursor_clamp(logs):
    cursor = filters.read_cursor(str(to_ms(NOW)), dt.datetime(2024, 1, 25, 12))
    return logs.filter(filters.where(logs, {}, cursor)).select(paging.PAGE_COLUMNS)


@log_query(
    "range_exclusive",
    f"""SELECT {ROW} FROM logs WHERE epoch_us(timestamp) // 1000 > {to_ms(_START)}
    AND epoch_us(timestamp) // 1000 < {to_ms(_END)}""",
)
def range_exclusive(logs):
    rows = logs.filter(filters.in_open_range(F.col("timestamp"), _START, _END))
    return rows.select(paging.PAGE_COLUMNS)


@log_query(
    "same_day", f"SELECT {ROW} FROM logs WHERE CAST(timestamp AS DATE) = DATE '2024-01-10'"
)
def same_day(logs):
    rows = logs.filter(filters.in_open_range(F.col("timestamp"), _START, None))
    return rows.select(paging.PAGE_COLUMNS)


_RANGE_NOW = dt.datetime(2024, 1, 20, 13, 45)
_PRESET_SQL = {
    "today": ("2024-01-20 00:00:00", "2024-01-20 23:59:59.999"),
    "yesterday": ("2024-01-19 00:00:00", "2024-01-19 23:59:59.999"),
    "last hour": ("2024-01-20 12:45:00", "2024-01-20 13:45:00"),
    "last 7 days": ("2024-01-13 00:00:00", "2024-01-20 23:59:59.999"),
    "last 14 days": ("2024-01-06 00:00:00", "2024-01-20 23:59:59.999"),
    "last 30 days": ("2023-12-21 00:00:00", "2024-01-20 23:59:59.999"),
}


@log_query(
    "range_preset",
    "SELECT name, COUNT(*) AS total, MIN(row_id) AS first_id, MAX(row_id) AS last_id FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS name, row_id FROM logs
        WHERE timestamp BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"""
        for name, (a, b) in _PRESET_SQL.items()
    )
    + ") GROUP BY name",
)
def range_preset(logs):
    inside = {
        name: filters.where(logs, ranges.as_filters(ranges.named(name, _RANGE_NOW)))
        for name in ranges.NAMES
    }
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in inside.items()]))
    return (
        logs.select("row_id", F.explode(names).alias("name"))
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.min("row_id").alias("first_id"),
            F.max("row_id").alias("last_id"),
        )
    )


@log_query(
    "same_hour",
    f"""SELECT {ROW} FROM logs WHERE timestamp >= TIMESTAMP '2024-01-20 13:00:00'
    AND timestamp <= TIMESTAMP '2024-01-20 13:59:59.999'""",
)
def same_hour(logs):
    given = ranges.as_filters(ranges.around(_RANGE_NOW, "hour"))
    return logs.filter(filters.where(logs, given)).select(paging.PAGE_COLUMNS)


# --- Labels and facets -----------------------------------------------------


def _values(names: list[str], labels: list[str]) -> str:
    rows = [f"({i}, '{n}', '{lab}')" for i, (n, lab) in enumerate(zip(names, labels))]
    return f"(VALUES {', '.join(rows)})"


_SEVERITIES = _values(SEVERITY_NAMES, SEVERITY_LABELS)
_FACILITIES = _values(FACILITY_NAMES, FACILITY_LABELS)


@log_query(
    "enrich_labels",
    f"""SELECT row_id, severity, s.name AS severity_name, s.label AS severity_label,
    facility, f.name AS facility_name, f.label AS facility_label,
    facility * 8 + severity AS priority FROM logs
    LEFT JOIN {_SEVERITIES} AS s(code, name, label) ON s.code = severity
    LEFT JOIN {_FACILITIES} AS f(code, name, label) ON f.code = facility""",
)
def enrich_labels(logs):
    return enrich.with_labels(logs.select("row_id", "severity", "facility"))


@log_query(
    "facet_labelled",
    f"""SELECT f.code AS value, name, label, total FROM {_FACILITIES} AS f(code, name, label)
    LEFT JOIN (SELECT facility, COUNT(*) AS total FROM logs
      WHERE severity = 2 AND facility IN (1, 2, 9) GROUP BY 1) ON facility = f.code""",
)
def facet_labelled(logs):
    given = {"severity": [2], "facility": [1, 2, 9]}
    return enrich.facet_options(aggregates.facet(logs, "facility", given), "facility")


_FACET_FILTERS = {**_RANGE, "hostname": "host-4"}
_FACETS_SQL = """SELECT 'severity' AS field, severity AS value, COUNT(*) AS total FROM logs
 WHERE {where} GROUP BY severity UNION ALL
 SELECT 'facility', facility, COUNT(*) FROM logs WHERE {where} GROUP BY facility"""


@log_query("facets", _FACETS_SQL.format(where="hostname = 'host-4'"))
def facets(logs):
    return aggregates.facets(logs, _FACET_FILTERS)


for _field in ("severity", "facility"):
    log_query(
        f"facet_{_field}",
        f"""SELECT {_field} AS value, COUNT(*) AS total FROM logs
        WHERE hostname = 'host-4' GROUP BY {_field}""",
    )(lambda logs, field=_field: aggregates.facet(logs, field, _FACET_FILTERS))


@log_query("facet_any", "SELECT hostname AS value, COUNT(*) AS total FROM logs GROUP BY 1")
def facet_any(logs):
    return aggregates.distinct_values(logs, "hostname")


@log_query(
    "minmax_any", "SELECT MIN(severity) AS min_value, MAX(severity) AS max_value FROM logs"
)
def minmax_any(logs):
    return aggregates.min_max(logs, "severity")


_COUNT_FILTERS = {"severity": [0, 3], "hostname": "host-1"}


@log_query(
    "counts",
    f"""SELECT (SELECT COUNT(*) FROM logs WHERE severity IN (0, 3) AND hostname = 'host-1'
    AND timestamp < TIMESTAMP '{CURSOR}') AS filtered_count,
    (SELECT COUNT(*) FROM logs) AS total_count""",
)
def counts(logs):
    return aggregates.counts(logs, _COUNT_FILTERS, CURSOR)


# --- Charts ----------------------------------------------------------------


def chart_sql(unit: str, where: str) -> str:
    sums = ", ".join(
        f"CAST(SUM(CASE WHEN severity = {code} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"
        for name, code in aggregates.SERIES
    )
    return f"""SELECT CAST(epoch(date_trunc('{unit}', timestamp)) * 1000 AS BIGINT) AS ts, {sums}
    FROM logs WHERE {where} GROUP BY date_trunc('{unit}', timestamp)"""


def _between(start, end) -> str:
    return f"timestamp >= TIMESTAMP '{start}' AND timestamp <= TIMESTAMP '{end}'"


for _unit in ("hour", "day", "week", "month"):
    log_query(f"chart_{_unit}", chart_sql(_unit, _RANGE_SQL + " AND facility < 10"))(
        lambda logs, unit=_unit: aggregates.chart(
            logs, {**_RANGE, "facility": list(range(10))}, CURSOR, unit
        )
    )

# Ranges at, and just beyond, the longest one of each bucket width.
_AUTO = {
    "hour": dt.timedelta(days=3),
    "day": dt.timedelta(days=21),
    "week": dt.timedelta(days=180),
    "month": dt.timedelta(days=180, milliseconds=1),
}
for _unit, _length in _AUTO.items():
    log_query(f"chart_auto_{_unit}", chart_sql(_unit, _between(NOW - _length, NOW)))(
        lambda logs, length=_length: aggregates.chart(
            logs, {"startDate": NOW - length, "endDate": NOW}, CURSOR
        )
    )


@log_query(
    "chart_default",
    chart_sql("hour", _between("2024-01-19 13:45:00", "2024-01-20 14:00:00")),
)
def chart_default(logs):
    return aggregates.chart(logs, {}, _RANGE_NOW)


# --- Pages -----------------------------------------------------------------

_PAGE_FILTERS = {"severity": [0, 3]}


def page_sql(compare: str, order: str = "timestamp DESC, row_id DESC", size: int = 50) -> str:
    return f"""SELECT {ROW} FROM logs WHERE severity IN (0, 3)
    AND timestamp {compare} TIMESTAMP '{CURSOR}' ORDER BY {order} LIMIT {size}"""


@log_query("page_next", page_sql("<"))
def page_next(logs):
    return paging.page(logs, 50, _PAGE_FILTERS, CURSOR)


@log_query("page_prev", page_sql(">"))
def page_prev(logs):
    return paging.page(logs, 50, _PAGE_FILTERS, CURSOR, "prev")


@log_query("sort_asc", page_sql("<", "hostname ASC NULLS LAST, row_id ASC"))
def sort_asc(logs):
    sort = paging.read_sort("hostname.asc")
    return paging.page(logs, 50, _PAGE_FILTERS, CURSOR, sort=sort)


@log_query("sort_desc", page_sql("<", "app_name DESC NULLS LAST, row_id DESC"))
def sort_desc(logs):
    sort = paging.read_sort("appName.desc")
    return paging.page(logs, 50, _PAGE_FILTERS, CURSOR, sort=sort)


@log_query(
    "page_cursors",
    f"""SELECT MIN(epoch_us(timestamp) // 1000) AS next_cursor,
    MAX(epoch_us(timestamp) // 1000) AS prev_cursor FROM ({page_sql("<")})""",
)
def page_cursors(logs):
    return paging.page_cursors(paging.page(logs, 50, _PAGE_FILTERS, CURSOR))


@log_query(
    "page_stable",
    f"""SELECT {ROW} FROM logs WHERE severity IN (0, 3)
    AND timestamp <= TIMESTAMP '{CURSOR}' ORDER BY timestamp DESC, row_id DESC LIMIT 50""",
)
def page_stable(logs):
    return paging.page_stable(logs, 50, _PAGE_FILTERS, (CURSOR, 2**62))


@query(
    "page_by_days",
    f"""SELECT {ENTRY} FROM logs WHERE hostname = 'host-5'
    AND timestamp < TIMESTAMP '{CURSOR}' ORDER BY timestamp DESC LIMIT 200""",
)
def page_by_days(spark, sf):
    root = in_table(spark, fx.logs(spark, sf))
    request = explore.Request(cursor=CURSOR, size=200, filters={"hostname": "host-5"})
    days = table.log_days(spark, root)
    logs = table.read_logs(spark, root)
    return _entries_of(logs, walk.page_by_days(logs, days, request))


def _entries_of(logs: DataFrame, rows: list) -> DataFrame:
    found = logs.sparkSession.createDataFrame(rows, logs.select(paging.PAGE_COLUMNS).schema)
    return found.withColumn("version", F.lit(1)).select(ENTRY_COLUMNS)


@query(
    "page_by_hours",
    f"""SELECT {ENTRY} FROM logs WHERE severity IN (0, 3) AND facility < 20
    AND timestamp < TIMESTAMP '{CURSOR}' ORDER BY timestamp DESC LIMIT 200""",
)
def page_by_hours(spark, sf):
    """A page whose first hour the rollup tells."""
    root = in_table(spark, fx.logs(spark, sf))
    codes = {"severity": [0, 3], "facility": list(range(20))}
    request = explore.Request(cursor=CURSOR, size=200, filters=codes)
    logs, days = table.read_logs(spark, root), table.log_days(spark, root)
    rolled = table.read_rollup(spark, root)
    return _entries_of(logs, walk.page_by_days(logs, days, request, rollup=rolled))


_WALK_SIZE = 100
_WALK_FILTERS = {"hostname": "host-5"}


def _walk_sql(order: str) -> str:
    """Pages from the newest row on until the filtered count is reached.

    After k pages the count is what is left below the cursor, so that a walk of
    n rows ends with the first page k for which k pages hold n - (k - 1) pages.
    """
    return f""", ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place
      FROM logs WHERE timestamp < TIMESTAMP '{NOW}' AND hostname = 'host-5'),
    n AS (SELECT COUNT(*) AS n FROM ranked)
    SELECT {ROW} FROM ranked WHERE place <= {_WALK_SIZE} *
      (SELECT greatest((n + {_WALK_SIZE} + 2 * {_WALK_SIZE} - 1) // (2 * {_WALK_SIZE}), 1) FROM n)"""


@log_query("page_walk", _walk_sql("timestamp DESC"))
def page_walk(logs):
    request = explore.Request(cursor=NOW, size=_WALK_SIZE, filters=_WALK_FILTERS)
    return paging.concat_pages(walk.walk(logs, request))


def _sorted_walk_sql(steps: int = 40, size: int = 300) -> str:
    """Pages of a reader who sorts by application, step by step.

    A page lies below the millisecond of the last row of the page before; after
    a page the walk goes on while the rows fetched are fewer than match it.
    """
    sql = f""", mine AS (SELECT * FROM logs WHERE hostname = 'host-5'),
    s0 AS (SELECT TIMESTAMP '{NOW}' AS c, 0 AS fetched)"""
    pages = []
    for i in range(steps):
        below = f"timestamp < (SELECT c FROM s{i})"
        sql += f""", p{i} AS (SELECT *, row_number() OVER (ORDER BY app_name, row_id) AS place
          FROM mine WHERE {below}),
        s{i + 1} AS (SELECT CASE WHEN fetched + least(n, {size}) < n
            THEN to_timestamp_ms(t) END AS c, fetched + least(n, {size}) AS fetched
          FROM s{i}, (SELECT COUNT(*) AS n FROM p{i}) q,
          (SELECT max(epoch_us(timestamp) // 1000) AS t FROM p{i}
           WHERE place = (SELECT least(COUNT(*), {size}) FROM p{i})) r)"""
        pages.append(f"SELECT {ROW} FROM p{i} WHERE place <= {size}")
    sql = sql.replace("to_timestamp_ms(t)", "TIMESTAMP '1970-01-01' + to_milliseconds(t)")
    return f"{sql} {' UNION ALL '.join(pages)}"


@log_query("page_walk_sorted", _sorted_walk_sql())
def page_walk_sorted(logs):
    request = explore.Request(
        cursor=NOW, size=300, filters=_WALK_FILTERS, sort=("app_name", True)
    )
    return paging.concat_pages(list(walk.walk(logs, request)))


@log_query(
    "page_bounds",
    f"""SELECT page, COUNT(*) AS n_rows, arg_min(row_id, place) AS first_id,
      arg_max(row_id, place) AS last_id FROM (
      SELECT row_id, (place - 1) // 70 AS page, place FROM (SELECT row_id,
        row_number() OVER (ORDER BY app_name, row_id) AS place FROM logs
        WHERE severity IN (0, 3)) a) b GROUP BY page""",
)
def page_bounds(logs):
    return walk.page_bounds(logs, 70, _PAGE_FILTERS, ("app_name", True))


@log_query("page_union", f"({page_sql('<')}) UNION ALL ({page_sql('<', size=20)})")
def page_union(logs):
    first = paging.page(logs, 50, _PAGE_FILTERS, CURSOR)
    again = paging.page(logs, 20, _PAGE_FILTERS, CURSOR)
    return paging.concat_pages([first, again])


@log_query("extract", f"SELECT {ROW} FROM logs WHERE severity IN (0, 3)")
def extract(logs):
    return walk.extract(logs, _PAGE_FILTERS)


# --- Live mode -------------------------------------------------------------

_LIVE_START = CURSOR
# One step brings nothing new, so its poll repeats the cursor's own row.
_STEPS = [CURSOR + dt.timedelta(hours=h) for h in (1, 9, 9, 30)]
_LIVE_SIZE = 40


def _live_sql() -> str:
    sql = f"WITH logs AS ({fx.LOGS}), c0 AS (SELECT {to_ms(_LIVE_START)} AS c)"
    pages = []
    for i, seen in enumerate(_STEPS):
        new = f"""epoch_us(timestamp) > (SELECT c FROM c{i}) * 1000
        AND timestamp <= TIMESTAMP '{seen}'"""
        sql += f""", c{i + 1} AS (SELECT COALESCE(MAX(epoch_us(timestamp) // 1000),
        (SELECT c FROM c{i})) AS c FROM logs WHERE {new})"""
        pages.append(
            f"""(SELECT {i} AS step, {ROW} FROM logs WHERE {new}
            ORDER BY timestamp DESC LIMIT {_LIVE_SIZE})"""
        )
    return f"{sql} {' UNION ALL '.join(pages)}"


@query("live_tail", _live_sql(), logs=False)
def live_tail(spark, sf):
    logs, cursor, pages = fx.logs(spark, sf), _LIVE_START, []
    for step, seen in enumerate(_STEPS):
        visible = logs.filter(F.col("timestamp") <= F.lit(str(seen)).cast("timestamp_ntz"))
        rows, cursor = live.poll(visible, cursor, _LIVE_SIZE)
        pages.append(rows.select(F.lit(step).alias("step"), *paging.PAGE_COLUMNS))
    return paging.concat_pages(pages)


@query(
    "live_stream",
    f"""SELECT {ROW} FROM logs WHERE timestamp > TIMESTAMP '{CURSOR}' AND severity IN (0, 3)
    ORDER BY timestamp DESC LIMIT {_LIVE_SIZE}""",
)
def live_stream(spark, sf):
    root = files.scratch(spark)
    stream = fx.logs_of(fx.events_stream(spark, sf))
    tail = live.start_tail(
        stream,
        root,
        f"{root}/checkpoint",
        _LIVE_START,
        _LIVE_SIZE,
        _PAGE_FILTERS,
        available_now=True,
    )
    tail.awaitTermination()
    return spark.read.parquet(f"{root}/rows").select(paging.PAGE_COLUMNS)


@log_query(
    "live_anchor",
    f"""SELECT {ROW}, timestamp <= TIMESTAMP '2024-01-20 00:00:00.000999' AS is_past,
    row_id = (SELECT row_id FROM logs WHERE epoch_us(timestamp) // 1000 <= {to_ms(CURSOR)}
      ORDER BY timestamp DESC LIMIT 1) AS is_anchor FROM logs""",
)
def live_anchor(logs):
    rows = logs.select(paging.PAGE_COLUMNS)
    first = live.anchor(rows, CURSOR).select("row_id", F.lit(True).alias("is_anchor"))
    flagged = live.flag_past(rows, CURSOR).join(F.broadcast(first), "row_id", "left")
    return flagged.withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))


# --- Rollup ----------------------------------------------------------------


@query("rollup_stream", _HOURLY.format(rows=f"({_MIXED})"))
def rollup_stream(spark, sf):
    return _merged(table.read_rollup(spark, _ingest_stream(spark, sf)))


def _rolled(spark, sf) -> tuple[DataFrame, DataFrame]:
    root = in_table(spark, fx.logs(spark, sf))
    return table.read_rollup(spark, root), table.read_logs(spark, root)


@query("rollup_facets", _FACETS_SQL.format(where="severity IN (0, 3)"))
def rollup_facets(spark, sf):
    return rollup.facets(_rolled(spark, sf)[0], {**_RANGE, "severity": [0, 3]})


_CUT = {
    "startDate": dt.datetime(2024, 1, 3, 7, 20, 30),
    "endDate": dt.datetime(2024, 1, 17, 21, 40),
}


@query(
    "rollup_chart",
    chart_sql("day", _between(_CUT["startDate"], _CUT["endDate"]) + " AND facility < 10"),
)
def rollup_chart(spark, sf):
    hours, logs = _rolled(spark, sf)
    return rollup.chart(hours, logs, {**_CUT, "facility": list(range(10))}, CURSOR)


@query(
    "rollup_counts",
    f"""SELECT (SELECT COUNT(*) FROM logs WHERE severity IN (0, 3)
    AND timestamp < TIMESTAMP '{_RANGE_NOW}') AS filtered_count,
    (SELECT COUNT(*) FROM logs) AS total_count""",
)
def rollup_counts(spark, sf):
    hours, logs = _rolled(spark, sf)
    return rollup.counts(hours, logs, {"severity": [0, 3]}, _RANGE_NOW)


# --- Report ----------------------------------------------------------------

_PARAMS = {
    "severity": "0,3",
    "hostname": "host-1",
    "timestamp": f"{to_ms(_START)}-{to_ms(_END)}",
    "cursor": str(to_ms(dt.datetime(2024, 1, 14, 12))),
    "size": "40",
}
_REPORT = "severity IN (0, 3) AND hostname = 'host-1'"


def report(logs: DataFrame) -> explore.Report:
    return explore.explore(logs, explore.read_request(_PARAMS, NOW))


_REPORT_PAGE = f"{_REPORT} AND {_RANGE_SQL} AND timestamp < TIMESTAMP '2024-01-14 12:00:00'"

log_query(
    "explore_page",
    f"SELECT {ROW} FROM logs WHERE {_REPORT_PAGE} ORDER BY timestamp DESC LIMIT 40",
)(lambda logs: report(logs).page)
log_query(
    "explore_counts",
    f"""SELECT (SELECT COUNT(*) FROM logs WHERE {_REPORT_PAGE}) AS filtered_count,
    (SELECT COUNT(*) FROM logs) AS total_count""",
)(lambda logs: report(logs).counts)
log_query("explore_facets", _FACETS_SQL.format(where=_REPORT))(
    lambda logs: report(logs).facets
)
log_query("explore_chart", chart_sql("day", f"{_REPORT} AND {_RANGE_SQL}"))(
    lambda logs: report(logs).chart
)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The report's page, newest rows first."""
    return report(fx.logs(spark, sf)).page


assert set(LOG_COLUMNS) == {"row_id", *ENTRY_COLUMNS}

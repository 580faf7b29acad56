"""Log rows and raw lines derived from the ``events`` and ``documents`` tables.

``LOGS`` is one SQL text that Spark and DuckDB both run. The raw lines are
written by Spark, so that a parser's result can be compared with ``LOGS``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 31)
CURSOR = dt.datetime(2024, 1, 20)

LOGS = """
SELECT event_id AS row_id,
       CAST((event_id * 5 + user_id) % 24 AS INT) AS facility,
       CAST((event_id * 7 + user_id) % 8 AS INT) AS severity,
       CAST(1 AS INT) AS version,
       ts AS timestamp,
       'host-' || CAST(user_id % 7 AS STRING) AS hostname,
       event_type AS app_name,
       CAST(user_id AS STRING) AS procid,
       'MSG' || CAST(event_id % 50 AS STRING) AS msgid,
       CASE event_id % 3
         WHEN 0 THEN '-'
         WHEN 1 THEN '{"origin@6875":{"ip":"10.0.0.' || CAST(user_id % 256 AS STRING)
           || '","port":"' || CAST(event_id % 1000 AS STRING) || '"}}'
         ELSE '{"exampleSDID@32473":{"eventID":"' || CAST(event_id AS STRING)
           || '","eventSource":"Application","iut":"3"},"meta@1234":{"version":"1.1"}}'
       END AS structured_data,
       'event ' || CAST(event_id AS STRING) || ' type ' || event_type AS msg
FROM events
"""

# Parameters are out of order here, so the parser has to sort them.
RAW_5424 = """
'<' || CAST(facility * 8 + severity AS STRING) || '>1 '
|| replace(CAST(timestamp AS STRING), ' ', 'T') || 'Z '
|| hostname || ' ' || app_name || ' ' || procid || ' ' || msgid || ' '
|| CASE row_id % 3
     WHEN 0 THEN '-'
     WHEN 1 THEN '[origin@6875 port="' || CAST(row_id % 1000 AS STRING)
       || '" ip="10.0.0.' || CAST(CAST(procid AS BIGINT) % 256 AS STRING) || '"]'
     ELSE '[meta@1234 version="1.1"][exampleSDID@32473 iut="3" eventSource="Application"'
       || ' eventID="' || CAST(row_id AS STRING) || '"]'
   END
|| ' ' || msg
"""

RAW_3164 = """
'<' || CAST(facility * 8 + severity AS STRING) || '>'
|| date_format(timestamp, 'MMM') || ' '
|| lpad(CAST(day(timestamp) AS STRING), 2, ' ') || ' '
|| date_format(timestamp, 'HH:mm:ss') || ' '
|| hostname || ' ' || app_name || '[' || procid || ']: ' || msg
"""

# Lines no parser takes, and why. Valid in both engines.
JUNK = """
CASE row_id % 5
  WHEN 0 THEN 'garbage ' || CAST(row_id AS STRING)
  WHEN 1 THEN '<192>Oct 11 22:14:15 host su: ' || CAST(row_id AS STRING)
  WHEN 2 THEN '<34>Feb 30 22:14:15 host su: ' || CAST(row_id AS STRING)
  WHEN 3 THEN '<34>1 2024-02-30T00:00:00Z host su - - - ' || CAST(row_id AS STRING)
  ELSE '<34>1 - host su - - [a x="1"][a x="2"] ' || CAST(row_id AS STRING)
END
"""
JUNK_REASON = """
CASE row_id % 5 WHEN 1 THEN 'priority' WHEN 2 THEN 'timestamp' ELSE 'format' END
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files.

    The pattern matches a table that is one file as well as one that is a
    folder; a plain path would have to be a folder.
    """
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def logs_of(events: DataFrame) -> DataFrame:
    """Log rows of an events table or stream."""
    query = LOGS.replace("FROM events", "FROM {events}")
    # Braces of the JSON text are doubled for the formatter.
    body, tail = query.rsplit("{events}", 1)
    body = body.replace("{", "{{").replace("}", "}}")
    return events.sparkSession.sql(f"{body}{{events}}{tail}", events=events)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


def raw_5424(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.expr(RAW_5424).alias("line"))


def raw_3164(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.expr(RAW_3164).alias("line"))


def raw_mixed(rows: DataFrame) -> DataFrame:
    """Half RFC 5424, three eighths RFC 3164, one eighth junk."""
    kind = F.col("row_id") % 8
    line = (
        F.when(kind < 4, F.expr(RAW_5424))
        .when(kind < 7, F.expr(RAW_3164))
        .otherwise(F.expr(JUNK))
    )
    return rows.select("row_id", line.alias("line"))


def raw_datagrams(rows: DataFrame) -> DataFrame:
    """Three lines per datagram, with both line ends and a blank line between."""
    lines = raw_5424(rows).select(
        F.expr("row_id div 3").alias("datagram"), F.col("row_id") % 3, "line"
    )
    numbered = lines.toDF("datagram", "part", "line")
    texts = numbered.groupBy("datagram").agg(
        *[F.max(F.when(F.col("part") == i, F.col("line"))).alias(f"l{i}") for i in range(3)]
    )
    value = F.concat(
        F.coalesce("l0", F.lit("")),
        F.lit("\r\n"),
        F.coalesce("l1", F.lit("")),
        F.lit("\n \n"),
        F.coalesce("l2", F.lit("")),
    )
    return texts.select("datagram", value.alias("value"))


def raw_documents(documents: DataFrame) -> DataFrame:
    """A line per document that carries its whole text as a parameter."""
    quoted = F.regexp_replace("text", r'(["\\\]])', r"\\$1")
    line = F.concat(
        F.lit("<14>1 - host docs - - [doc@1 text=\""),
        quoted,
        F.lit('" lang="'),
        F.col("lang"),
        F.lit('"] '),
        F.col("doc_id").cast("string"),
    )
    return documents.select("doc_id", line.alias("line"))

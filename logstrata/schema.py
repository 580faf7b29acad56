"""The log table, the reject table and the two code dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns a parser produces for one line (no row id yet).
ENTRY = T.StructType(
    [
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("facility", T.IntegerType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("hostname", T.StringType(), False),
        T.StructField("app_name", T.StringType(), False),
        T.StructField("procid", T.StringType(), True),
        T.StructField("msgid", T.StringType(), True),
        T.StructField("structured_data", T.StringType(), True),
        T.StructField("msg", T.StringType(), True),
    ]
)

#: Log rows: an entry with its unique id in front.
LOGS = T.StructType([T.StructField("row_id", T.LongType(), False), *ENTRY.fields])

#: The files of the stored log table: the batch and the place in it are the id of a row.
STORED = T.StructType(
    [
        T.StructField("ingest_batch", T.LongType(), False),
        T.StructField("position", T.LongType(), False),
        *ENTRY.fields,
    ]
)

#: Lines no parser took.
REJECTS = T.StructType(
    [
        T.StructField("line", T.StringType(), True),
        T.StructField("format", T.StringType(), True),
        T.StructField("reason", T.StringType(), True),
    ]
)

#: Hourly counts, the table that serves charts, facets and totals.
ROLLUP = T.StructType(
    [
        T.StructField("hour", T.TimestampNTZType(), False),
        T.StructField("severity", T.IntegerType(), False),
        T.StructField("facility", T.IntegerType(), False),
        T.StructField("total", T.LongType(), False),
    ]
)

LOG_COLUMNS = [f.name for f in LOGS.fields]
ENTRY_COLUMNS = [f.name for f in ENTRY.fields]

# Syslog severity names in code order 0-7.
SEVERITY_NAMES = [
    "emergency",
    "alert",
    "critical",
    "error",
    "warning",
    "notice",
    "info",
    "debug",
]

# Severity display labels in code order 0-7.
SEVERITY_LABELS = [
    "Emergency",
    "Alert",
    "Critical",
    "Error",
    "Warning",
    "Notice",
    "Info",
    "Debug",
]

# Facility short names in code order 0-23.
FACILITY_NAMES = [
    "Kernel",
    "User",
    "Mail",
    "Daemon",
    "Auth",
    "Syslog",
    "LPR",
    "News",
    "UUCP",
    "Cron",
    "AuthPriv",
    "FTP",
    "NTP",
    "Audit",
    "Alert",
    "Clock",
    "Local0",
    "Local1",
    "Local2",
    "Local3",
    "Local4",
    "Local5",
    "Local6",
    "Local7",
]

# Facility option labels in code order 0-23 (two texts repeat,
# so a label is not a key).
FACILITY_LABELS = [
    "Kernel messages",
    "User-level messages",
    "Mail system",
    "System daemons",
    "Security/authorization messages",
    "Messages generated internally by syslogd",
    "Line printer subsystem",
    "Network news subsystem",
    "UUCP subsystem",
    "Clock daemon",
    "Security/authorization messages",
    "FTP daemon",
    "NTP subsystem",
    "Log audit",
    "Log alert",
    "Clock daemon",
    "Local use 0",
    "Local use 1",
    "Local use 2",
    "Local use 3",
    "Local use 4",
    "Local use 5",
    "Local use 6",
    "Local use 7",
]

_DIM = "code int, name string, label string"


def severity_dim(spark: SparkSession) -> DataFrame:
    """The eight severities (code, name, label)."""
    rows = list(zip(range(8), SEVERITY_NAMES, SEVERITY_LABELS))
    return spark.createDataFrame(rows, _DIM)


def facility_dim(spark: SparkSession) -> DataFrame:
    """The 24 facilities (code, name, label)."""
    rows = list(zip(range(24), FACILITY_NAMES, FACILITY_LABELS))
    return spark.createDataFrame(rows, _DIM)

"""RFC 3164 (BSD) lines to columns, in one pattern pass per line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logstrata.functions.priority import facility_of, severity_of
from logstrata.functions.text import REGEX_SPACE, dash_if_empty

# Month abbreviations, and days per month in a leap year (a
# line carries no year, so 29 February is a valid day).
MONTHS = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]
MONTH_DAYS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

# Only blanks, tabs, line and form feeds and returns count as white space; a
# vertical tab is a host character.
_GAP = r"[\t\n\f\r ]+"
_WORD = r"[^\t\n\f\r ]+"
_TIME = rf"[A-Z][a-z]{{2}}{_GAP}\d{{1,2}}{_GAP}\d{{2}}:\d{{2}}:\d{{2}}"
_TAG = r"[A-Za-z0-9_.\-/]+"
_REST = r"(?:\[[^\]]+\])?:.*"

LINE = rf"(?s)^<(\d{{1,3}})>({_TIME}){_GAP}({_WORD}){_GAP}({_TAG})({_REST})$"

# Priority, host and tag hold no line break. A time that holds one is invalid
# anyway, so it comes after them, and the rest of the line last.
_REWRITE = "\n$1\n$3\n$4\n$2\n$5"

# The time layout itself allows only blanks, where the line allows any gap.
_TIME_PARTS = r"^([A-Z][a-z]{2}) +(\d{1,2}) +(\d{2}):(\d{2}):(\d{2})$"
_TIME_REWRITE = "$1:$2:$3:$4:$5"


def split_line(line: Column) -> Column:
    """Array of '', priority, host, tag, time and rest; else no match."""
    return F.split(F.regexp_replace(line, LINE, _REWRITE), "\n", 6)


def matched(parts: Column) -> Column:
    """True if ``split_line`` found the line shape."""
    return F.coalesce(F.get(parts, 0) == "", F.lit(False))


def split_time(parts: Column) -> Column:
    """Array of month name, day, hour, minute and second texts."""
    return F.split(F.regexp_replace(F.get(parts, 4), _TIME_PARTS, _TIME_REWRITE), ":")


def _priority(parts: Column) -> Column:
    return F.get(parts, 1).try_cast("int")


def timestamp(time_parts: Column, now: Column, tz: str) -> Column:
    """UTC time of the line, NULL if it is not a time.

    The year is that of ``now``, except that a December line seen in January
    belongs to the year before. A 29 February in a year without one becomes
    1 March.
    """
    local_now = now if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), now)
    name = F.get(time_parts, 0)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
    day, hour, minute, second = (
        F.get(time_parts, i).try_cast("int") for i in range(1, 5)
    )
    days = F.get(F.array(*[F.lit(d) for d in MONTH_DAYS]), month - 1)
    valid = (
        (F.size(time_parts) == 5)
        & (month > 0)
        & day.between(1, days)
        & (hour < 24)
        & (minute < 60)
        & (second < 60)
    )
    last_year = (F.month(local_now) == 1) & (month == 12)
    year = F.year(local_now) - F.when(last_year, 1).otherwise(0)
    first = F.try_make_timestamp_ntz(year, month, F.lit(1), hour, minute, second)
    local = first + F.make_dt_interval(days=day - 1)
    stamp = F.when(valid, local)
    return stamp if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), stamp)


def fault(parts: Column, stamp: Column) -> Column:
    """Why the line is no RFC 3164 line; NULL if it is one."""
    return (
        F.when(~matched(parts), F.lit("format"))
        .when(~_priority(parts).between(0, 191), F.lit("priority"))
        .when(stamp.isNull(), F.lit("timestamp"))
    )


def entry(parts: Column, stamp: Column) -> Column:
    """The log entry of a faultless line."""
    rest = F.get(parts, 5)
    pid_end = F.when(
        F.startswith(rest, F.lit("[")), F.instr(rest, F.lit("]"))
    ).otherwise(0)
    pid = F.substring(rest, F.lit(2), pid_end - 2)
    text = F.substring(rest, pid_end + 2, F.length(rest))
    return F.struct(
        severity_of(_priority(parts)).alias("severity"),
        facility_of(_priority(parts)).alias("facility"),
        F.lit(1).alias("version"),
        stamp.alias("timestamp"),
        F.get(parts, 2).alias("hostname"),
        F.get(parts, 3).alias("app_name"),
        dash_if_empty(pid).alias("procid"),
        F.lit("-").alias("msgid"),
        F.lit("-").alias("structured_data"),
        F.ltrim(text, F.lit(REGEX_SPACE)).alias("msg"),
    )

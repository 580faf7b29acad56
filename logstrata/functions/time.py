"""Time expressions on ``timestamp_ntz`` that ignore the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chart bucket units, finest first.
UNITS = ("hour", "day", "week", "month")

_EPOCH = dt.datetime(1970, 1, 1)
_MS = dt.timedelta(milliseconds=1)

# Tumbling windows for the fixed-width units. 1970-01-05 was a Monday, hence
# the four days' shift of the weekly window.
_WINDOWS = {
    "hour": ("1 hour", "0 seconds"),
    "day": ("1 day", "0 seconds"),
    "week": ("7 days", "4 days"),
}


def utc(value: dt.datetime) -> dt.datetime:
    """A Python time as naive UTC (naive input is taken to be UTC)."""
    if value.tzinfo is None:
        return value
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None)


def ntz(value: dt.datetime | Column) -> Column:
    """A ``timestamp_ntz`` column or literal from a Column or Python time."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    text = utc(value).isoformat(sep=" ", timespec="microseconds")
    return F.lit(text).cast("timestamp_ntz")


def utc_now() -> Column:
    """The query's current time. On a stream it is the batch's own time, which
    is recorded and the same again when the batch is retried."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return now.cast("timestamp_ntz")


def day(value: dt.datetime) -> Column:
    """The date literal of a Python time, for partition bounds."""
    return F.lit(utc(value).date())


def to_ms(value: dt.datetime) -> int:
    """Whole milliseconds since the epoch, rounded down."""
    return (utc(value) - _EPOCH) // _MS


def from_ms(ms: int) -> dt.datetime | None:
    """A naive UTC time from epoch milliseconds; None beyond years 1-9999."""
    try:
        return _EPOCH + dt.timedelta(milliseconds=ms)
    except OverflowError:
        return None


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds (rounded down) of a ``timestamp_ntz`` column."""
    minutes = F.unix_date(F.to_date(ts)) * F.lit(1440).cast("long")
    minutes = minutes + F.hour(ts) * 60 + F.minute(ts)
    millis = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
    return minutes * 60000 + millis


def bucket_start(ts: Column, unit: str) -> Column:
    """Start of the chart bucket a time falls in, as a grouping key.

    Hour, day and week use a tumbling window, which is plain integer
    arithmetic on the stored microseconds.
    """
    if unit in _WINDOWS:
        width, start = _WINDOWS[unit]
        return F.window(ts, width, width, start)["start"].cast("timestamp_ntz")
    if unit == "month":
        return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")
    raise ValueError(f"unknown bucket unit {unit!r}; expected one of {UNITS}")


def floor_hour(value: dt.datetime) -> dt.datetime:
    """A Python time cut to the hour."""
    return utc(value).replace(minute=0, second=0, microsecond=0)

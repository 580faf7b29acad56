"""Named time ranges, as inclusive (start, end) pairs."""

from __future__ import annotations

import datetime as dt

from logstrata.functions.time import floor_hour, utc

_MS = dt.timedelta(milliseconds=1)
_DAY = dt.timedelta(days=1)
_HOUR = dt.timedelta(hours=1)

#: Days reached back by the ranges that end today.
DAY_RANGES = {"today": 0, "last 7 days": 7, "last 14 days": 14, "last 30 days": 30}

NAMES = ("today", "yesterday", "last hour", "last 7 days", "last 14 days", "last 30 days")


def _midnight(value: dt.datetime) -> dt.datetime:
    return utc(value).replace(hour=0, minute=0, second=0, microsecond=0)


def named(name: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """A preset range. All are day-aligned but the last hour.

    A day ends one millisecond before the next one begins.
    """
    key = name.lower()
    today = _midnight(now)
    if key == "last hour":
        return utc(now) - _HOUR, utc(now)
    if key == "yesterday":
        return today - _DAY, today - _MS
    if key in DAY_RANGES:
        return today - DAY_RANGES[key] * _DAY, today + _DAY - _MS
    raise ValueError(f"unknown range {name!r}; expected one of {NAMES}")


def around(value: dt.datetime, unit: str) -> tuple[dt.datetime, dt.datetime]:
    """The hour or day a time falls in."""
    if unit == "hour":
        return floor_hour(value), floor_hour(value) + _HOUR - _MS
    if unit == "day":
        return _midnight(value), _midnight(value) + _DAY - _MS
    raise ValueError(f"unknown unit {unit!r}; expected hour or day")


def as_filters(bounds: tuple[dt.datetime, dt.datetime]) -> dict[str, dt.datetime]:
    """A range as request filters."""
    return {"startDate": bounds[0], "endDate": bounds[1]}

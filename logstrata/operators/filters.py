"""Request filters as one Column predicate."""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.time import day, from_ms, ntz, to_ms, utc

#: Filter key -> column, for the exact text filters.
TEXT_FILTERS = {
    "hostname": "hostname",
    "appName": "app_name",
    "procId": "procid",
    "msgId": "msgid",
}
#: Filter keys that take a list of codes; the column has the same name.
CODE_FILTERS = ("severity", "facility")
#: Filter keys for the inclusive time range.
TIME_FILTERS = ("startDate", "endDate")

#: How far in the future a cursor may lie.
CLOCK_SKEW = dt.timedelta(minutes=1)

_INTEGER = re.compile(r"[+-]?[0-9]+")
_MAX_INT64 = 2**63


def to_int64(text: str) -> int | None:
    """A decimal text as a 64-bit integer, else None."""
    if not _INTEGER.fullmatch(text):
        return None
    value = int(text)
    return value if -_MAX_INT64 <= value < _MAX_INT64 else None


def read_filters(request: Mapping[str, str | None]) -> dict[str, Any]:
    """Filters of a request given as text parameters.

    The rules are lenient: blank text is no filter, list items that are no
    integers are dropped (and a list without any is no filter), and a time
    range counts only if it is exactly two integers of epoch milliseconds.
    """
    filters: dict[str, Any] = {}
    for key in TEXT_FILTERS:
        if request.get(key):
            filters[key] = request[key]
    for key in CODE_FILTERS:
        codes = [to_int64(item) for item in (request.get(key) or "").split(",")]
        codes = [code for code in codes if code is not None]
        if codes:
            filters[key] = codes
    bounds = [to_int64(part) for part in (request.get("timestamp") or "").split("-")]
    if len(bounds) == 2 and None not in bounds:
        times = [from_ms(ms) for ms in bounds]
        if None not in times:
            filters["startDate"], filters["endDate"] = times
    return filters


def read_cursor(text: str | None, now: dt.datetime) -> dt.datetime:
    """Page cursor of a request: epoch milliseconds, at most a minute ahead.

    Blank or unreadable text means a minute from now.
    """
    latest = utc(now) + CLOCK_SKEW
    ms = to_int64(text) if text else None
    if ms is None:
        return latest
    asked = from_ms(ms)
    if asked is None:
        return latest if ms > 0 else dt.datetime.min
    return min(asked, latest)


def read_direction(text: str | None) -> str:
    """``prev`` or ``next``; anything else means next."""
    return "prev" if text == "prev" else "next"


def code_filter(column: str, codes: Iterable[int]) -> Column | None:
    """Membership in a list of codes; an empty list is no filter."""
    codes = list(codes)
    # Codes are 32-bit columns. A wider literal would turn the comparison into
    # one on a cast column and keep it from reaching the file scan.
    known = [F.lit(c).cast("int") for c in codes if -(2**31) <= c < 2**31]
    if not codes:
        return None
    return F.col(column).isin(known) if known else F.lit(False)


def since(start: dt.datetime, strict: bool = False) -> list[Column]:
    """``timestamp >= start`` (or ``>``) and its partition bound."""
    ts = F.col("timestamp")
    return [ts > ntz(start) if strict else ts >= ntz(start), F.col("dt") >= day(start)]


def until(end: dt.datetime, strict: bool = False) -> list[Column]:
    """``timestamp <= end`` (or ``<``) and its partition bound."""
    ts = F.col("timestamp")
    return [ts < ntz(end) if strict else ts <= ntz(end), F.col("dt") <= day(end)]


def everything(conditions: Iterable[Column]) -> Column:
    """Conjunction of conditions; none is true."""
    conditions = list(conditions)
    return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


def where(
    logs: DataFrame,
    filters: Mapping[str, Any] | None = None,
    cursor: dt.datetime | None = None,
    direction: str = "next",
) -> Column:
    """Predicate for all filters and, if given, the page cursor.

    On a table partitioned by day (a ``dt`` column) every time bound carries
    the matching bound on ``dt``, which Spark cannot derive by itself.
    """
    filters = dict(filters or {})
    conditions: list[Column] = []
    for key in CODE_FILTERS:
        condition = code_filter(key, filters.get(key) or [])
        if condition is not None:
            conditions.append(condition)
    for key, column in TEXT_FILTERS.items():
        if filters.get(key) is not None:
            conditions.append(F.col(column) == F.lit(filters[key]))
    bounds: list[list[Column]] = []
    if filters.get("startDate") is not None:
        bounds.append(since(filters["startDate"]))
    if filters.get("endDate") is not None:
        bounds.append(until(filters["endDate"]))
    if cursor is not None:
        after = read_direction(direction) == "prev"
        bounds.append(since(cursor, True) if after else until(cursor, True))
    partitioned = "dt" in logs.columns
    for on_time, on_day in bounds:
        conditions.append(on_time)
        if partitioned:
            conditions.append(on_day)
    return everything(conditions)


def without_range(filters: Mapping[str, Any] | None) -> dict[str, Any]:
    """The filters less the time range."""
    return {k: v for k, v in (filters or {}).items() if k not in TIME_FILTERS}


def in_open_range(ts: Column, start: dt.datetime, end: dt.datetime | None) -> Column:
    """Re-filter of rows in hand: both ends exclusive; no end = same day.

    Rows in hand count in whole milliseconds, so a time inside the start's
    millisecond is not after it.
    """
    if end is None:
        inside = F.to_date(ts) == day(start)
    else:
        first = from_ms(to_ms(start) + 1)
        inside = (ts >= ntz(first)) & (ts < ntz(from_ms(to_ms(end))))
    return F.coalesce(inside, F.lit(False))

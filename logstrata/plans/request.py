"""What a report is asked for, and the cursors it answers with."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Row

from logstrata.functions.time import to_ms
from logstrata.operators import paging
from logstrata.operators.filters import read_cursor, read_direction, read_filters


@dataclasses.dataclass(frozen=True)
class Request:
    """What a report is asked for."""

    cursor: dt.datetime
    size: int = paging.DEFAULT_SIZE
    direction: str = "next"
    filters: Mapping[str, Any] = dataclasses.field(default_factory=dict)
    sort: tuple[str, bool] = ("timestamp", False)


def read_request(params: Mapping[str, str | None], now: dt.datetime) -> Request:
    """A request given as text parameters; see the readers for the rules."""
    return Request(
        cursor=read_cursor(params.get("cursor"), now),
        size=paging.read_size(params.get("size")),
        direction=read_direction(params.get("direction")),
        filters=read_filters(params),
        sort=paging.read_sort(params.get("sort")),
    )


def cursors(rows: list[Row]) -> tuple[int | None, int | None]:
    """(next, previous) cursor of a collected page: its last and first row."""
    if not rows:
        return None, None
    return to_ms(rows[-1]["timestamp"]), to_ms(rows[0]["timestamp"])

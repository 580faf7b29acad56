"""Syslog priority arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def facility_of(pri: Column) -> Column:
    """priority div 8; an absent priority counts as 0."""
    return F.coalesce(F.shiftright(pri.cast("int"), 3), F.lit(0))


def severity_of(pri: Column) -> Column:
    """priority mod 8; an absent priority counts as 0."""
    return F.coalesce(pri.cast("int") % 8, F.lit(0))


def priority_of(facility: Column, severity: Column) -> Column:
    """The priority a (facility, severity) pair was sent with."""
    return (facility * 8 + severity).cast("int")

"""Whole requests: the explorer report, day-wise paging, rollup serving."""

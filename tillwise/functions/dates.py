"""Time: whole days, calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour periods from start to end, rounded down (not calendar days)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / _MICROS_PER_DAY)


def one_day() -> Column:
    return F.expr("INTERVAL 1 DAY")


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def timestamp_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def weekday_number(c: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(c)

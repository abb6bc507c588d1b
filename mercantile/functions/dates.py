"""Date arithmetic shared by batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift(column: str, interval: str) -> Column:
    """``column`` moved by a day-time interval such as ``'1 day'`` or ``'-1 day'``."""
    return F.expr(f"{column} + INTERVAL '{interval}'")


def month_of(column: str | Column) -> Column:
    """First day of the month as a DATE (``date_trunc`` would turn a zone-free timestamp into a zoned one)."""
    return F.trunc(F.to_date(column), "month")


def period_of(column: str | Column, grain: str) -> Column:
    """First day of the day, week (Monday) or month that holds ``column``."""
    day = F.to_date(column)
    if grain == "day":
        return day
    if grain in ("week", "month"):
        return F.trunc(day, grain)
    raise ValueError(f"unknown grain: {grain}")


def months_between_firsts(later: str | Column, earlier: str | Column) -> Column:
    """Whole months between two first-of-month dates."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def whole_days(later: str, earlier: str) -> Column:
    """Day part of ``later - earlier``, truncated toward zero."""
    return F.expr(f"extract(DAY FROM ({later} - {earlier}))")


def floor_days(later: Column, earlier: str) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down also below zero.

    Works on zone-free timestamps: a negative span is one day lower than its truncated day part
    unless it is an exact number of days.
    """
    span = later - F.col(earlier)
    days = F.extract(F.lit("DAY"), span)
    exact = span == F.make_dt_interval(days)
    return (days - F.when((later < F.col(earlier)) & ~exact, 1).otherwise(0)).cast("int")

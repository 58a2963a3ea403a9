"""Number and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_long(value: Column) -> Column:
    """Nearest whole number, halves upwards (a plain cast would truncate)."""
    return F.floor(value.cast("double") + F.lit(0.5)).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def full_years(start: Column, end: Column) -> Column:
    return F.timestamp_diff("YEAR", start.cast("timestamp"), end.cast("timestamp")).cast("int")


def month_of(day: Column) -> Column:
    return F.trunc(day.cast("date"), "MM")


def first_of_year(day: Column) -> Column:
    return F.trunc(day.cast("date"), "YYYY")

"""Small column expressions: elapsed days, exact money, rounding, clipping."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def timestamp(value: str | Column) -> Column:
    """A reference date given as text (or a column) as a zone-less timestamp."""
    column = F.lit(value) if isinstance(value, str) else value
    return column.cast("timestamp_ntz")


def days_before(as_of: str | Column, days: int) -> Column:
    return timestamp(as_of) - F.make_dt_interval(F.lit(days))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two timestamps, rounded down.

    47 hours are one day, and half a day into the future is day -1.
    """
    gap = later - earlier
    days = F.extract(F.lit("DAY"), gap)
    return F.when(gap < F.make_dt_interval(days), days - 1).otherwise(days)


def exact(column: Column | str) -> Column:
    """Money as a decimal: its sums do not depend on the order of addition,
    so a re-tried task cannot move a total or push a row over a threshold."""
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def exact_sum(column: Column | str) -> Column:
    return F.sum(exact(column)).cast("double")


def exact_avg(column: Column | str) -> Column:
    """Mean of the non-null values from their exact sum."""
    column = F.col(column) if isinstance(column, str) else column
    return F.try_divide(exact_sum(column), F.count(column))


def half_even(column: Column, digits: int = 2) -> Column:
    return F.bround(column, digits)


def percent_of(part: Column, whole: Column) -> Column:
    return half_even(F.try_divide(part * F.lit(100.0), whole), 2)


def clip(column: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(column, high), low)


def normal_quantile(probability: float) -> float:
    """Inverse of the standard normal distribution, as a plan-time literal."""
    return NormalDist().inv_cdf(probability)


def sample_std(column: Column) -> Column:
    """Sample standard deviation of an integer column from exact integer
    moments; null for fewer than two values."""
    n = F.count(column).cast("double")
    total = F.sum(column.cast("decimal(18,0)")).cast("double")
    squares = F.sum((column * column).cast("decimal(18,0)")).cast("double")
    spread = F.greatest(n * squares - total * total, F.lit(0.0))
    return F.sqrt(F.try_divide(spread, n * (n - 1)))

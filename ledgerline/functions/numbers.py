"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.dates import col


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def finite(x: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clip(x: Column | str, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, col(x)))


def near(x: Column | str, target: Column | float, tolerance: float = 0.15) -> Column:
    t = target if isinstance(target, Column) else F.lit(target)
    return F.abs(F.try_divide(col(x), t) - 1) <= tolerance


def outside(x: Column | str, low: float = 0.5, high: float = 2.0) -> Column:
    """True if the ratio is missing, not a number, or outside the band."""
    x = col(x)
    return F.coalesce(F.isnan(x) | ~x.between(low, high), F.lit(True))


def average_rank(value: Column | str, *keys: str) -> Column:
    """Rank from 1 within the keys; equal values share the mean of their ranks."""
    from pyspark.sql import Window

    v = col(value)
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(v)) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / 2


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(100.0 * part, whole), digits)

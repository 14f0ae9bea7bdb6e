"""Calendar expressions over date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_after(d: Column | str, n: int = 1) -> Column:
    """The month-end n months on; the day of the month does not matter."""
    return F.last_day(F.add_months(col(d), n))


def month_on_or_before(d: Column | str) -> Column:
    """The last month-end that is not after the date."""
    d = col(d)
    return F.when(d == F.last_day(d), d).otherwise(month_after(d, -1))


def months_before_quarters(d: Column | str, quarters: Column) -> Column:
    return F.last_day(F.add_months(col(d), (-3 * quarters).cast("int")))


def parse_date(text: Column | str) -> Column:
    """An ISO date anywhere in the text, else "Month D, YYYY", else null."""
    t = col(text)
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    long = F.regexp_extract(t, r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(long, F.lit("")), "MMMM d, yyyy"))


def compact_date(text: Column | str) -> Column:
    """yyyyMMdd text as a date; null if it is not one."""
    return F.try_to_date(col(text), "yyyyMMdd")


def months_between(start: Column, end: Column) -> Column:
    """All month-ends in [start, end] as an array; empty if there are none."""
    first, last = F.last_day(start), month_on_or_before(end)
    step = F.expr("interval 1 month")
    return F.when(first <= last, F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), step), F.last_day)).otherwise(F.array().cast("array<date>"))

"""Trading calendars and month grids."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def month_ends(spark: SparkSession, start: date, end: date) -> DataFrame:
    """(month): calendar month-ends in [start, end]."""
    from ledgerline.functions.dates import months_between

    return spark.range(1).select(F.explode(months_between(F.lit(start), F.lit(end))).alias("month"))


def trading_days(daily: DataFrame) -> DataFrame:
    """(date, next_date by lag): the distinct dates; as many rows as there are days."""
    return daily.select("date").distinct()


def month_end_trading_days(daily: DataFrame, start: date, end: date) -> DataFrame:
    """(month, t): the last trading day of each calendar month in [start, end]."""
    return trading_days(daily).where(F.col("date").between(start, end)).groupBy(F.last_day("date").alias("month")).agg(F.max("date").alias("t"))


def shift_on_calendar(daily: DataFrame, dates: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """``dates`` with the n-th trading day after each date; null past the end of the calendar.

    A date that is no trading day counts from the next one, which is then the 0-th.
    """
    # one row for each day of history: a bounded sort
    days = trading_days(daily).withColumn("__i", F.row_number().over(Window.orderBy("date")))
    position = dates.join(F.broadcast(days.select(F.col("date").alias("__d"))), F.col("__d") >= F.col(column), "left").groupBy(*dates.columns).agg(F.min("__d").alias("__d"))
    at = position.join(days.select(F.col("date").alias("__d"), "__i"), "__d", "left")
    later = days.select(F.col("date").alias(name), (F.col("__i") - n).alias("__i"))
    return at.join(later, "__i", "left").select(*dates.columns, name)


def rebalance_dates(daily: DataFrame, lag_days: int, start: date, end: date) -> DataFrame:
    """(month, t, t_exec): when weights are set and when they are traded; the days are read once."""
    by_date = Window.orderBy("date")  # over the calendar alone
    of_month = Window.partitionBy("month")
    days = trading_days(daily).select("date", F.last_day("date").alias("month"), F.lead("date", lag_days).over(by_date).alias("t_exec"))
    last = F.max(F.when(F.col("date").between(start, end), F.col("date"))).over(of_month)
    return days.withColumn("t", last).where(F.col("date") == F.col("t")).select("month", "t", "t_exec")

"""Filings as a stream: first filings win, amendments that come later are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["cik", "concept", "ddate", "qtrs"]


def first_filings(stream: DataFrame, delay: str = "400 days") -> DataFrame:
    """A stream of facts with ``filed`` as event time, one row for each fact: the first to arrive within the delay.

    Filings arrive in the order in which they are filed, so the first to arrive is
    the first filed. State is dropped once the watermark has passed.
    """
    timed = stream.withColumn("filed_at", F.col("filed").cast("timestamp")).withWatermark("filed_at", delay)
    return timed.dropDuplicatesWithinWatermark(KEYS)


def monthly_arrivals(stream: DataFrame, delay: str = "40 days") -> DataFrame:
    """(window, concept, n, value): filings of each 30 days, once the watermark has passed them."""
    timed = stream.withColumn("filed_at", F.col("filed").cast("timestamp")).withWatermark("filed_at", delay)
    return timed.groupBy(F.window("filed_at", "30 days"), "concept").agg(F.count("*").alias("n"), F.sum("value").alias("value"))

"""Validity intervals: both ends inclusive, a null bound is open."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import months_between
from ledgerline.operators.asof import asof_backward_all
from ledgerline.operators.calendar import month_ends


def holds(month: str = "month", start: str = "start", end: str = "end") -> Column:
    """The interval contains the month."""
    return (F.col(start).isNull() | (F.col(start) <= F.col(month))) & (F.col(end).isNull() | (F.col(end) >= F.col(month)))


def members_at(membership: DataFrame, day: date) -> DataFrame:
    """(ticker) of the members on a day."""
    return membership.withColumn("__m", F.lit(day)).where(holds("__m")).select("ticker").distinct()


def by_month(intervals: DataFrame, start: date, end: date) -> DataFrame:
    """Each interval once for every month-end of [start, end] that it contains, as ``month``.

    The months of an interval come from its own bounds, so rows follow the
    result and no interval meets a month outside it. Spark's estimate of sizes
    takes them for one row an interval, so a join is told not to broadcast them.
    """
    first, last = F.greatest(F.coalesce(F.col("start"), F.lit(start)), F.lit(start)), F.least(F.coalesce(F.col("end"), F.lit(end)), F.lit(end))
    return intervals.withColumn("month", F.explode(months_between(first, last))).hint("merge")


def member_panel(membership: DataFrame, start: date, end: date) -> DataFrame:
    """(month, ticker), distinct."""
    return by_month(membership, start, end).select("month", "ticker").distinct()


def monthly_counts(spark: SparkSession, membership: DataFrame, start: date, end: date) -> DataFrame:
    """(month, n): distinct members at each month-end, months without any included."""
    months = month_ends(spark, start, end)
    return months.join(member_panel(membership, start, end), "month", "left").groupBy("month").agg(F.countDistinct("ticker").alias("n"))


def excluded_months(exclusions: DataFrame, start: date, end: date) -> DataFrame:
    """(month, ticker) inside any exclusion window."""
    return member_panel(exclusions, start, end)


def exclude(panel: DataFrame, exclusions: DataFrame, start: date, end: date) -> tuple[DataFrame, DataFrame]:
    """The panel without excluded rows, and a log (month, n, tickers) of what went."""
    out = excluded_months(exclusions, start, end)
    kept = panel.join(out, ["month", "ticker"], "left_anti")
    gone = panel.join(out, ["month", "ticker"], "left_semi").groupBy("month")
    return kept, gone.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))


def float_windows(check: DataFrame, months: int = 12) -> DataFrame:
    """(ticker, start, end, reason) of flagged float checks that are not the filer's own scale error."""
    reason = F.format_string("public float %s: ratio %.2f (%s)", "flag", "ratio", "reason")
    rows = check.where("flag <> '' and reason <> 'float_scale'")
    return rows.select("ticker", F.col("float_date").alias("start"), F.coalesce("window_end", F.add_months("float_date", months)).alias("end"), reason.alias("reason"))


def era_at(eras: DataFrame, start: date, end: date, key: str = "ticker", value: str = "cik") -> DataFrame:
    """(month, key, value): the era that holds each month; one with a bound beats one without.

    Two bounded eras of one key in one month are an error.
    """
    ranged = F.col("start").isNotNull() | F.col("end").isNotNull()
    rows = by_month(eras.withColumn("__ranged", ranged), start, end)
    by = Window.partitionBy("month", key)
    n = F.sum(F.col("__ranged").cast("int")).over(by)
    best = F.row_number().over(by.orderBy(F.col("__ranged").desc(), F.col(value)))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("overlapping eras of "), F.col(key))).cast("boolean")).otherwise(best == 1)
    return rows.withColumn("__keep", checked).where("__keep").select("month", key, value)


def snapshot_at(snapshots: DataFrame, days: DataFrame) -> DataFrame:
    """``days`` (date) with the tickers of the latest snapshot (date, tickers) at or before each."""
    return asof_backward_all(days.select("date"), snapshots.select(F.col("date").alias("taken"), "tickers"), "date", "taken", ["taken", "tickers"])


def compare(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two (month, ticker) sets: sizes and overlap by month; and per ticker the months that one side alone has."""
    both = ours.select("month", "ticker", F.lit(1).alias("a")).join(theirs.select("month", "ticker", F.lit(1).alias("b")), ["month", "ticker"], "full")
    sizes = both.groupBy("month").agg(F.count("a").alias("ours"), F.count("b").alias("theirs"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"))
    side = F.when(F.col("b").isNull(), "ours").when(F.col("a").isNull(), "theirs")
    alone = both.withColumn("side", side).where("side is not null").groupBy("side", "ticker")
    return sizes, alone.agg(F.count("*").alias("months"), F.min("month").alias("first"), F.max("month").alias("last"))


def aliases(alone: DataFrame, min_months: int = 3) -> DataFrame:
    """(theirs, ours): tickers that are each alone on their side with the same months, first and last."""
    span = ["months", "first", "last"]
    long = alone.where(F.col("months") >= min_months)
    sides = [long.where(F.col("side") == s).groupBy(*span).agg(F.count("*").alias("n"), F.min("ticker").alias(s)).where("n = 1").drop("n") for s in ("ours", "theirs")]
    return sides[0].join(sides[1], span).select("theirs", "ours")


def reconcile(ours: DataFrame, theirs: DataFrame, min_months: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``compare`` after tickers that are the same company under two symbols are named alike; and those names."""
    pairs = aliases(compare(ours, theirs)[1], min_months)
    named = theirs.join(pairs.withColumnRenamed("theirs", "ticker"), "ticker", "left").select("month", F.coalesce("ours", "ticker").alias("ticker")).distinct()
    return (*compare(ours, named), pairs)


def apply_overrides(intervals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Starts replaced where (ticker, end) match; overrides that match nothing are added.

    An open end matches nothing, so an open interval is only ever added to.
    """
    o = overrides.select("ticker", "end", F.col("start").alias("__start"), F.lit(True).alias("__hit"))
    fixed = intervals.join(o, ["ticker", "end"], "left").withColumn("start", F.when(F.col("__hit"), F.col("__start")).otherwise(F.col("start"))).select(*intervals.columns)
    new = overrides.join(intervals.select("ticker", "end"), ["ticker", "end"], "left_anti")
    return fixed.unionByName(new.select(*[c for c in intervals.columns if c in overrides.columns]), allowMissingColumns=True)


def adjudicate(intervals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Starts that rest on a date alone, moved to the first sighting if the day before already shows the ticker.

    ``snapshots`` is (date, ticker) rows; ``decision`` says what was done: kept,
    moved, or unknown (seen in the very first snapshot).
    """
    days = snapshots.select("date").distinct()
    doubtful = F.col("start_source") == "unverified:date_added"
    probes = intervals.where(doubtful).select("ticker", "start", F.date_sub("start", 1).alias("date"))
    before = asof_backward_all(probes, days.select(F.col("date").alias("taken")), "date", "taken", ["taken"])
    seen = snapshots.select(F.col("date").alias("taken"), "ticker", F.lit(True).alias("__seen"))
    first = snapshots.groupBy("ticker").agg(F.min("date").alias("first_seen"))
    start_of_all = snapshots.agg(F.min("date").alias("__first"))
    found = before.join(seen, ["taken", "ticker"], "left").join(first, "ticker", "left").join(F.broadcast(start_of_all))
    decision = F.when(F.col("__seen").isNull(), "kept").when(F.col("first_seen") == F.col("__first"), "unknown").otherwise("moved")
    out = found.withColumn("decision", decision).select("ticker", "start", "decision", "first_seen")
    joined = intervals.join(out, ["ticker", "start"], "left")
    start = F.when(F.col("decision") == "moved", F.col("first_seen")).when(F.col("decision") == "unknown", F.lit(date(1900, 1, 1))).otherwise(F.col("start"))
    return joined.withColumn("start", start).drop("first_seen")

"""Membership intervals from today's members and a list of changes."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.asof import asof_backward_all
from ledgerline.sources.store import settled

UNKNOWN_START = date(1900, 1, 1)


def _events(changes: DataFrame) -> DataFrame:
    """(ticker, date, row, kind, security): one row for each side of a change."""
    added = changes.where("added is not null and added <> ''").select(F.col("added").alias("ticker"), "date", "row", F.lit("added").alias("kind"), F.col("added_security").alias("security"))
    removed = changes.where("removed is not null and removed <> ''").select(F.col("removed").alias("ticker"), "date", "row", F.lit("removed").alias("kind"), F.col("removed_security").alias("security"))
    return added.unionByName(removed)


def _renames(unmatched: DataFrame, current: DataFrame, reliable_from: date, days: int) -> DataFrame:
    """(old_ticker, new_ticker, date, row): additions that fit exactly one current member not yet matched.

    Additions are taken newest first, and a member goes to the first that it alone
    fits. Chains of dates that lie within reach of each other are settled apart.
    """
    # a member stands under each day within reach, so they meet on equal days
    reach = F.explode(F.sequence(F.date_sub("date_added", days), F.date_add("date_added", days)))
    pairs = unmatched.where(F.col("date") >= F.lit(reliable_from)).join(current.select(F.col("ticker").alias("new_ticker"), reach.alias("date")), "date")
    # a chain begins on a day that no other lies before within reach; each day belongs to the last beginning
    dates = pairs.select("date").distinct()
    covered = dates.select(F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", 4 * days))).alias("date"))
    begins = dates.join(covered, "date", "left_anti").select(F.col("date").alias("chain"))
    chains = pairs.join(asof_backward_all(dates, begins, "date", "chain", ["chain"]), "date")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for (day, row, old), own in sorted(rows.groupby(["date", "row", "ticker"]), key=lambda x: (-x[0][0].toordinal(), x[0][1])):
            free = sorted(set(own["new_ticker"]) - taken)
            if len(free) == 1:
                taken.add(free[0])
                out.append((old, free[0], day, row))
        return pd.DataFrame(out, columns=["old_ticker", "new_ticker", "date", "row"])

    return chains.select("chain", "date", "row", "ticker", "new_ticker").groupBy("chain").applyInPandas(settle, "old_ticker string, new_ticker string, date date, row long")


def build_membership(constituents: DataFrame, changes: DataFrame, reliable_from: date, rename_days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(intervals, problems, renames) by reading the changes from the newest back.

    Going back in time, a removal opens an interval that ends the day before, and
    the next older event of the ticker closes it: an addition on its day, another
    removal by inference. On one day additions come before removals. So each
    opening event needs only the event that follows it, and whether an event
    finds an interval open follows from the one before: two window functions.
    """
    today = constituents.select("ticker", F.lit(None).cast("date").alias("date"), F.lit(None).cast("long").alias("row"), F.lit("current").alias("kind"), "security", "date_added")
    events = _events(changes).withColumn("date_added", F.lit(None).cast("date")).unionByName(today)
    order = Window.partitionBy("ticker").orderBy(F.col("date").desc_nulls_first(), F.when(F.col("kind") == "removed", 1).otherwise(0), "row")
    seen = settled(events.withColumns({"before": F.lag("kind").over(order), "next_kind": F.lead("kind").over(order), "next_date": F.lead("date").over(order), "next_row": F.lead("row").over(order)}), "events")
    open_before = F.coalesce(F.col("before").isin("removed", "current"), F.lit(False))

    opened = seen.where("kind in ('removed', 'current')").withColumns({
        "end": F.when(F.col("kind") == "removed", F.date_sub("date", 1)),
        "end_source": F.when(F.col("kind") == "removed", F.concat(F.lit("changes:"), F.col("row").cast("string"))).otherwise("constituents"),
    })
    closed = opened.where("next_kind is not null").select(
        "ticker", "security", F.col("next_date").alias("start"), "end",
        F.concat(F.lit("changes:"), F.col("next_row").cast("string"), F.when(F.col("next_kind") == "removed", ":inferred").otherwise("")).alias("start_source"), "end_source",
    )
    unmatched = seen.where((F.col("kind") == "added") & ~open_before).select("ticker", "date", "row", "security")
    leftover = opened.where("next_kind is null")
    renames = settled(_renames(unmatched, leftover.where("end is null and date_added is not null").select("ticker", "date_added"), reliable_from, rename_days), "renames")
    r = renames.select(F.col("new_ticker").alias("ticker"), "old_ticker", F.col("date").alias("r_date"), F.col("row").alias("r_row"), F.lit(None).cast("date").alias("end"))
    # only current members are renamed: their end is null, and so the join is on the ticker of open rows
    rest = leftover.join(r.drop("end"), (leftover.ticker == r.ticker) & leftover.end.isNull(), "left").drop(r.ticker)
    known = F.col("end").isNull() & F.col("date_added").isNotNull()
    start = F.when(F.col("old_ticker").isNotNull(), F.col("r_date")).when(known, F.col("date_added")).otherwise(F.lit(UNKNOWN_START))
    source = (
        F.when(F.col("old_ticker").isNotNull(), F.concat(F.lit("changes:"), F.col("r_row").cast("string"), F.lit(":renamed_from:"), F.col("old_ticker")))
        .when(~known, "unknown").when(F.col("date_added") < F.lit(reliable_from), "constituents:date_added").otherwise("unverified:date_added")
    )
    intervals = closed.unionByName(rest.select("ticker", "security", start.alias("start"), "end", source.alias("start_source"), "end_source"))
    removed_twice = seen.where((F.col("kind") == "removed") & open_before).select("row", "date", "ticker", F.lit("removed").alias("event"))
    placed = renames.select("row", F.col("old_ticker").alias("ticker"))
    lost = unmatched.join(placed, ["row", "ticker"], "left_anti").select("row", "date", "ticker", F.lit("added").alias("event"))
    return intervals, removed_twice.unionByName(lost), renames


def summary(intervals: DataFrame) -> DataFrame:
    """(metric, value): counts of intervals by where their start comes from, and their bounds."""
    kind = F.when(F.col("start_source").rlike(":inferred$"), "inferred").when(F.col("start_source").rlike(":renamed_from:"), "renamed").otherwise(F.regexp_extract("start_source", "^([a-z]+)", 1))
    by_kind = intervals.groupBy(F.concat(F.lit("start "), kind).alias("metric")).agg(F.count("*").cast("string").alias("value"))
    wide = intervals.agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.count_if(F.col("end").isNull()).alias("open"), F.min("start").alias("first"))
    long = wide.select(F.expr("stack(4, 'intervals', cast(n as string), 'tickers', cast(tickers as string), 'open', cast(open as string), 'first start', cast(first as string)) as (metric, value)"))
    return by_kind.unionByName(long)

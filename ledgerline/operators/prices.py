"""Daily prices: cleaning, monthly panels with an execution lag, coverage, second sources, identity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_after
from ledgerline.functions.names import is_real_name, name_overlap
from ledgerline.functions.numbers import ratio
from ledgerline.operators.asof import asof_backward, first_filed
from ledgerline.operators.calendar import rebalance_dates
from ledgerline.operators.intervals import era_at, member_panel
from ledgerline.operators.shares import split_factor
from ledgerline.sources.store import settled

# What a live quote of a company looks like.
US_EXCHANGES = ("NMS", "NYQ", "NGM", "NCM", "ASE", "PCX", "BTS")
PLACEHOLDER_EXCHANGES, PLACEHOLDER_TYPES = ("YHD",), ("MUTUALFUND", "NONE")


def move(price: str = "adj_close") -> Column:
    """How many times a price moved since the row before, up or down."""
    last = F.lag(price).over(Window.partitionBy("ticker").orderBy("date"))
    return F.greatest(ratio(F.col(price), last), ratio(last, F.col(price)))


def spans(membership: DataFrame) -> DataFrame:
    """(ticker, m_start, m_end): the first start and the last end, null while a member."""
    end = F.when(F.max(F.col("end").isNull().cast("int")) == 1, F.lit(None)).otherwise(F.max("end"))
    return membership.groupBy("ticker").agg(F.min("start").alias("m_start"), end.alias("m_end"))


def clean_daily(daily: DataFrame, membership: DataFrame, glitch: float = 2.0, corrupt: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Prices without reused symbols, one-day spikes and corrupt series; and a log (ticker, rule, days_dropped).

    Reused: the first print comes after the last day as a member. Glitch: a move
    of ``glitch`` times that the next day takes back. Corrupt: after that, a move
    of ``corrupt`` times within the span of membership.
    """
    span = spans(membership)
    first = daily.groupBy("ticker").agg(F.min("date").alias("first_print"))
    reused = first.join(span, "ticker").where("m_end is not null and first_print > m_end").select("ticker")
    fresh = daily.join(reused, "ticker", "left_anti")

    order = Window.partitionBy("ticker").orderBy("date")
    up = F.signum(F.col("adj_close") - F.lag("adj_close").over(order))
    moved = fresh.withColumns({"__x": move(), "__up": up})
    back = moved.withColumns({"__x1": F.lead("__x").over(order), "__up1": F.lead("__up").over(order)})
    spike = F.coalesce((F.col("__x") >= glitch) & (F.col("__x1") >= glitch) & (F.col("__up") != F.col("__up1")), F.lit(False))
    flagged = back.withColumn("__spike", spike)
    smooth = flagged.where("not __spike").select(*daily.columns)

    jumps = smooth.withColumn("__x", move()).where(F.col("__x") >= corrupt).join(span, "ticker", "left")
    inside = F.col("m_start").isNotNull() & (F.col("date") >= F.col("m_start")) & (F.col("m_end").isNull() | (F.col("date") <= F.col("m_end")))
    bad = jumps.where(inside).select("ticker").distinct()
    kept = smooth.join(bad, "ticker", "left_anti")

    def log(rows: DataFrame, rule: str) -> DataFrame:
        return rows.groupBy("ticker").agg(F.lit(rule).alias("rule"), F.count("*").alias("days_dropped"))

    dropped = log(daily.join(reused, "ticker", "left_semi"), "reused").unionByName(log(flagged.where("__spike"), "glitch")).unionByName(log(smooth.join(bad, "ticker", "left_semi"), "corrupt"))
    return kept, dropped


def monthly_prices(daily: DataFrame, lag_days: int, start: date, end: date, when: DataFrame | None = None) -> DataFrame:
    """(month, ticker, t, t_exec, px_me, px_exec): prices at month-end and at execution, either may be missing.

    ``when`` are the rebalance dates if they are known; each day's prices meet them once.
    """
    when = settled(rebalance_dates(daily, lag_days, start, end), "when") if when is None else when
    kinds = F.explode(F.array(F.struct(F.col("t").alias("date"), F.lit(True).alias("end")), F.struct(F.col("t_exec").alias("date"), F.lit(False).alias("end"))))
    marks = F.broadcast(when.select("month", kinds.alias("k")).select("month", "k.*").where("date is not null"))  # two rows a month
    price = lambda at: F.max(F.when(at, F.col("adj_close")))
    both = daily.join(marks, "date").groupBy("month", "ticker").agg(price(F.col("end")).alias("px_me"), price(~F.col("end")).alias("px_exec"))
    return both.join(F.broadcast(when), "month").select("month", "ticker", "t", "t_exec", "px_me", "px_exec")


def dense(rows: DataFrame) -> DataFrame:
    """Every month with every ticker; a month is one of a few hundred, so their side is broadcast."""
    months = rows.select("month").distinct()
    return rows.select("ticker").distinct().join(F.broadcast(months)).join(rows, ["month", "ticker"], "left")


def monthly_returns(daily: DataFrame, lag_days: int, start: date, end: date) -> DataFrame:
    """(month, ticker, t, t_exec, px_me, px_exec, ret_cal, ret_fwd, partial).

    ``ret_fwd`` runs from this month's execution to the next one's; a series that
    ends in between earns up to its last print and is ``partial``.
    """
    when = settled(rebalance_dates(daily, lag_days, start, end).withColumn("t_next", F.lead("t_exec").over(Window.orderBy("month"))), "when")  # a row a month
    rows = dense(monthly_prices(daily, lag_days, start, end, when.drop("t_next")).drop("t", "t_exec")).join(F.broadcast(when), "month")
    order = Window.partitionBy("ticker").orderBy("month")
    rows = rows.withColumns({"__me1": F.lead("px_me").over(order), "__ex1": F.lead("px_exec").over(order)})
    rows = asof_backward(rows, daily.select("ticker", F.col("date").alias("last_date"), F.col("adj_close").alias("last_px")), ["ticker"], "t_next", "last_date", ["last_date", "last_px"])
    whole = ratio("__ex1", "px_exec") - 1
    ends_early = F.col("__ex1").isNull() & (F.col("last_date") > F.col("t_exec"))
    part = F.when(ends_early, ratio("last_px", "px_exec") - 1)
    return rows.where("px_me is not null").select(
        "month", "ticker", "t", "t_exec", "px_me", "px_exec", (ratio("__me1", "px_me") - 1).alias("ret_cal"),
        F.coalesce(whole, part).alias("ret_fwd"), (whole.isNull() & part.isNotNull()).alias("partial"),
    )


def daily_returns(daily: DataFrame) -> DataFrame:
    """(date, ticker, ret): each print over the one before it."""
    return daily.select("date", "ticker", (ratio(F.col("adj_close"), F.lag("adj_close").over(Window.partitionBy("ticker").orderBy("date"))) - 1).alias("ret"))


def coverage(membership: DataFrame, monthly: DataFrame, start: date, end: date) -> tuple[DataFrame, DataFrame]:
    """Members, priced and earning by month up to the last month with a return; and missing months by ticker."""
    last = monthly.where("ret_fwd is not null").agg(F.max("month").alias("__last"))
    flags = monthly.select("month", "ticker", F.lit(1).alias("priced"), F.when(F.col("ret_fwd").isNotNull(), 1).alias("fwd"))
    rows = member_panel(membership, start, end).join(F.broadcast(last)).where("month <= __last").join(flags, ["month", "ticker"], "left")
    by_month = rows.groupBy("month").agg(F.count("*").alias("members"), F.count("priced").alias("priced"), F.count("fwd").alias("fwd"))
    by_month = by_month.withColumn("gap_pct", F.round(100.0 * (F.col("members") - F.col("priced")) / F.col("members"), 2))
    missing = rows.where("priced is null").groupBy("ticker").agg(F.count("*").alias("months_missing"), F.min("month").alias("first"), F.max("month").alias("last"))
    return by_month, missing


def month_end_returns(daily: DataFrame) -> DataFrame:
    """(ticker, month, ret) of the last print of each calendar month."""
    last = daily.groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("adj_close", "date").alias("px"))
    return last.select("ticker", "month", (ratio(F.col("px"), F.lag("px").over(Window.partitionBy("ticker").orderBy("month"))) - 1).alias("ret"))


def reconcile_sources(ours: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """(ticker, month, ret_a, ret_b, diff, conflict) where both sources have a monthly return."""
    a, b = month_end_returns(ours).withColumnRenamed("ret", "ret_a"), month_end_returns(theirs).withColumnRenamed("ret", "ret_b")
    rows = a.join(b, ["ticker", "month"]).where("ret_a is not null and ret_b is not null").withColumn("diff", F.abs(F.col("ret_a") - F.col("ret_b")))
    return rows.withColumn("conflict", F.col("diff") > threshold)


def merge_sources(ours: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """Our prices but for tickers in conflict, theirs for those and for tickers that we lack; with ``source``."""
    conflict = reconcile_sources(ours, theirs, threshold).where("conflict").select("ticker").distinct()
    keep = ours.join(conflict, "ticker", "left_anti").withColumn("source", F.lit("ours"))
    swap = theirs.join(conflict, "ticker", "left_semi").withColumn("source", F.lit("theirs"))
    new = theirs.join(ours.select("ticker").distinct(), "ticker", "left_anti").withColumn("source", F.lit("theirs"))
    return keep.unionByName(swap).unionByName(new)


def classify_removed(membership: DataFrame, daily: DataFrame, delistings: DataFrame, grace_days: int = 45, band: float = 0.2) -> DataFrame:
    """(ticker, end, last_px, delisting_date, last_close, prior_me_close, class) of removed names whose prints stop with them.

    Acquired: delisted, and the last close is within ``band`` of the month-end
    before. Failed: delisted otherwise. Unknown: not in the list.
    """
    last = daily.groupBy("ticker").agg(F.max("date").alias("last_px"), F.max_by("close", "date").alias("last_close"))
    gone = membership.where("end is not null").groupBy("ticker").agg(F.max("end").alias("end")).join(last, "ticker").where(F.col("last_px") <= F.date_add("end", grace_days))
    prior = daily.groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("prior_me_close"))
    rows = gone.withColumn("month", month_after("last_px", -1)).join(prior, ["ticker", "month"], "left").join(delistings.select("ticker", "delisting_date"), "ticker", "left")
    near = F.abs(ratio("last_close", "prior_me_close") - 1) <= band
    kind = F.when(F.col("delisting_date").isNull(), "unknown").when(F.coalesce(near, F.lit(False)), "acquired").otherwise("failed")
    return rows.select("ticker", "end", "last_px", "delisting_date", "last_close", "prior_me_close", kind.alias("class"))


def terminal_returns(monthly: DataFrame, membership: DataFrame, daily: DataFrame, delistings: DataFrame, shock: float, grace_days: int = 45) -> DataFrame:
    """``monthly`` with the missing last return of a removed name set: 0 if acquired, else ``shock``."""
    kind = classify_removed(membership, daily, delistings, grace_days).select("ticker", "class")
    last = monthly.groupBy("ticker").agg(F.max("month").alias("__last"))
    rows = monthly.join(last, "ticker").join(kind, "ticker", "left")
    touched = F.col("ret_fwd").isNull() & (F.col("month") == F.col("__last")) & F.col("class").isNotNull()
    value = F.when(F.col("class") == "acquired", 0.0).otherwise(shock)
    return rows.withColumns({"terminal": touched, "ret_fwd": F.when(touched, value).otherwise(F.col("ret_fwd"))}).drop("__last", "class")


def price_levels(floats: DataFrame, cover: DataFrame, splits: DataFrame, ciks: DataFrame, daily: DataFrame, membership: DataFrame, start: date, end: date, max_gap_days: int = 200) -> DataFrame:
    """(ticker, level, level_min, level_max, n_levels) of removed names: price times shares over the public float.

    For each float date inside the membership: the cover count dated nearest (the
    earlier of two as near), in the price basis, and the last close at most 40
    days old. Near 1 to 2 is a company's own price.
    """
    removed = membership.where("end is not null").groupBy("ticker").agg(F.min("start").alias("m_start"), F.max("end").alias("m_end"))
    f = first_filed(floats.withColumns({"concept": F.lit("x"), "qtrs": F.lit(0)})).select("cik", F.col("ddate").alias("float_date"), F.col("value").alias("float"))
    c = first_filed(cover.withColumns({"concept": F.lit("x"), "qtrs": F.lit(0)})).select("cik", F.col("ddate").alias("count_date"), F.col("filed").alias("cover_filed"), F.col("value").alias("count"))
    gap = F.abs(F.datediff("count_date", "float_date"))
    pairs = f.join(c, "cik").withColumn("gap", gap).where(F.col("gap") <= max_gap_days)
    nearest = F.row_number().over(Window.partitionBy("cik", "float_date").orderBy("gap", "count_date"))
    near = pairs.withColumn("__r", nearest).where("__r = 1").withColumn("month", F.last_day("float_date"))
    rows = near.join(era_at(ciks, start, end), ["month", "cik"]).join(removed, "ticker").where("float_date between m_start and m_end")
    rows = split_factor(rows, splits, "cover_filed")
    px = daily.select("ticker", F.col("date").alias("px_date"), "close").join(rows.select("ticker", "float_date").distinct(), "ticker").where(F.col("px_date").between(F.date_sub("float_date", 40), F.col("float_date")))
    px = px.groupBy("ticker", "float_date").agg(F.max_by("close", "px_date").alias("close"))
    level = rows.join(px, ["ticker", "float_date"]).withColumn("level", F.col("close") * F.col("count") * F.col("split_factor") / F.col("float"))
    return level.groupBy("ticker").agg(F.median("level").alias("level"), F.min("level").alias("level_min"), F.max("level").alias("level_max"), F.count("*").alias("n_levels"))


def identity_check(membership: DataFrame, quotes: DataFrame, first_prices: DataFrame, sec_names: DataFrame, levels: DataFrame, band: tuple[float, float] = (0.5, 20.0), history_start: date = date(1996, 1, 1), late_months: int = 24, min_overlap: float = 0.5) -> DataFrame:
    """One row for each ticker that ever left: does the price series belong to that company?

    ``quotes`` is (ticker, quote_name, exchange, currency, quote_type). Reasons are
    joined by "; "; a ticker is flagged for any reason but a missing quote.
    """
    low, high = band
    gone = membership.where("end is not null").groupBy("ticker").agg(
        F.array_join(F.sort_array(F.collect_set("security")), "|").alias("own_name"), F.min("start").alias("member_start"), F.max("end").alias("member_end")
    )
    rows = gone.join(first_prices, "ticker", "left").join(levels.select("ticker", "level", "n_levels"), "ticker", "left").join(sec_names, "ticker", "left")
    rows = rows.join(quotes.withColumn("__quoted", F.lit(True)), "ticker", "left")
    names = F.concat(F.split("own_name", r"\|"), F.when(F.col("sec_name").isNotNull(), F.split("sec_name", r"\|")).otherwise(F.array().cast("array<string>")))
    overlap = F.when(is_real_name("quote_name"), F.array_max(F.transform(names, lambda n: name_overlap(n, F.col("quote_name")))))
    rows = rows.withColumn("overlap", overlap)
    in_band = F.coalesce(F.col("level").between(low, high), F.lit(False))
    name_ok = F.coalesce(F.col("overlap") >= min_overlap, F.lit(False))
    quoted = F.coalesce(F.col("__quoted"), F.lit(False))
    live = quoted & ~F.coalesce(F.col("exchange").isin(*PLACEHOLDER_EXCHANGES) | F.col("quote_type").isin(*PLACEHOLDER_TYPES), F.lit(False))
    since = F.greatest("member_start", F.lit(history_start))
    late = (F.col("first_price") > F.add_months(since, late_months)) & (F.col("first_price") <= F.col("member_end")) & ~in_band
    reasons = F.array_compact(F.array(
        F.when(~quoted, "no_info"),
        F.when(quoted & F.col("overlap").isNotNull() & ~name_ok, F.format_string("name overlap %.2f", "overlap")),
        F.when(live & (F.col("currency") != "USD"), F.concat(F.lit("currency "), F.col("currency"))),
        F.when(live & ~F.col("exchange").isin(*US_EXCHANGES) & ~name_ok, F.concat(F.lit("exchange "), F.col("exchange"))),
        F.when(live & (F.col("quote_type") != "EQUITY"), F.concat(F.lit("quote type "), F.col("quote_type"))),
        F.when(F.col("level").isNotNull() & ~in_band, F.lit(f"price level outside [{low:g}, {high:g}]")),
        F.when(late, F.concat(F.lit("first price "), F.col("first_price").cast("string"), F.lit(" is late"))),
    ))
    flag = F.size(F.array_remove(reasons, "no_info")) > 0
    return rows.select("ticker", "own_name", "overlap", "first_price", "member_start", "member_end", "level", "n_levels", flag.alias("flag"), F.array_join(reasons, "; ").alias("reason"))


def names_by_ticker(ciks: DataFrame, filers: DataFrame) -> DataFrame:
    """(ticker, sec_name): the filers' names of all of a ticker's eras, distinct, sorted, joined by "|"."""
    joined = ciks.select("ticker", "cik").distinct().join(filers.select("cik", "name").distinct(), "cik")
    return joined.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias("sec_name"))

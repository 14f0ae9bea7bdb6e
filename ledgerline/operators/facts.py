"""Filed facts on a monthly panel: what was known when, trailing years, ratios, checks against public floats."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_after, month_on_or_before
from ledgerline.functions.numbers import near, percent, ratio
from ledgerline.operators.asof import asof_backward, first_filed
from ledgerline.operators.intervals import era_at
from ledgerline.operators.shares import split_factor

#: concept -> (tags in order of preference, kind); kinds: flow, annual_stock, latest_flow, stock.
TagMap = dict[str, tuple[list[str], str]]
ANNUAL = r"^10-K"


def tag_priority(spark, tag_map: TagMap) -> DataFrame:
    """(concept, tag, priority) rows of a tag map."""
    rows = [(concept, tags) for concept, (tags, _) in tag_map.items()]
    return spark.createDataFrame(rows, "concept string, tags array<string>").select("concept", F.posexplode("tags").alias("priority", "tag"))


def preferred(facts: DataFrame, priority: DataFrame) -> DataFrame:
    """One row for each filing, concept, period and length: the tag that comes first, then the larger value."""
    rows = facts.join(F.broadcast(priority), ["concept", "tag"])  # as long as the tag map
    best = F.row_number().over(Window.partitionBy("adsh", "concept", "ddate", "qtrs").orderBy("priority", F.col("value").desc()))
    return rows.withColumn("__r", best).where("__r = 1").drop("__r", "priority")


def trailing_year(facts: DataFrame) -> DataFrame:
    """(cik, concept, ddate, filed, value, source): the last four quarters of a flow.

    A part year of k quarters is completed by the year before it: + the annual
    value at the fiscal year's end - the same k quarters a year ago, known once
    all three are. Annual values stand for themselves.
    """
    ff = first_filed(facts.where("qtrs > 0")).select("cik", "concept", "ddate", "qtrs", "filed", "value")
    year = ff.where("qtrs = 4")
    part = ff.where("qtrs < 4").withColumns({"fye": F.last_day(F.add_months("ddate", -3 * F.col("qtrs"))), "prior": month_after("ddate", -12)})
    annual = year.select("cik", "concept", F.col("ddate").alias("fye"), F.col("filed").alias("f_year"), F.col("value").alias("v_year"))
    ago = ff.where("qtrs < 4").select("cik", "concept", "qtrs", F.col("ddate").alias("prior"), F.col("filed").alias("f_ago"), F.col("value").alias("v_ago"))
    joined = part.join(annual, ["cik", "concept", "fye"]).join(ago, ["cik", "concept", "qtrs", "prior"])
    rolled = joined.select("cik", "concept", "ddate", F.greatest("filed", "f_year", "f_ago").alias("filed"), (F.col("value") + F.col("v_year") - F.col("v_ago")).alias("value"), F.lit("rolled").alias("source"))
    return rolled.unionByName(year.select("cik", "concept", "ddate", "filed", "value", F.lit("annual").alias("source")))


def eligible(facts: DataFrame, kinds: DataFrame) -> DataFrame:
    """First-filed facts that fit their concept's kind, (cik, concept, ddate, filed, value)."""
    ff = first_filed(facts).join(F.broadcast(kinds), "concept")
    annual = F.col("form").rlike(ANNUAL)
    fits = (
        F.when(F.col("kind") == "flow", (F.col("qtrs") == 4) & annual)
        .when(F.col("kind") == "annual_stock", (F.col("qtrs") == 0) & annual)
        .when(F.col("kind") == "latest_flow", F.col("qtrs").isin(1, 4))
        .otherwise(F.col("qtrs") == 0)
    )
    shortest = F.row_number().over(Window.partitionBy("cik", "concept", "ddate", "filed").orderBy("qtrs", F.col("value").desc()))
    return ff.where(fits).withColumn("__r", shortest).where("__r = 1").select("cik", "concept", "ddate", "filed", "value")


def long_panel(months: DataFrame, facts: DataFrame, buffer_days: int, max_age: int) -> DataFrame:
    """(month, ticker, cik, concept, value, period_end, available_from): every concept as known at each month.

    ``months`` is (month, ticker, cik). All concepts go through one as-of join; a
    value whose period ended more than ``max_age`` months ago is null.
    """
    order = Window.partitionBy("cik", "concept").orderBy("filed", "ddate").rowsBetween(Window.unboundedPreceding, 0)
    fresh = facts.withColumn("__newest", F.max("ddate").over(order)).where("ddate >= __newest")
    ready = fresh.select("cik", "concept", "value", F.col("ddate").alias("period_end"), F.date_add("filed", buffer_days).alias("available_from"))
    asked = months.join(facts.select("cik", "concept").distinct(), "cik")
    known = asof_backward(asked, ready, ["cik", "concept"], "month", "available_from", ["value", "period_end", "available_from"], [F.col("period_end"), F.col("value")])
    stale = F.col("period_end") < F.add_months("month", -max_age)
    return known.where("period_end is not null").withColumn("value", F.when(~stale, F.col("value")))


def wide_panel(months: DataFrame, long: DataFrame, concepts: list[str]) -> DataFrame:
    """A column for each concept and its period end; rows are those of ``months``."""
    cells = [x for c in concepts for x in (F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c), F.max(F.when((F.col("concept") == c) & F.col("value").isNotNull(), F.col("period_end"))).alias(f"{c}_period_end"))]
    return months.join(long.groupBy("month", "ticker").agg(*cells), ["month", "ticker"], "left")


def signal(name: str, panel: DataFrame) -> DataFrame:
    """(month, ticker, value) of a ratio over panel columns; a name that ends in ``_ttm`` takes trailing-year flows."""
    ttm = name.endswith("_ttm")
    base = name.removesuffix("_ttm")

    def flow(c: str) -> Column:
        return F.col(f"{c}_ttm" if ttm else c)

    if base == "asset_growth":
        ago = panel.select("ticker", month_after("month", 12).alias("month"), F.col("assets").alias("__ago"))
        rows = panel.join(ago, ["month", "ticker"])
        value = -(ratio("assets", "__ago") - 1)
    else:
        rows = panel
        value = {
            "book_to_price": lambda: ratio("equity", "cap"),
            "earnings_yield": lambda: ratio(flow("net_income"), "cap"),
            "operating_profitability": lambda: F.when(F.coalesce("equity_fy", "equity") > 0, ratio(F.coalesce(flow("pretax_income"), flow("operating_income")), F.coalesce("equity_fy", "equity"))),
            "gross_profitability": lambda: F.when(F.coalesce(F.col("sector") != "Financials", F.lit(True)), ratio(F.coalesce(flow("gross_profit"), flow("revenue") - flow("cogs")), "assets")),
            "accruals": lambda: -ratio(flow("net_income") - flow("operating_cash_flow"), "assets"),
        }[base]()
    return rows.select("month", "ticker", value.alias("value")).where("value is not null")


def market_caps(shares: DataFrame, prices: DataFrame) -> DataFrame:
    """(month, ticker, cap, shares_source, split_factor) where both the count and the price are positive."""
    rows = shares.where("not implausible").join(prices.select("month", "ticker", "px_me_raw"), ["month", "ticker"]).where("n_basis > 0 and px_me_raw > 0")
    return rows.select("month", "ticker", (F.col("n_basis") * F.col("px_me_raw")).alias("cap"), "shares_source", "split_factor")


def float_reason(check: DataFrame, splits: DataFrame, low: float, high: float, years: int = 2, scale_min: float = 100.0) -> DataFrame:
    """``check`` with ``reason`` for flagged rows: float_scale, near_split, near_1000, over_100x or other."""
    size = F.when(F.col("flag") == "low", ratio(F.lit(1.0), "ratio")).otherwise(F.col("ratio"))
    rows = check.withColumn("__size", size)
    others = check.select("cik", F.col("fy").alias("__fy"), F.col("public_float").alias("__float")).hint("merge")
    adjacent = rows.where("flag <> ''").select("cik", "fy", "float_date", "cap").join(others, "cik").where((F.col("__fy") != F.col("fy")) & (F.abs(F.col("__fy") - F.col("fy")) <= years))
    scale = adjacent.groupBy("cik", "float_date").agg(F.bool_or(ratio("cap", "__float").between(low, high)).alias("__scale"))
    at = rows.select("ticker", "float_date", "__size").join(splits.select("ticker", "date", F.col("ratio").alias("__ratio")), "ticker")
    split = at.groupBy("ticker", "float_date", "__size").agg(
        F.bool_or(near("__size", F.col("__ratio"))).alias("__one"), F.coalesce(F.product(F.when(F.col("date") > F.col("float_date"), F.col("__ratio"))), F.lit(1.0)).alias("__after")
    )
    split = split.groupBy("ticker", "float_date").agg(F.bool_or(F.coalesce(F.col("__one") | near("__size", F.col("__after")), F.lit(False))).alias("__split"))
    joined = rows.join(scale.hint("merge"), ["cik", "float_date"], "left").join(split.hint("merge"), ["ticker", "float_date"], "left")
    reason = (
        F.when(F.col("flag") == "", "").when(F.coalesce("__scale", F.lit(False)) & (F.col("__size") >= scale_min), "float_scale").when(F.coalesce("__split", F.lit(False)), "near_split")
        .when(near("__size", 1000.0), "near_1000").when(F.col("__size") > 100, "over_100x").otherwise("other")
    )
    return joined.withColumn("reason", reason).drop("__size", "__scale", "__split")


def window_end(check: DataFrame, cover: DataFrame, splits: DataFrame, prices: DataFrame, low: float, high: float, months: int = 12) -> DataFrame:
    """``check`` with ``window_end`` of flagged rows: a year on, or the filing of the first later count that mends the ratio."""
    rows = check.withColumn("window_end", F.when(F.col("flag") != "", F.add_months("float_date", months)))
    counts = first_filed(cover.withColumns({"concept": F.lit("c"), "qtrs": F.lit(0)})).select("cik", F.col("ddate").alias("__cd"), F.col("filed").alias("__filed"), F.col("value").alias("__n"))
    later = rows.where("flag <> ''").select("ticker", "cik", "float_date", "public_float", "window_end").join(counts.hint("merge"), "cik")
    later = later.where("__cd > float_date and __filed <= window_end").withColumn("month", month_on_or_before("__cd"))
    later = split_factor(later.join(prices.select("month", "ticker", "px_me_raw").hint("merge"), ["month", "ticker"]), splits, "__filed")
    mended = ratio(F.col("px_me_raw") * F.col("__n") * F.col("split_factor"), "public_float").between(low, high)
    ends = later.where(mended).groupBy("ticker", "float_date").agg(F.min("__filed").alias("__end"))
    return rows.join(ends.hint("merge"), ["ticker", "float_date"], "left").withColumn("window_end", F.least("window_end", "__end")).drop("__end")


def public_float_check(floats: DataFrame, ciks: DataFrame, caps: DataFrame, prices: DataFrame, splits: DataFrame, cover: DataFrame, low: float, high: float, start: date, end: date, overrides: DataFrame | None = None) -> DataFrame:
    """Our market cap against the public float of each annual filing; too low, too high, or unflagged.

    Sides that grow with filings or prices are merged: a few compressed MB of them,
    which Spark would broadcast, are a hundred in the driver's memory.
    """
    ff = first_filed(floats.withColumns({"concept": F.lit("f"), "qtrs": F.lit(0)})).select("cik", F.col("ddate").alias("float_date"), "fy", F.col("value").alias("public_float"))
    rows = ff.withColumn("month", month_on_or_before("float_date")).join(era_at(ciks, start, end), ["month", "cik"]).withColumn("float_source", F.lit("xbrl"))
    if overrides is not None:
        o = overrides.select("ticker", "fy", F.col("float_date").alias("__d"), F.col("public_float").alias("__f"))
        rows = rows.join(o, ["ticker", "fy"], "left").withColumns({
            "float_source": F.when(F.col("__f").isNotNull(), "override").otherwise(F.col("float_source")),
            "public_float": F.coalesce("__f", "public_float"), "float_date": F.coalesce("__d", "float_date"),
        }).drop("__d", "__f")
        rows = rows.withColumn("month", month_on_or_before("float_date"))
    rows = rows.join(prices.select("month", "ticker", F.col("px_me_raw").alias("close")).hint("merge"), ["month", "ticker"], "left").join(caps.select("month", "ticker", "cap", "shares_source").hint("merge"), ["month", "ticker"], "left")
    rows = rows.withColumns({"shares": ratio("cap", "close"), "ratio": ratio("cap", "public_float")})
    rows = rows.withColumn("flag", F.when(F.col("ratio") < low, "low").when(F.col("ratio") > high, "high").otherwise(""))
    return window_end(float_reason(rows, splits, low, high), cover, splits, prices, low, high)


def public_float_summary(check: DataFrame) -> DataFrame:
    """By fiscal year: checked, with a ratio, flagged low and high, and by reason."""
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in ("float_scale", "near_split", "near_1000", "over_100x", "other")]
    return check.groupBy("fy").agg(F.count("*").alias("rows"), F.count("ratio").alias("with_ratio"), F.count_if(F.col("flag") == "low").alias("low"), F.count_if(F.col("flag") == "high").alias("high"), *reasons)


def bank_revenue(panel: DataFrame) -> DataFrame:
    """Revenue of financials without one: net interest and other income; ``revenue_source`` says which."""
    bank = (F.col("sector") == "Financials") & F.col("revenue").isNull()
    made, made_ttm = F.col("net_interest_income") + F.col("noninterest_income"), F.col("net_interest_income_ttm") + F.col("noninterest_income_ttm")
    source = F.when(F.col("revenue").isNotNull(), "tag").when(bank & made.isNotNull(), "derived_bank")
    ttm = F.when((F.col("sector") == "Financials") & F.col("revenue_ttm").isNull(), made_ttm).otherwise(F.col("revenue_ttm"))
    return panel.withColumns({"revenue_source": source, "revenue": F.when(bank, made).otherwise(F.col("revenue")), "revenue_ttm": ttm})


def revenue_sources(panel: DataFrame, members: DataFrame) -> DataFrame:
    """By December: members whose revenue is tagged, derived or missing."""
    rows = members.where(F.month("month") == 12).join(panel.select("month", "ticker", "revenue_source"), ["month", "ticker"], "left")
    s = F.col("revenue_source")
    return rows.groupBy("month").agg(F.count("*").alias("members"), F.count_if(s == "tag").alias("tag"), F.count_if(s == "derived_bank").alias("derived"), F.count_if(s.isNull()).alias("missing"))


def tag_coverage(facts: DataFrame, n_universe: int) -> DataFrame:
    """By concept and fiscal year: filers, the most used tag (of ties the first by name), share of the universe."""
    tags = facts.groupBy("concept", "fy", "tag").agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("concept", "fy").orderBy(F.col("n").desc(), "tag"))
    modal = tags.withColumn("__r", top).where("__r = 1").select("concept", "fy", F.col("tag").alias("modal_tag"))
    ciks = facts.groupBy("concept", "fy").agg(F.countDistinct("cik").alias("n_ciks"))
    return ciks.join(modal, ["concept", "fy"]).withColumn("pct", percent(F.col("n_ciks"), F.lit(n_universe)))


def concept_coverage(panel: DataFrame, members: DataFrame, concepts: list[str]) -> DataFrame:
    """By month: members, and how many have each concept."""
    rows = members.join(panel.select("month", "ticker", *concepts), ["month", "ticker"], "left")
    return rows.groupBy("month").agg(F.count("*").alias("members"), *(F.count(c).alias(c) for c in concepts))


def amendments(facts: DataFrame) -> DataFrame:
    """By filing year: distinct filings, amendments among them, and their share."""
    rows = facts.select("adsh", "form", F.year("filed").alias("year")).distinct()
    out = rows.groupBy("year").agg(F.count("*").alias("filings"), F.count_if(F.endswith("form", F.lit("/A"))).alias("amended"))
    return out.withColumn("pct", percent(F.col("amended"), F.col("filings")))


def candidate_tags(facts: DataFrame, concept: str, fy: int, limit: int = 40) -> DataFrame:
    """Tags that filers without the concept use in a year, by how many use them: a top-k report."""
    year = facts.where(F.col("fy") == fy)
    have = year.where(F.col("concept") == concept).select("cik").distinct()
    rows = year.join(have, "cik", "left_anti").groupBy("tag").agg(F.countDistinct("cik").alias("n_ciks"), F.min("adsh").alias("example"))
    return rows.orderBy(F.col("n_ciks").desc(), "tag").limit(limit)


def missing_filers(facts: DataFrame, universe: DataFrame, concept: str, fy: int) -> DataFrame:
    """(cik) in the universe that filed in a year, but not the concept."""
    year = facts.where(F.col("fy") == fy)
    return year.select("cik").distinct().join(year.where(F.col("concept") == concept), "cik", "left_anti").join(universe, "cik", "left_semi")

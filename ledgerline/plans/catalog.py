"""Registry of the analytic queries over the warehouse tables; ``oracles`` has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.config import Config
from ledgerline.functions import names, normal, references, words
from ledgerline.functions.dates import month_after, month_on_or_before, parse_date
from ledgerline.functions.numbers import average_rank, near, outside
from ledgerline.operators import audit, calendar, facts, intervals, portfolio, prices, sectors, shares, signals, speclog, stats, textsim, universe
from ledgerline.operators.asof import asof_backward, asof_forward_all, first_filed, known_by
from ledgerline.plans.oracles import ORACLES
from ledgerline.sources import market
from ledgerline.sources.store import settled

__all__ = ["ORACLES", "QUERIES", "flagship"]

CFG = Config()
RELIABLE = date(1995, 1, 1)
CONCEPTS = ["c1", "c2", "c3", "c4", "c5"]
KINDS = [("c1", "flow"), ("c2", "annual_stock"), ("c3", "latest_flow"), ("c4", "stock"), ("c5", "stock")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Market(spark, sf_dir))
    return f


def r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Sums of floating-point numbers depend on the order of rows in their last digits."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def kept(f: Callable[[Market], DataFrame]) -> cached_property:
    """An input that a plan reads several times: written once for a query."""
    return cached_property(lambda self: settled(f(self), f.__name__))


class Market:
    """The inputs of the queries, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return market.table(self.spark, self.sf_dir, name)

    @kept
    def daily(self) -> DataFrame:
        return market.daily_prices(self.spark, self.sf_dir)

    @cached_property
    def second(self) -> DataFrame:
        """Another vendor: the open lines alone."""
        return market.daily_prices(self.spark, self.sf_dir, "l_linestatus = 'F'")

    @cached_property
    def members(self) -> DataFrame:
        return market.membership(self.spark, self.sf_dir)

    @cached_property
    def panel(self) -> DataFrame:
        return intervals.member_panel(self.members, CFG.start, CFG.end)

    @cached_property
    def sectors(self) -> DataFrame:
        return market.sectors(self.spark, self.sf_dir)

    @cached_property
    def ciks(self) -> DataFrame:
        return market.ciks(self.spark, self.sf_dir)

    @cached_property
    def filings(self) -> DataFrame:
        return market.filings(self.spark, self.sf_dir)

    @cached_property
    def splits(self) -> DataFrame:
        return market.splits(self.spark, self.sf_dir)

    @cached_property
    def factors(self) -> DataFrame:
        return market.market_factors(self.spark, self.sf_dir)

    @kept
    def monthly(self) -> DataFrame:
        return prices.monthly_returns(self.daily, CFG.lag_days, CFG.start, CFG.end)

    @cached_property
    def month_ends(self) -> DataFrame:
        return calendar.month_end_trading_days(self.daily, CFG.start, CFG.end)

    @kept
    def z(self) -> DataFrame:
        raw = r(signals.momentum(self.monthly), "value", digits=9)
        return r(signals.normalise(raw, self.sectors, CFG.winsor, CFG.min_sector_names), "z", digits=9)

    @kept
    def reversal_z(self) -> DataFrame:
        raw = r(signals.momentum(self.monthly, 1, 0), "value", digits=9)
        return r(signals.normalise(raw, None, CFG.winsor), "z", digits=9)

    @kept
    def deciles(self) -> DataFrame:
        return portfolio.backtest(self.z, self.monthly, CFG.n_deciles, CFG.cost, 1, CFG.min_names)

    @cached_property
    def spread(self) -> DataFrame:
        return r(portfolio.long_short(self.deciles, CFG.n_deciles, CFG.cost), "ret_gross", "turnover", "ret_net", digits=9)

    @cached_property
    def caps(self) -> DataFrame:
        """Month-end price times the quantity traded in the month."""
        volume = self.daily.groupBy("ticker", F.last_day("date").alias("month")).agg(F.sum("volume").alias("v"))
        return self.monthly.join(volume.hint("merge"), ["month", "ticker"]).select("month", "ticker", F.round(F.col("px_me") * F.col("v"), 6).alias("cap"), F.lit("cover").alias("shares_source"))

    @cached_property
    def raw_prices(self) -> DataFrame:
        return self.monthly.select("month", "ticker", F.col("px_me").alias("px_me_raw"))

    @cached_property
    def cik_months(self) -> DataFrame:
        """(month, ticker, cik) of members."""
        return self.panel.join(intervals.era_at(self.ciks, CFG.start, CFG.end), ["month", "ticker"])

    @cached_property
    def kinds(self) -> DataFrame:
        return self.spark.createDataFrame(KINDS, "concept string, kind string")

    @kept
    def long(self) -> DataFrame:
        return facts.long_panel(self.cik_months, facts.eligible(self.filings, self.kinds), CFG.filing_buffer_days, CFG.max_age_months)

    @cached_property
    def wide(self) -> DataFrame:
        return facts.wide_panel(self.cik_months, self.long, CONCEPTS)

    @cached_property
    def share_panel(self) -> DataFrame:
        """Three share counts a month that agree but for units errors and a recapitalisation."""
        k, m = F.substring("ticker", 2, 20).cast("long"), F.month("month")
        base = (1000.0 + 37 * k) * 1000
        cover = F.when((k + m) % 11 == 0, base / 1000).when((k + m) % 7 == 0, None).otherwise(base)
        sheet, wavg = F.when(k % 9 == 0, base / 1000).otherwise(base * 1.1), F.when(k % 9 == 0, base / 1000).otherwise(base * 1.2)
        filed = F.add_months("month", -2)
        return self.panel.select("month", "ticker", cover.alias("shares_cover"), filed.alias("shares_cover_filed"), sheet.alias("shares"), filed.alias("shares_filed"), wavg.alias("shares_wavg"), F.add_months("month", -3).alias("shares_wavg_filed"))

    @kept
    def fundamentals(self) -> DataFrame:
        """The panel under the names that the ratios use."""
        named = self.wide.select("month", "ticker", F.col("c1").alias("revenue"), F.col("c2").alias("equity"), F.col("c3").alias("net_income"), F.col("c4").alias("assets"), F.col("c5").alias("cogs"))
        none = F.lit(None).cast("double")
        named = named.withColumns({"equity_fy": none, "pretax_income": none, "operating_income": F.col("net_income"), "gross_profit": none, "operating_cash_flow": F.col("cogs")})
        sector = F.when(F.col("sector") == "ASIA", "Financials").otherwise(F.col("sector"))
        return named.join(self.caps.select("month", "ticker", "cap"), ["month", "ticker"], "left").join(self.sectors.select("ticker", sector.alias("sector")), "ticker", "left")

    @kept
    def float_check(self) -> DataFrame:
        floats, covers = market.floats(self.spark, self.sf_dir), market.covers(self.spark, self.sf_dir)
        return facts.public_float_check(floats, self.ciks, self.caps, self.raw_prices, self.splits, covers, *CFG.float_band, CFG.start, CFG.end)

    @cached_property
    def doc_index(self) -> DataFrame:
        """Documents as yearly filings of a (source, lang)."""
        d = self.table("documents").select("doc_id", "source", "lang")
        cik = F.concat_ws("-", "source", "lang")
        filed = F.date_add(F.lit("1995-03-31").cast("date"), (F.col("doc_id") % 2400).cast("int"))
        return d.select(F.col("doc_id").alias("adsh"), cik.alias("cik"), F.last_day(F.add_months(filed, -3)).alias("period"), filed.alias("filed"), filed.alias("accepted"))

    @kept
    def word_counts(self) -> DataFrame:
        return textsim.word_counts(self.table("documents"), "doc_id", "text")

    @kept
    def scored(self) -> DataFrame:
        return r(textsim.score(textsim.neighbours(self.doc_index), self.table("documents"), 20, "doc_id"), "cosine", "jaccard", digits=9)

    @cached_property
    def walk(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return universe.build_membership(market.constituents(self.spark, self.sf_dir), market.changes(self.spark, self.sf_dir), RELIABLE)

    @cached_property
    def spec_log(self) -> DataFrame:
        """Orders seen as logged runs."""
        o = self.table("orders")
        text = lambda c: F.col(c).cast("string")
        note = F.when(F.col("o_orderkey") % 3 == 0, "sensitivity terminal").when(F.col("o_orderkey") % 3 == 1, "base no-sector").otherwise("base")
        rows = o.select(
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.lpad(text("o_orderkey"), 12, "0")).alias("timestamp"), F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("factor"),
            F.concat(F.lit("s"), (F.col("o_custkey") % 2).cast("string")).alias("signal"), F.lit("ew").alias("weighting"), F.lit("1").alias("holding_months"), F.lit("10").alias("n_deciles"), note.alias("note"), text("o_totalprice").alias("sharpe_net"), F.substring(F.md5(text("o_custkey").cast("binary")), 1, 6).alias("git_commit"),
        )
        return speclog.upgrade(rows).withColumn("spec_key", names.spec_key_column())


# --- calendar, intervals, universe ---


@query
def month_end_days(m: Market) -> DataFrame:
    return m.month_ends


@query
def rebalance(m: Market) -> DataFrame:
    return calendar.rebalance_dates(m.daily, 3, CFG.start, CFG.end)


@query
def calendar_shift(m: Market) -> DataFrame:
    days = m.members.select("start").distinct()
    return calendar.shift_on_calendar(m.daily, days, "start", 5, "later")


@query
def month_on_or_before_dates(m: Market) -> DataFrame:
    return m.table("events").select(F.col("ts").cast("date").alias("d")).distinct().select("d", month_on_or_before("d").alias("month"), month_after("d", 3).alias("later"))


@query
def members_on_day(m: Market) -> DataFrame:
    return intervals.members_at(m.members, date(1997, 6, 30))


@query
def member_months(m: Market) -> DataFrame:
    return m.panel


@query
def member_counts(m: Market) -> DataFrame:
    return intervals.monthly_counts(m.spark, m.members, CFG.start, CFG.end)


def _exclusions(m: Market) -> DataFrame:
    return m.members.where("substring(ticker, 2, 20) % 6 = 0").select("ticker", F.date_add("start", 100).alias("start"), F.date_add("start", 400).alias("end"))


@query
def cross_section(m: Market) -> DataFrame:
    return intervals.exclude(m.panel, _exclusions(m), CFG.start, CFG.end)[0]


@query
def exclusion_log(m: Market) -> DataFrame:
    return intervals.exclude(m.panel, _exclusions(m), CFG.start, CFG.end)[1]


@query
def cik_eras(m: Market) -> DataFrame:
    return intervals.era_at(m.ciks, CFG.start, CFG.end)


def _other_view(m: Market) -> DataFrame:
    """The panel as another list has it: a few names are missing, a few have another symbol."""
    k = F.substring("ticker", 2, 20).cast("long")
    return m.panel.where(k % 8 != 0).withColumn("ticker", F.when(k % 10 == 1, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.col("ticker")))


@query
def compare_months(m: Market) -> DataFrame:
    return intervals.compare(m.panel, _other_view(m))[0]


@query
def compare_alone(m: Market) -> DataFrame:
    return intervals.compare(m.panel, _other_view(m))[1]


@query
def reconcile_aliases(m: Market) -> DataFrame:
    return intervals.aliases(intervals.compare(m.panel, _other_view(m))[1])


@query
def reconcile_months(m: Market) -> DataFrame:
    return intervals.reconcile(m.panel, _other_view(m))[0]


@query
def override_starts(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    o = m.members.where(k % 4 == 0).select("ticker", F.date_sub("start", 30).alias("start"), "end").unionByName(m.members.where(k % 9 == 0).select(F.concat(F.lit("N"), "ticker").alias("ticker"), "start", "end"))
    return intervals.apply_overrides(m.members.select("ticker", "start", "end"), o)


@query
def snapshot_asof(m: Market) -> DataFrame:
    snaps = m.panel.where(F.month("month") == 12).groupBy(F.col("month").alias("date")).agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
    return intervals.snapshot_at(snaps, m.members.select(F.col("start").alias("date")).distinct())


@query
def adjudicated_starts(m: Market) -> DataFrame:
    rows = m.members.withColumn("start_source", F.when(F.col("end").isNull(), "unverified:date_added").otherwise("changes"))
    seen = m.panel.where(F.month("month") % 6 == 0).select(F.col("month").alias("date"), "ticker").unionByName(m.members.where("substring(ticker, 2, 20) % 2 = 0").select(F.last_day(F.add_months("start", -2)).alias("date"), "ticker")).distinct()
    return intervals.adjudicate(rows, seen).select("ticker", "start", "end", "decision")


@query
def membership_walk(m: Market) -> DataFrame:
    return m.walk[0].select("ticker", "start", "end", "start_source", "end_source")


@query
def membership_problems(m: Market) -> DataFrame:
    return m.walk[1]


@query
def membership_renames(m: Market) -> DataFrame:
    return m.walk[2]


@query
def membership_summary(m: Market) -> DataFrame:
    return universe.summary(m.walk[0])


# --- prices ---


@query
def daily_vwap(m: Market) -> DataFrame:
    return m.daily


@query
def clean_prices(m: Market) -> DataFrame:
    return prices.clean_daily(m.daily, m.members, 1.4, 1.8)[0]


@query
def clean_log(m: Market) -> DataFrame:
    return prices.clean_daily(m.daily, m.members, 1.4, 1.8)[1]


@query
def monthly_prices(m: Market) -> DataFrame:
    return prices.monthly_prices(m.daily, CFG.lag_days, CFG.start, CFG.end)


@query
def monthly_returns(m: Market) -> DataFrame:
    return r(m.monthly, "ret_cal", "ret_fwd")


@query
def daily_returns(m: Market) -> DataFrame:
    return r(prices.daily_returns(m.daily), "ret")


@query
def price_coverage(m: Market) -> DataFrame:
    return prices.coverage(m.members, m.monthly, CFG.start, CFG.end)[0]


@query
def price_gaps(m: Market) -> DataFrame:
    return prices.coverage(m.members, m.monthly, CFG.start, CFG.end)[1]


@query
def month_end_returns(m: Market) -> DataFrame:
    return r(prices.month_end_returns(m.daily), "ret")


@query
def source_conflicts(m: Market) -> DataFrame:
    return r(prices.reconcile_sources(m.daily, m.second, 0.2), "ret_a", "ret_b", "diff")


@query
def merged_sources(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    return prices.merge_sources(m.daily.where(k % 6 != 0), m.second, 0.5)


def _delistings(m: Market) -> DataFrame:
    return m.members.where("end is not null and substring(ticker, 2, 20) % 4 <> 1").select("ticker", F.date_add("end", 3).alias("delisting_date"))


def _until_removed(m: Market) -> DataFrame:
    """Prices that stop when the name leaves."""
    last = m.members.select("ticker", F.col("end").alias("__e"))
    return m.daily.join(last, "ticker").where("__e is null or date <= __e").drop("__e")


@query
def removed_names(m: Market) -> DataFrame:
    return prices.classify_removed(m.members, _until_removed(m), _delistings(m))


@query
def terminal_returns(m: Market) -> DataFrame:
    daily = _until_removed(m)
    monthly = prices.monthly_returns(daily, CFG.lag_days, CFG.start, CFG.end)
    return r(prices.terminal_returns(monthly, m.members, daily, _delistings(m), -0.3), "ret_cal", "ret_fwd")


@query
def price_levels(m: Market) -> DataFrame:
    levels = prices.price_levels(market.floats(m.spark, m.sf_dir), market.covers(m.spark, m.sf_dir), m.splits, m.ciks, m.daily, m.members, CFG.start, CFG.end)
    return r(levels, "level", "level_min", "level_max", digits=9)


@query
def identity_flags(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    quotes = m.members.where(k % 5 != 0).select("ticker", F.when(k % 4 == 1, "Another Company Inc").otherwise(F.concat("security", F.lit(" Corp"))).alias("quote_name"), F.when(k % 3 == 1, "PNK").otherwise("NYQ").alias("exchange"), F.when(k % 7 == 2, "EUR").otherwise("USD").alias("currency"), F.when(k % 11 == 0, "ETF").otherwise("EQUITY").alias("quote_type"))
    first = m.daily.groupBy("ticker").agg(F.min("date").alias("first_price"))
    levels = m.members.where(k % 2 == 0).select("ticker", (k % 30).cast("double").alias("level"), F.lit(1).cast("long").alias("n_levels"))
    filers = m.table("customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"))
    return r(prices.identity_check(m.members, quotes, first, prices.names_by_ticker(m.ciks, filers), levels), "overlap").drop("n_levels")


# --- facts ---


@query
def first_filings(m: Market) -> DataFrame:
    return first_filed(m.filings)


@query
def preferred_tags(m: Market) -> DataFrame:
    priority = facts.tag_priority(m.spark, {c: ([f"Tag{i}", f"Tag{(i + 1) % 3}"], "flow") for i, c in enumerate(CONCEPTS[:3])})
    return facts.preferred(m.filings, priority)


@query
def facts_known(m: Market) -> DataFrame:
    one = first_filed(m.filings.where("concept = 'c1'")).select("cik", "ddate", "filed", "value")
    return known_by(m.cik_months, one, CFG.filing_buffer_days)


@query
def trailing_year(m: Market) -> DataFrame:
    wider = m.filings.withColumns({"cik": F.col("cik") % 20, "concept": F.lit("c")})
    return r(facts.trailing_year(wider), "value", digits=2)


@query
def panel_long(m: Market) -> DataFrame:
    return m.long


@query
def panel_wide(m: Market) -> DataFrame:
    return m.wide


@query
def fundamental_signals(m: Market) -> DataFrame:
    out = None
    for name in ("book_to_price", "earnings_yield", "operating_profitability", "gross_profitability", "accruals", "asset_growth"):
        one = facts.signal(name, m.fundamentals).select(F.lit(name).alias("signal"), "month", "ticker", F.round("value", 9).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def share_counts(m: Market) -> DataFrame:
    return r(shares.resolve(m.share_panel, m.splits, None, None), "n_shares", "n_basis")


@query
def share_counts_pinned(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    pins = m.members.where(k % 5 == 1).select("ticker", F.when(k % 2 == 1, "balance_sheet").otherwise("unresolved").alias("source"))
    return r(shares.resolve(m.share_panel, m.splits, pins, m.raw_prices, (1e9, 5e9)), "n_shares", "n_basis")


@query
def market_caps(m: Market) -> DataFrame:
    return r(facts.market_caps(shares.resolve(m.share_panel, m.splits), m.raw_prices), "cap", digits=4)


@query
def split_factors(m: Market) -> DataFrame:
    return shares.split_factor(m.members.select("ticker", "start"), m.splits, "start")


@query
def share_crosscheck(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    ours = m.members.select("ticker", (100.0 + k).alias("shares"), (1000.0 + k).alias("cap"))
    theirs = m.members.where(k % 7 != 0).select("ticker", (100.0 + 2 * k).alias("shares"), (900.0 + k).alias("cap"))
    return r(shares.crosscheck(ours, theirs), "ratio", "cap_ratio")


@query
def float_checks(m: Market) -> DataFrame:
    cols = ["ticker", "cik", "fy", "float_date", "public_float", "month", "close", "cap", "ratio", "flag", "reason", "window_end"]
    return r(m.float_check.select(*cols), "ratio", "cap")


@query
def float_summary(m: Market) -> DataFrame:
    return facts.public_float_summary(m.float_check)


@query
def float_exclusions(m: Market) -> DataFrame:
    return intervals.float_windows(m.float_check).select("ticker", "start", "end")


def _bank_panel(m: Market) -> DataFrame:
    return m.fundamentals.select("month", "ticker", "sector", "revenue", F.col("revenue").alias("revenue_ttm"), F.col("net_income").alias("net_interest_income"), F.col("assets").alias("noninterest_income"), F.col("net_income").alias("net_interest_income_ttm"), F.col("cogs").alias("noninterest_income_ttm"))


@query
def bank_revenue(m: Market) -> DataFrame:
    return r(facts.bank_revenue(_bank_panel(m)), "revenue", "revenue_ttm", digits=2)


@query
def revenue_sources(m: Market) -> DataFrame:
    return facts.revenue_sources(facts.bank_revenue(_bank_panel(m)), m.panel)


@query
def tag_coverage(m: Market) -> DataFrame:
    return facts.tag_coverage(m.filings, 1000)


@query
def concept_coverage(m: Market) -> DataFrame:
    return facts.concept_coverage(m.wide, m.panel, CONCEPTS)


@query
def amendments(m: Market) -> DataFrame:
    return facts.amendments(m.filings)


@query
def candidate_tags(m: Market) -> DataFrame:
    return facts.candidate_tags(m.filings, "c1", 1997)


@query
def missing_filers(m: Market) -> DataFrame:
    return facts.missing_filers(m.filings, m.ciks.select("cik").distinct(), "c2", 1998)


@query
def cik_matches(m: Market) -> DataFrame:
    """Nations as names to match: customers' and suppliers' names share their first words."""
    k = F.substring("ticker", 2, 20).cast("long")
    members = m.members.select("ticker", F.when(k % 4 == 0, F.concat(F.lit("Big "), "security", F.lit(" & Co. Inc"))).when(k % 4 == 1, F.concat(F.lit("Alpha Beta "), k.cast("string"))).otherwise(F.col("security")).alias("security"))
    filers = m.members.select((k + 5000).alias("cik"), F.when(k % 4 == 0, F.concat(F.lit("BIG "), F.upper("security"), F.lit(" AND CO"))).when(k % 8 == 2, F.replace("security", F.lit("#"), F.lit(" "))).otherwise(F.concat(F.lit("Other "), "security")).alias("name"))
    listed = m.members.where(k % 9 == 0).select("ticker", (k + 5000).alias("cik"))
    current = m.members.where("end is null").select("ticker", F.when(k % 2 == 0, k + 7000).alias("cik"))
    return sectors.cik_map(members, filers, listed, current)


@query
def sic_sectors(m: Market) -> DataFrame:
    return m.table("part").select("p_partkey", (F.col("p_partkey") % 9000 + 100).alias("sic")).withColumn("sector", names.sic_to_sector("sic"))


@query
def sector_agreement(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    return sectors.agreement(m.sectors.withColumn("sector", F.when(k % 6 == 0, "ASIA").otherwise(F.col("sector"))), m.sectors)


# --- names and text ---


@query
def clean_names(m: Market) -> DataFrame:
    p = m.table("part").select("p_partkey", F.concat("p_name", F.lit(" Holdings & Co. Inc")).alias("name"), F.col("p_brand").alias("brand"))
    return p.select("p_partkey", names.normalise_name("name").alias("normalised"), names.clean_ticker(F.upper("brand")).alias("token"), names.dashed(F.concat("brand", F.lit(".B"))).alias("dashed"), F.round(names.name_overlap("name", F.col("brand")), 6).alias("overlap"), names.is_real_name("brand").alias("real"))


@query
def parsed_dates(m: Market) -> DataFrame:
    e = m.table("events").select("event_id", F.col("ts"))
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "'on 'yyyy-MM-dd' or so'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MMMM d, yyyy")).otherwise("no date")
    return e.select("event_id", parse_date(text).alias("d"))


@query
def json_numbers(m: Market) -> DataFrame:
    return m.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query
def page_words(m: Market) -> DataFrame:
    return m.table("pages").select("page_id", F.explode(words.to_words("html")).alias("word")).groupBy("page_id", "word").agg(F.count("*").alias("n"))


@query
def unescaped_pages(m: Market) -> DataFrame:
    """Each page without character references, and ten references of its own: by name, by a name cut short, by number."""
    name = F.get(F.array(*map(F.lit, sorted(html5))), (F.col("k") % len(html5)).cast("int"))
    rows = m.table("pages").select("page_id", "html", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).withColumn("k", F.coalesce("page_id", F.lit(0)) * 10 + F.col("i"))
    text = F.concat(F.lit("a&"), name, F.lit("b&"), F.rtrim(name, F.lit(";")), F.lit("cd &#"), (F.col("k") % 50_000 + 161).cast("string"), F.lit(";"))
    return rows.select("page_id", "i", references.unescape(text).alias("plain"), F.when(F.col("i") == 0, F.md5(references.unescape(F.col("html")).cast("binary"))).alias("digest"))


@query
def document_words(m: Market) -> DataFrame:
    return m.word_counts


@query
def filing_pairs(m: Market) -> DataFrame:
    return textsim.neighbours(m.doc_index)


@query
def filing_similarity(m: Market) -> DataFrame:
    return m.scored


@query
def text_signal(m: Market) -> DataFrame:
    months = m.doc_index.select("cik").distinct().join(F.broadcast(calendar.month_ends(m.spark, CFG.start, CFG.end)))  # a row a month
    return textsim.signal(months.withColumn("ticker", F.col("cik")), m.scored, "cosine", 1, 18)


@query
def text_coverage(m: Market) -> DataFrame:
    return textsim.coverage(m.doc_index, textsim.lengths(m.table("documents"), "doc_id"), m.scored, 20)


# --- signals ---


@query
def momentum(m: Market) -> DataFrame:
    return r(signals.momentum(m.monthly), "value")


@query
def volatility(m: Market) -> DataFrame:
    return r(signals.volatility(prices.daily_returns(m.daily), m.month_ends, 60), "value")


@query
def market_beta(m: Market) -> DataFrame:
    returns = r(prices.daily_returns(m.daily), "ret", digits=9)
    # means of few returns often lie half way between two last digits: rounded as the SQL does it, by scaling
    mkt = returns.where("ret is not null").groupBy("date").agg((F.round(F.avg("ret") * 1e9) / 1e9).alias("mkt"))
    return r(signals.beta(returns, mkt, m.month_ends, 60), "value")


@query
def winsorised(m: Market) -> DataFrame:
    return r(signals.winsorise(signals.momentum(m.monthly), *CFG.winsor), "value")


@query
def sector_scores(m: Market) -> DataFrame:
    return r(m.z, "z")


@query
def composite_scores(m: Market) -> DataFrame:
    return r(signals.composite([m.z, m.reversal_z]), "z")


@query
def forward_returns(m: Market) -> DataFrame:
    return r(stats.forward_returns(m.monthly, [1, 2, 3, 6, 12]), "ret")


# --- portfolios ---


@query
def deciles(m: Market) -> DataFrame:
    return portfolio.assign_deciles(m.z, CFG.n_deciles).select("month", "ticker", "decile")


@query
def equal_weights(m: Market) -> DataFrame:
    return r(portfolio.weights(portfolio.assign_deciles(m.z, CFG.n_deciles)), "w")


@query
def cap_weights(m: Market) -> DataFrame:
    return r(portfolio.weights(portfolio.assign_deciles(m.z, CFG.n_deciles), m.caps), "w")


@query
def backtest_monthly(m: Market) -> DataFrame:
    return r(m.deciles, "ret_gross", "turnover", "ret_net")


@query
def backtest_held(m: Market) -> DataFrame:
    return r(portfolio.backtest(m.z, m.monthly, CFG.n_deciles, CFG.cost, 3, CFG.min_names), "ret_gross", "turnover", "ret_net")


@query
def backtest_cap_weighted(m: Market) -> DataFrame:
    return r(portfolio.backtest(m.z, m.monthly, CFG.n_deciles, CFG.cost, 1, CFG.min_names, m.caps), "ret_gross", "turnover", "ret_net")


@query
def long_short(m: Market) -> DataFrame:
    return r(m.spread, "ret_gross", "turnover", "ret_net")


@query
def hedged_spread(m: Market) -> DataFrame:
    return r(portfolio.beta_hedge(m.spread, m.factors), "ret_gross", "beta", "hedged")


@query
def benchmark_fit(m: Market) -> DataFrame:
    return r(portfolio.validate(m.spread, m.factors, "mkt_rf"), "corr")


@query
def odd_months(m: Market) -> DataFrame:
    series = r(m.deciles, "ret_gross", digits=9).select("decile", "month", "ret_gross")
    return r(portfolio.odd_months(series, ["decile"], sigmas=2.0), "ret_gross", "z")


# --- statistics ---


@query
def rank_ic(m: Market) -> DataFrame:
    return r(stats.ic_series(m.z, m.monthly), "ic")


@query
def rank_ic_summary(m: Market) -> DataFrame:
    return r(stats.mean_t(r(stats.ic_series(m.z, m.monthly), "ic", digits=9), "ic"), "mean", "t", "ir")


@query
def rank_ic_decay(m: Market) -> DataFrame:
    return r(stats.ic_decay(m.z, m.monthly, [1, 2, 3, 6, 12]), "ic")


@query
def average_ranks(m: Market) -> DataFrame:
    return m.monthly.select("month", "ticker", F.round("px_me", 0).alias("v")).withColumn("rank", average_rank("v", "month"))


@query
def premium_slopes(m: Market) -> DataFrame:
    return r(stats.slopes(m.z, m.monthly), "slope")


@query
def premium(m: Market) -> DataFrame:
    return r(stats.fama_macbeth(m.z, m.monthly, CFG.nw_lags), "premium", "se", "t")


@query
def robust_variance(m: Market) -> DataFrame:
    series = r(m.deciles, "ret_gross", digits=9)
    return r(stats.newey_west(series, "ret_gross", CFG.nw_lags, ["decile"]), "mean", "variance", digits=9)


@query
def decile_performance(m: Market) -> DataFrame:
    series = r(m.deciles, "ret_net", digits=9)
    return r(stats.performance(series, ["decile"]), "mean", "sd", "sharpe", "skew", "kurtosis", "max_drawdown")


@query
def cost_grid(m: Market) -> DataFrame:
    return r(stats.sharpe_by_cost(m.spread, [0, 5, 10, 20, 50]), "sharpe")


@query
def breakeven(m: Market) -> DataFrame:
    return r(stats.breakeven_cost(m.spread), "cost")


@query
def recessions(m: Market) -> DataFrame:
    return stats.islands(m.factors.select("month", (F.col("mkt_rf") > 0).cast("int").alias("flag")), "flag")


@query
def rank_terciles(m: Market) -> DataFrame:
    return stats.terciles(m.z, "z").select("month", "ticker", "tercile")


@query
def fit_by_years(m: Market) -> DataFrame:
    return r(stats.block_correlations(m.spread, m.factors, "mkt_rf", [(1995, 1996), (1997, 1998), (1999, 2001)]), "corr")


@query
def sharpe_by_coverage(m: Market) -> DataFrame:
    return r(stats.coverage_split(m.spread, prices.coverage(m.members, m.monthly, CFG.start, CFG.end)[0]), "sharpe")


@query
def score_coverage(m: Market) -> DataFrame:
    return r(stats.score_coverage(m.z, m.panel), "coverage")


@query
def factor_attribution(m: Market) -> DataFrame:
    fit = stats.attribution(m.spread, m.factors, ["mkt_rf", "smb", "hml"])
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n if n == "alpha" else f"beta_{n}").alias("value"), F.col(f"t_{n}").alias("t"), "n") for n in ("alpha", "mkt_rf", "smb", "hml")))
    return r(fit.select(F.explode(rows).alias("x")).select("x.*"), "value", "t", digits=5)


@query
def normal_values(m: Market) -> DataFrame:
    """The normal distribution function at each order's scaled price, and the quantile of its rank."""
    o = m.table("orders").select("o_orderkey", ((F.col("o_totalprice") - 150_000) / 20_000).alias("x"), ((F.col("o_orderkey") % 999 + 1) / 1_000).alias("p"))
    return r(o.select("o_orderkey", normal.cdf(F.col("x")).alias("below"), normal.inverse_cdf(F.col("p")).alias("quantile")), "below", "quantile", digits=9)


# --- logs and audits ---


@query
def near_values(m: Market) -> DataFrame:
    o = m.table("orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))
    return o.select("o_orderkey", near("x", 200.0).alias("near"), outside("x", 50.0, 300.0).alias("outside"))


@query
def spec_rows(m: Market) -> DataFrame:
    return m.spec_log.select("timestamp", "factor", "kind", "sector_neutral", "variant", "spec_key", "note")


@query
def spec_counts(m: Market) -> DataFrame:
    return speclog.counts(m.spec_log)


@query
def spec_latest(m: Market) -> DataFrame:
    return speclog.latest_per_key(m.spec_log).select("spec_key", "timestamp", "first_seen")


@query
def spec_variance(m: Market) -> DataFrame:
    return r(speclog.trial_variance(m.spec_log), "variance", digits=2)


@query
def spec_status(m: Market) -> DataFrame:
    return speclog.classify(m.spec_log, ["f0", "f1", "f2"]).select("timestamp", "factor", "status")


@query
def next_change(m: Market) -> DataFrame:
    starts = m.members.select(F.col("start").alias("when")).distinct()
    return asof_forward_all(m.members.select("ticker", F.col("end").alias("at")).where("at is not null"), starts, "at", "when", ["when"])


@query
def last_print(m: Market) -> DataFrame:
    rows = m.members.where("end is not null").select("ticker", "end")
    return asof_backward(rows, m.daily.select("ticker", "date", "close"), ["ticker"], "end", "date", ["date", "close"])


@query
def build_differences(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    other = m.daily.where(k % 5 != 0).withColumn("close", F.when(k % 7 == 0, F.col("close") + 1e-6).otherwise(F.col("close") + 1e-12))
    return audit.differences(m.daily.select("ticker", "date", "close", "volume"), other.select("ticker", "date", "close", "volume"), ["ticker", "date"])


@query
def quality_checks(m: Market) -> DataFrame:
    counts = intervals.monthly_counts(m.spark, m.members, date(1997, 1, 1), date(1998, 12, 31))
    return audit.quality_checks(counts, prices.coverage(m.members, m.monthly, CFG.start, CFG.end)[0], 1, 10_000, 15.0)


@query
def missing_classes(m: Market) -> DataFrame:
    k = F.substring("ticker", 2, 20).cast("long")
    classes = m.members.where(k % 4 != 3).select("ticker", F.when(k % 4 == 0, "no_xbrl").when(k % 4 == 1, "map_wrong").otherwise("foreign_filer").alias("class"))
    months = m.panel.where(F.month("month") == 12).select("month").distinct()
    return audit.missing_by_class(m.panel, m.wide, "c1", classes, months)


@query
def coverage_figures(m: Market) -> DataFrame:
    return audit.coverage_figures(prices.coverage(m.members, m.monthly, CFG.start, CFG.end)[0])


@query
def gap_by_year(m: Market) -> DataFrame:
    return audit.last_of_year(prices.coverage(m.members, m.monthly, CFG.start, CFG.end)[0], "gap_pct")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, sector-neutral, in ranked portfolios: the monthly long-short spread."""
    return QUERIES["long_short"](spark, sf_dir)



from ledgerline.plans import loaders, reports  # noqa: E402, F401  they register their queries

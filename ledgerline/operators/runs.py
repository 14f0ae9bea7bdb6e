"""Whole runs of several factors and variants: all of them go through one plan, told apart by keys."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import Config
from ledgerline.functions.dates import month_after
from ledgerline.functions.numbers import ratio
from ledgerline.operators import portfolio, signals, stats
from ledgerline.sources.store import settled

RUN = ("factor", "tag")


@dataclass(frozen=True)
class Variant:
    """How a run departs from the base specification."""

    tag: str = ""
    weighting: str = "ew"
    holding: int = 1
    sector_neutral: bool = True
    n_deciles: int | None = None
    terminal: bool = False
    note: str = "base"


BASE = Variant()
SENSITIVITIES = tuple(
    replace(v, note=f"sensitivity {v.tag}")
    for v in (Variant("cw", weighting="cw"), Variant("hold3", holding=3), Variant("hold6", holding=6), Variant("hold12", holding=12), Variant("nosector", sector_neutral=False))
)
TERMINAL = Variant("terminal", terminal=True, note="sensitivity terminal")
REPLICA = Variant("replica", weighting="cw", n_deciles=3, sector_neutral=False, note="replication")


@dataclass(frozen=True)
class Inputs:
    """What runs need; ``raw`` has each factor's values (month, ticker, value), the optional tables may be missing."""

    raw: dict[str, DataFrame]
    monthly: DataFrame
    factors: DataFrame
    sectors: DataFrame | None = None
    caps: DataFrame | None = None
    terminal: DataFrame | None = None
    plain: frozenset[str] = frozenset()  # factors that are never sector-neutral


def scores(inputs: Inputs, cfg: Config, sector_neutral: bool) -> DataFrame:
    """(factor, month, ticker, z) of every factor, rounded to nine digits."""
    out = None
    for name, raw in inputs.raw.items():
        sectors = inputs.sectors if sector_neutral and name not in inputs.plain else None
        z = signals.normalise(raw, sectors, cfg.winsor, cfg.min_sector_names) if sectors is not None else signals.normalise(raw, None, cfg.winsor)
        one = z.select(F.lit(name).alias("factor"), "month", "ticker", F.round("z", 9).alias("z"))
        out = one if out is None else out.unionByName(one)
    return out


def run(inputs: Inputs, cfg: Config, variants: Iterable[Variant]) -> DataFrame:
    """(factor, tag, month, ret_gross, turnover, ret_net): the spread of every factor under every variant.

    A variant whose table is missing (caps, terminal returns) is left out.
    """
    wanted = [v for v in variants if not (v.weighting == "cw" and inputs.caps is None) and not (v.terminal and inputs.terminal is None)]
    z = {neutral: settled(scores(inputs, cfg, neutral), "scores") for neutral in {v.sector_neutral for v in wanted}}
    returns = inputs.monthly.select(F.lit("plain").alias("kind"), "month", "ticker", "ret_fwd")
    if any(v.terminal for v in wanted):
        returns = returns.unionByName(inputs.terminal.select(F.lit("terminal").alias("kind"), "month", "ticker", "ret_fwd"))
    returns = settled(returns, "returns")
    target = None
    for v in wanted:
        kind = "terminal" if v.terminal else "plain"
        one = portfolio.targets(z[v.sector_neutral], returns.where(F.col("kind") == kind), v.n_deciles or cfg.n_deciles, v.holding, cfg.min_names, inputs.caps if v.weighting == "cw" else None, ("factor",))
        one = one.withColumns({"tag": F.lit(v.tag), "kind": F.lit(kind)})
        target = one if target is None else target.unionByName(one)
    deciles = portfolio.simulate(target, returns, cfg.cost, RUN, ("kind",))
    top = F.lit(cfg.n_deciles)
    for v in wanted:
        if v.n_deciles:
            top = F.when(F.col("tag") == v.tag, v.n_deciles).otherwise(top)
    ls = portfolio.long_short(deciles.withColumn("__top", top), F.col("__top"), cfg.cost, RUN)
    return ls.select(*RUN, "month", *(F.round(c, 9).alias(c) for c in ("ret_gross", "turnover", "ret_net")))


def save(ls: DataFrame, uri: str) -> str:
    """The series of every run, one folder for each factor and tag."""
    ls.write.mode("overwrite").partitionBy(*RUN).parquet(uri)
    return uri


def load(spark, uri: str, factor: str | None = None, tag: str | None = None) -> DataFrame:
    """Saved series, of one factor or tag if asked; only their folders are read."""
    rows = spark.read.schema("month date, ret_gross double, turnover double, ret_net double, factor string, tag string").parquet(uri)
    rows = rows.withColumn("tag", F.coalesce("tag", F.lit("")))
    for name, value in (("factor", factor), ("tag", tag)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.select(*RUN, "month", "ret_gross", "turnover", "ret_net")


def validation(ls: DataFrame, factors: DataFrame, wanted: DataFrame, benchmarks: Iterable[str]) -> DataFrame:
    """(series, benchmark, correlation, months, threshold, passed) for rows (series, benchmark, threshold).

    A series or a benchmark that is not there has no correlation and does not pass.
    """
    found = None
    for b in benchmarks:
        one = portfolio.validate(ls.withColumn("series", F.concat_ws("_", "factor", F.nullif("tag", F.lit("")))), factors, b, keys=("series",)).withColumn("benchmark", F.lit(b))
        found = one if found is None else found.unionByName(one)
    corr = F.round("corr", 4)
    rows = wanted.join(found, ["series", "benchmark"], "left")
    return rows.select("series", "benchmark", corr.alias("correlation"), F.coalesce("n", F.lit(0)).alias("months"), "threshold", F.coalesce(F.col("corr") >= F.col("threshold"), F.lit(False)).alias("passed"))


def summary_lines(ls: DataFrame, factors: DataFrame, benchmark: str) -> DataFrame:
    """(factor, tag, line): a run in words."""
    numbers = ls.groupBy(*RUN).agg(F.count("*").alias("n"), stats.sharpe("ret_gross").alias("g"), stats.sharpe("ret_net").alias("s"), F.avg("turnover").alias("t"))
    rows = numbers.join(portfolio.validate(ls, factors, benchmark, keys=RUN).withColumnRenamed("n", "m"), list(RUN), "left")
    two = lambda c: F.coalesce(F.format_string("%.2f", F.round(c, 2)), F.lit("n/a"))
    corr = F.when(F.col("corr").isNull(), "n/a").otherwise(F.format_string("%.3f", F.round("corr", 3)))
    words = [F.col("factor"), F.lit(": "), F.col("n").cast("string"), F.lit(" months, gross Sharpe "), two("g"), F.lit(", net "), two("s"), F.lit(", mean turnover "), two("t"), F.lit(", corr "), corr, F.lit(f" vs {benchmark}")]
    return rows.select(*RUN, F.concat(*words).alias("line"))


def variant_table(ls: DataFrame, tags: list[str]) -> DataFrame:
    """(factor, base, each tag): net Sharpe ratios; null where there is no such run."""
    sharpes = ls.groupBy(*RUN).agg(stats.sharpe("ret_net").alias("s"))
    named = sharpes.withColumn("tag", F.when(F.col("tag") == "", "base").otherwise(F.col("tag")))
    return named.groupBy("factor").pivot("tag", ["base", *tags]).agg(F.first("s"))


def single_fit(rows: DataFrame, y: str, x: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, alpha, alpha_t, beta, beta_t, r2) of y on x with heteroskedasticity-robust errors, in closed form."""
    whole = Window.partitionBy(*keys)
    rows = rows.dropna(subset=[y, x])
    slope, mean_x, mean_y = F.regr_slope(y, x).over(whole), F.avg(x).over(whole), F.avg(y).over(whole)
    fit = rows.withColumns({"__b": slope, "__dx": F.col(x) - mean_x, "__my": mean_y, "__mx": mean_x}).withColumn("__e", F.col(y) - F.col("__my") - F.col("__b") * F.col("__dx"))
    n, sxx = F.count("*"), F.sum(F.col("__dx") * F.col("__dx"))
    e2 = F.col("__e") * F.col("__e")
    se_b = F.sqrt(F.sum(e2 * F.col("__dx") * F.col("__dx"))) / sxx
    # the intercept's influence of a row: 1 / n less the mean of x times its influence on the slope
    sums = fit.groupBy(*keys).agg(
        n.alias("n"), F.first("__b").alias("beta"), F.first("__mx").alias("mx"), F.first("__my").alias("my"), se_b.alias("se"), sxx.alias("sxx"), F.sum(e2).alias("e2"), F.sum(e2 * F.col("__dx")).alias("e2x"), F.sum(e2 * F.col("__dx") * F.col("__dx")).alias("e2xx"), (F.var_samp(y) * (n - 1)).alias("syy"),
    )
    pull = F.col("mx") / F.col("sxx")
    var_a = F.col("e2") / F.col("n") / F.col("n") - 2 * pull * F.col("e2x") / F.col("n") + pull * pull * F.col("e2xx")
    alpha = F.col("my") - F.col("beta") * F.col("mx")
    return sums.select(*keys, "n", (alpha * 12).alias("alpha"), ratio(alpha, F.sqrt(var_a)).alias("alpha_t"), "beta", ratio("beta", "se").alias("beta_t"), (1 - ratio("e2", "syy")).alias("r2"))


def weighting_gaps(ls: DataFrame, factors: DataFrame) -> DataFrame:
    """(factor, n, alpha, alpha_t, beta, beta_t, r2): the equal- less the cap-weighted spread on the size factor."""
    equal, cap = (ls.where(F.col("tag") == t).select("factor", "month", F.col("ret_gross").alias(c)) for t, c in (("", "a"), ("cw", "b")))
    gap = equal.join(cap, ["factor", "month"]).select("factor", month_after("month").alias("month"), (F.col("a") - F.col("b")).alias("y"))
    return single_fit(gap.join(factors.select("month", "smb"), "month"), "y", "smb", ("factor",))


def hedged(ls: DataFrame, factors: DataFrame, cost: float) -> DataFrame:
    """(factor, tag, month, ret_gross, turnover, ret_net): the hedged variant of each base run; hedging is not charged."""
    base = ls.where("tag = ''")
    rows = portfolio.beta_hedge(base, factors, keys=("factor",)).join(base.select("factor", "month", "turnover"), ["factor", "month"])
    return rows.select("factor", F.lit("hedged").alias("tag"), "month", F.col("hedged").alias("ret_gross"), "turnover", (F.col("hedged") - 2 * cost * F.col("turnover")).alias("ret_net"))


def hedge_table(ls: DataFrame, factors: DataFrame, benchmark: str) -> DataFrame:
    """(factor, tag, sharpe, beta, beta_t, corr, months): raw and hedged series side by side."""
    rows = ls.where(F.col("tag").isin("", "hedged"))
    earned = rows.withColumn("month", month_after("month")).join(factors.select("month", "mkt_rf"), "month")
    fit = single_fit(earned, "ret_gross", "mkt_rf", RUN).select(*RUN, "beta", "beta_t")
    corr = portfolio.validate(rows, factors, benchmark, keys=RUN).select(*RUN, "corr", F.col("n").alias("months"))
    return rows.groupBy(*RUN).agg(stats.sharpe("ret_net").alias("sharpe")).join(fit, list(RUN), "left").join(corr, list(RUN), "left")


def results(ls: DataFrame, z: DataFrame, monthly: DataFrame, members: DataFrame, costs_bps: list[float], lags: int = 0) -> DataFrame:
    """A wide row for each factor: returns, risk, turnover, rank correlation, premium, break-even cost, coverage and the Sharpe ratio at each cost."""
    base = ls.where("tag = ''").drop("tag")
    two = stats.performance(base, ["factor"], "ret_net").select("factor", F.col("n").alias("months"), F.col("mean").alias("net_ann"), F.col("sharpe").alias("sharpe_net"), "skew", "kurtosis", "max_drawdown")
    gross = base.groupBy("factor").agg((F.avg("ret_gross") * 12).alias("gross_ann"), (F.stddev_samp("ret_gross") * 12**0.5).alias("vol"), stats.sharpe("ret_gross").alias("sharpe_gross"), F.avg("turnover").alias("turnover"), F.when(F.avg("turnover") > 0, F.avg("ret_gross") / (2 * F.avg("turnover")) * 1e4).alias("breakeven_bps"))
    at_cost = base.groupBy("factor").agg(*(stats.sharpe(F.col("ret_gross") - 2 * c / 1e4 * F.col("turnover")).alias(f"sharpe_at_{int(c)}bp") for c in costs_bps))
    own = monthly.join(members, ["month", "ticker"], "left_semi")
    ic = stats.ic_series(z, own, keys=("factor",))
    ics = ic.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), ratio(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count("ic").cast("double"))).alias("ic_t"))
    premium = stats.newey_west(stats.slopes(z, own, keys=("factor",)), "slope", lags, ["factor"]).select("factor", F.col("mean").alias("fm_premium"), ratio("mean", F.sqrt("variance")).alias("fm_t"))
    share = members.join(z.select("factor").distinct()).join(z.select("factor", "month", "ticker", F.lit(1).alias("__z")), ["factor", "month", "ticker"], "left").groupBy("factor", "month").agg((F.count("__z") / F.count("*")).alias("share"))
    coverage = share.groupBy("factor").agg(F.median("share").alias("coverage"))
    out = two
    for part in (gross, at_cost, ics, premium, coverage):
        out = out.join(part, "factor", "left")
    return out


def figures(rows: DataFrame, key: str, formats: dict[str, tuple[int, float]]) -> DataFrame:
    """(name, text): every number of a wide table as text; ``formats`` has the digits and the factor of each column."""
    def rounded(x: Column, d: int) -> Column:
        """Rounded by scaling, with the sign of what rounds to zero, as printf shows it."""
        return F.signum(x) * (F.round(F.abs(x) * 10.0**d) / 10.0**d)

    cells = [F.struct(F.concat(F.lit(f"{c}_"), F.col(key)).alias("name"), F.when(F.col(c).isNotNull(), F.format_string(f"%.{d}f", rounded(F.col(c) * by, d))).alias("text")) for c, (d, by) in formats.items()]
    return rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("text is not null")

"""Statistics of scores and return series. Sums over rows run in Spark; what is left is a handful of numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_after
from ledgerline.functions.normal import cdf, inverse_cdf
from ledgerline.functions.numbers import average_rank, finite, ratio
from ledgerline.operators.prices import dense
from ledgerline.operators.regression import least_squares

YEAR = 12


def _joined(z: DataFrame, returns: DataFrame, ret: str) -> DataFrame:
    rows = z.join(returns.select("month", "ticker", F.col(ret).alias("__r")), ["month", "ticker"])
    return rows.where(finite("z") & finite("__r"))


def ic_series(z: DataFrame, returns: DataFrame, ret: str = "ret_fwd", least: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, ic, n): the rank correlation of scores and returns, ties at their mean rank."""
    rows = _joined(z, returns, ret).withColumns({"__a": average_rank("z", *keys, "month"), "__b": average_rank("__r", *keys, "month")})
    return rows.groupBy(*keys, "month").agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def mean_t(series: DataFrame, value: str) -> DataFrame:
    """(n, mean, t, ir): null statistics under three rows."""
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    enough = n >= 3
    return series.agg(n.alias("n"), F.when(enough, m).alias("mean"), F.when(enough, ratio(m, s / F.sqrt(n.cast("double")))).alias("t"), F.when(enough, ratio(m, s) * math.sqrt(YEAR)).alias("ir"))


def forward_returns(monthly: DataFrame, horizons: list[int]) -> DataFrame:
    """(month, ticker, horizon, ret): the return of the single month that lies h months ahead."""
    order = Window.partitionBy("ticker").orderBy("month")
    rows = dense(monthly.select("month", "ticker", "px_me"))
    each = [F.struct(F.lit(h).alias("horizon"), (ratio(F.lead("px_me", h).over(order), F.lead("px_me", h - 1).over(order) if h > 1 else F.col("px_me")) - 1).alias("ret")) for h in horizons]
    return rows.withColumn("__e", F.array(*each)).select("month", "ticker", F.explode("__e").alias("e")).select("month", "ticker", "e.*").where("ret is not null")


def ic_decay(z: DataFrame, monthly: DataFrame, horizons: list[int], least: int = 10) -> DataFrame:
    """(horizon, ic, months): the mean rank correlation with the return of each month ahead."""
    rows = z.join(forward_returns(monthly, horizons), ["month", "ticker"]).where(finite("z") & finite("ret"))
    rows = rows.withColumns({"__a": average_rank("z", "month", "horizon"), "__b": average_rank("ret", "month", "horizon")})
    by = rows.groupBy("horizon", "month").agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)
    return by.groupBy("horizon").agg(F.avg("ic").alias("ic"), F.count("ic").alias("months"))


def half_life(points: list[tuple[float, float]]) -> float:
    """Months in which a exp(-h / tau), fitted by least squares, halves; NaN unless it decays within 60."""
    if len(points) < 2:
        return math.nan
    h, y = (np.array(x, float) for x in zip(*sorted(points), strict=True))
    low, high = math.log(0.05), math.log(500.0)

    def loss(log_tau: float) -> tuple[float, float]:
        e = np.exp(-h / math.exp(log_tau))
        a = float(e @ y / (e @ e)) if e @ e > 0 else 0.0
        return float(((y - a * e) ** 2).sum()), a

    grid = np.linspace(low, high, 400)
    best = int(np.argmin([loss(g)[0] for g in grid]))
    a, b = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(80):
        c, d = a + (b - a) * 0.382, a + (b - a) * 0.618
        a, b = (a, d) if loss(c)[0] < loss(d)[0] else (c, b)
    out = math.exp((a + b) / 2) * math.log(2)
    return out if loss((a + b) / 2)[1] > 0 and 0 < out <= 60 else math.nan


def _lagged_products(series: DataFrame, value: str, lags: int, keys: list[str], order: str) -> list[Column]:
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(order)
    return [F.col(value) * F.lag(value, k).over(by) for k in range(lags + 1)]


def newey_west(series: DataFrame, value: str, lags: int, keys: list[str] | None = None, order: str = "month") -> DataFrame:
    """(keys, n, mean, variance): of the mean, with Bartlett weights on autocovariances.

    A series is a row a month; ``keys`` tells many of them apart.
    """
    keys = keys or []
    mean = F.avg(value).over(Window.partitionBy(*keys))
    rows = series.where(F.col(value).isNotNull()).withColumn("__x", F.col(value) - mean)
    products = _lagged_products(rows, "__x", lags, keys, order)
    rows = rows.withColumns({f"__g{k}": p for k, p in enumerate(products)})
    total = F.coalesce(F.sum("__g0"), F.lit(0.0))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__g{k}"), F.lit(0.0))
    n = F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), (total / n / n).alias("variance"))


def slopes(z: DataFrame, returns: DataFrame, ret: str = "ret_fwd", least: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, slope, n) of returns on scores."""
    return _joined(z, returns, ret).groupBy(*keys, "month").agg(F.regr_slope("__r", "z").alias("slope"), F.count("*").alias("n")).where(F.col("n") >= least)


def fama_macbeth(z: DataFrame, returns: DataFrame, lags: int, ret: str = "ret_fwd", least: int = 10) -> DataFrame:
    """(n, premium, se, t): the mean monthly slope and its autocorrelation-robust error."""
    nw = newey_west(slopes(z, returns, ret, least), "slope", lags)
    return nw.select("n", F.col("mean").alias("premium"), F.sqrt("variance").alias("se"), ratio("mean", F.sqrt("variance")).alias("t"))


def rolling_mean(series: DataFrame, value: str, window: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``series`` with ``rolling``, the mean of the last ``window`` rows; null until there are as many."""
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("month").rowsBetween(1 - window, 0)  # a row a month
    return series.withColumn("rolling", F.when(F.count(value).over(order) == window, F.avg(value).over(order)))


def cumulative_log(series: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``series`` with ``log_return``, the running sum of log(1 + value)."""
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("log_return", F.sum(F.log1p(value)).over(order))


def concentration(weighted: DataFrame, top: int = 5) -> DataFrame:
    """(decile, max_w, top_w): the mean over months of the largest weight and of the sum of the ``top`` largest."""
    rank = F.row_number().over(Window.partitionBy("month", "decile").orderBy(F.col("w").desc(), "ticker"))
    month = weighted.withColumn("__r", rank).groupBy("month", "decile").agg(F.max("w").alias("m"), F.sum(F.when(F.col("__r") <= top, F.col("w"))).alias("t"))
    return month.groupBy("decile").agg(F.avg("m").alias("max_w"), F.avg("t").alias("top_w"))


def sharpe(value: Column | str, periods: int = YEAR) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.stddev_samp(v) > 0, F.avg(v) / F.stddev_samp(v) * math.sqrt(periods))


def performance(series: DataFrame, keys: list[str], value: str = "ret_net", order: str = "month") -> DataFrame:
    """(keys, n, mean, sd, sharpe, skew, kurtosis, max_drawdown): annual mean and deviation, population moments."""
    path = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("__w", F.product(1 + F.col(value)).over(path)).withColumn("__d", F.col("__w") / F.greatest(F.max("__w").over(path), F.lit(0.0)) - 1)
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), (F.avg(v) * YEAR).alias("mean"), (F.stddev_samp(v) * math.sqrt(YEAR)).alias("sd"), sharpe(v).alias("sharpe"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurtosis"), F.min("__d").alias("max_drawdown"),
    )


def deflated_sharpe(sr: Column, variance: Column, trials: Column, months: Column, skew: Column, kurtosis: Column) -> tuple[Column, Column]:
    """(threshold, probability): the best Sharpe that so many trials give by chance, and that of beating it; per period.

    One trial, or trials that do not differ, choose nothing: the threshold is 0.
    """
    gamma = 0.5772156649015329
    n = trials.cast("double")
    best = F.sqrt(variance) * ((1 - gamma) * inverse_cdf(1 - 1 / n) + gamma * inverse_cdf(1 - 1 / (n * math.e)))
    top = F.when((n > 1) & (variance > 0), best).otherwise(0.0)
    spread = F.greatest(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, F.lit(1e-12))
    return top, F.when(months >= 1, cdf((sr - top) * F.sqrt(months - 1) / F.sqrt(spread)))


def to_month_earned(ls: DataFrame) -> DataFrame:
    return ls.withColumn("month", month_after("month"))


def attribution(ls: DataFrame, factors: DataFrame, names: list[str], keys: list[str] | None = None, ret: str = "ret_gross", lags: int = 0) -> DataFrame:
    """(keys, n, alpha, t_alpha, beta_<name>, t_<name>, r2): each series on the factors of the month that it earns in; alpha is a year's."""
    keys = keys or []
    rows = to_month_earned(ls).select(*keys, "month", F.col(ret).alias("__ret")).join(factors.select("month", *names), "month")
    fit = least_squares(rows, "__ret", names, keys, "month", lags)
    return fit.withColumn("const", F.col("const") * YEAR).withColumnsRenamed({"const": "alpha", "t_const": "t_alpha"})


def weighting_gap(equal: DataFrame, cap: DataFrame, factors: DataFrame, keys: list[str] | None = None, ret: str = "ret_gross", lags: int = 0) -> DataFrame:
    """Equal- less cap-weighted returns on the size factor."""
    keys = keys or []
    both = equal.select(*keys, "month", F.col(ret).alias("__a")).join(cap.select(*keys, "month", F.col(ret).alias("__b")), [*keys, "month"]).select(*keys, "month", (F.col("__a") - F.col("__b")).alias(ret))
    return attribution(both, factors, ["smb"], keys, ret, lags)


def breakeven_cost(ls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, cost): the one-way cost at which the mean return is gone."""
    turned = F.avg("turnover")
    return ls.groupBy(*(keys or [])).agg(F.when(turned > 0, F.avg("ret_gross") / (2 * turned)).alias("cost"))


def sharpe_by_cost(ls: DataFrame, costs_bps: list[float]) -> DataFrame:
    """(cost_bps, sharpe) over a grid of one-way costs."""
    each = F.explode(F.array(*(F.lit(float(c)) for c in costs_bps)))
    rows = ls.withColumn("cost_bps", each)
    return rows.groupBy("cost_bps").agg(sharpe(F.col("ret_gross") - 2 * F.col("cost_bps") / 1e4 * F.col("turnover")).alias("sharpe"))


def islands(series: DataFrame, flag: str, order: str = "month") -> DataFrame:
    """(first, last): the runs of rows where the flag is 1."""
    by = Window.partitionBy().orderBy(order)  # a row a month
    turn = (F.col(flag) != F.coalesce(F.lag(flag).over(by), F.lit(-1))).cast("int")
    rows = series.withColumn("__turn", turn).withColumn("__run", F.sum("__turn").over(by))
    return rows.where(F.col(flag) == 1).groupBy("__run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("__run")


def terciles(frame: DataFrame, value: str) -> DataFrame:
    """``frame`` with the third of its month that each value is in, by the middle of its rank."""
    share = (average_rank(value, "month") - 0.5) / F.count("*").over(Window.partitionBy("month"))
    return frame.withColumn("tercile", F.least(F.floor(share * 3).cast("int") + 1, F.lit(3)))


def rank_gaps(frame: DataFrame, a: str, b: str) -> DataFrame:
    """``frame`` (month, ticker, two scores) with the share of the month below each, ``gap`` between the shares, and the third of each score."""
    month = Window.partitionBy("month")
    both = frame.where(finite(a) & finite(b))
    for c in (a, b):
        both = both.withColumn(f"{c}_share", (average_rank(c, "month") - 0.5) / F.count("*").over(month))
        both = both.withColumn(f"{c}_third", F.least(F.floor(F.col(f"{c}_share") * 3).cast("int") + 1, F.lit(3)))
    return both.withColumn("gap", F.abs(F.col(f"{a}_share") - F.col(f"{b}_share")))


def diagnosis(frame: DataFrame, a: str, b: str, weights: DataFrame, ls: DataFrame, factors: DataFrame, factor: str, blocks: list[tuple[int, int]], top: int = 5) -> DataFrame:
    """(block, names, mean_gap, agreement, crossings, rank_corr, top_share, corr): where two ways to score a factor part, by blocks of years and in all.

    ``agreement`` is the percentage of name-months in the same third, ``crossings`` those
    in opposite outer thirds; ``top_share`` the mean weight of a month's ``top``
    largest names in the outer groups of ``weights`` (month, ticker, decile, w); ``corr`` that of the spread with the factor of its month of earning.
    """
    ranges = {"all": F.lit(True), **{f"{x}-{y}": F.year("month").between(x, y) for x, y in blocks}}
    within = F.explode(F.array_compact(F.array(*(F.when(held, F.lit(name)) for name, held in ranges.items()))))
    rows = rank_gaps(frame, a, b).withColumn("block", within)
    ta, tb = F.col(f"{a}_third"), F.col(f"{b}_third")
    gaps = rows.groupBy("block").agg(
        F.count("*").alias("names"), F.avg("gap").alias("mean_gap"), (100 * F.avg((ta == tb).cast("int"))).alias("agreement"), F.count_if(F.abs(ta - tb) == 2).alias("crossings"), F.corr(f"{a}_share", f"{b}_share").alias("rank_corr"),
    )
    rank = F.row_number().over(Window.partitionBy("month", "decile").orderBy(F.col("w").desc(), "ticker"))
    ends = weights.withColumn("__last", F.max("decile").over(Window.partitionBy("month"))).where((F.col("decile") == 1) | (F.col("decile") == F.col("__last")))
    tops = ends.withColumn("__r", rank).where(F.col("__r") <= top).groupBy("month", "decile").agg(F.sum("w").alias("t")).withColumn("block", within).groupBy("block").agg(F.avg("t").alias("top_share"))
    return gaps.join(tops, "block", "left").join(block_correlations(ls, factors, factor, blocks).select("block", "corr"), "block", "left")


def widest_gaps(frame: DataFrame, a: str, b: str) -> DataFrame:
    """(ticker, months, mean_gap, crossings): each name's share of the disagreement."""
    rows = rank_gaps(frame, a, b)
    crossed = F.abs(F.col(f"{a}_third") - F.col(f"{b}_third")) == 2
    return rows.groupBy("ticker").agg(F.count("*").alias("months"), F.avg("gap").alias("mean_gap"), F.count_if(crossed).alias("crossings"))


def score_coverage(z: DataFrame, members: DataFrame) -> DataFrame:
    """(coverage): the median over months of members with a score over members."""
    rows = members.join(z.where(finite("z")).select("month", "ticker", F.lit(1).alias("__z")), ["month", "ticker"], "left")
    return rows.groupBy("month").agg((F.count("__z") / F.count("*")).alias("share")).agg(F.median("share").alias("coverage"))


def block_correlations(ls: DataFrame, factors: DataFrame, factor: str, blocks: list[tuple[int, int]], ret: str = "ret_gross", least: int = 3) -> DataFrame:
    """(block, n, corr) over all months and over blocks of years, both ends included, by the month of earning; null under ``least`` months."""
    rows = to_month_earned(ls.select("month", F.col(ret).alias("__r"))).join(factors.select("month", F.col(factor).alias("__f")), "month").dropna(subset=["__r", "__f"])
    ranges = {"all": F.lit(True), **{f"{a}-{b}": F.year("month").between(a, b) for a, b in blocks}}
    within = F.explode(F.array_compact(F.array(*(F.when(held, F.lit(name)) for name, held in ranges.items()))))
    return rows.withColumn("block", within).groupBy("block").agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("__r", "__f")).alias("corr"))


def coverage_split(ls: DataFrame, coverage: DataFrame, max_gap_pct: float = 15.0, value: str = "ret_net") -> DataFrame:
    """(months, n, sharpe) of all months and of the months whose price gap is small."""
    good = coverage.where(F.col("gap_pct") <= max_gap_pct).select("month", F.lit("covered").alias("__c"))
    within = F.explode(F.array_compact(F.array(F.lit("all"), F.col("__c"))))
    return ls.join(good, "month", "left").withColumn("months", within).groupBy("months").agg(F.count(value).alias("n"), sharpe(value).alias("sharpe"))

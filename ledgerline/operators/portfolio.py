"""Ranked portfolios with drifted weights, turnover and costs, in closed form.

A block of ``holding`` signal months keeps its first weights and lets them drift,
so the weight entering month j is the first weight times the product of growth
since, over the decile's sum. That is a window product: no loop over months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_after
from ledgerline.functions.numbers import finite, ratio
from ledgerline.sources.store import settled


def assign_deciles(z: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, ticker, z, decile): floor((rank - 1) n / N) + 1, equal scores in ticker order."""
    rank = F.row_number().over(Window.partitionBy(*keys, "month").orderBy("z", "ticker"))
    size = F.count("*").over(Window.partitionBy(*keys, "month"))
    return z.withColumn("decile", F.floor((rank - 1) * n / size).cast("int") + 1)


def weights(deciles: DataFrame, caps: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, ticker, decile, w): equal, or by market cap among names that have one."""
    group = Window.partitionBy(*keys, "month", "decile")
    if caps is None:
        return deciles.withColumn("w", 1.0 / F.count("*").over(group)).select(*keys, "month", "ticker", "decile", "w")
    rows = deciles.join(caps.where("cap > 0").select("month", "ticker", "cap"), ["month", "ticker"])
    return rows.withColumn("w", F.col("cap") / F.sum("cap").over(group)).select(*keys, "month", "ticker", "decile", "w")


def drift(held: DataFrame) -> DataFrame:
    """(…, w): weights after the month's returns, over their sum in the decile; unchanged if that is not positive."""
    grown = held.withColumn("__g", F.col("w") * (1 + F.coalesce("ret", F.lit(0.0))))
    total = F.sum("__g").over(Window.partitionBy("month", "decile"))
    return grown.withColumn("w", F.when(total > 0, F.col("__g") / total).otherwise(F.col("w"))).drop("__g")


def turnover(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Half the sum of absolute changes of weight by ``keys``, over the names of both sides."""
    both = new.select(*keys, "ticker", F.col("w").alias("__a")).join(old.select(*keys, "ticker", F.col("w").alias("__b")), [*keys, "ticker"], "full")
    return both.groupBy(*keys).agg((F.sum(F.abs(F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0)))) / 2).alias("turnover"))


def targets(z: DataFrame, returns: DataFrame, n_deciles: int, holding: int = 1, min_names: int = 1, caps: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, ticker, decile, w, holding) of months that have ``min_names`` scores and some return."""
    size = F.count("*").over(Window.partitionBy(*keys, "month"))
    scored = z.where(finite("z")).withColumn("__n", size).where(F.col("__n") >= min_names).drop("__n")
    scored = scored.join(returns.where("ret_fwd is not null").select("month").distinct(), "month", "left_semi")
    return weights(assign_deciles(scored, n_deciles, keys), caps, keys).withColumn("holding", F.lit(holding))


def simulate(target: DataFrame, returns: DataFrame, cost: float, keys: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, decile, n, ret_gross, turnover, ret_net) of the portfolios in ``target``.

    ``keys`` tells the runs apart: any number of them go through one plan. A run
    with several kinds of returns has the columns ``kinds`` on both sides.
    """
    keys = (*keys, *(k for k in kinds if k not in keys))
    target = settled(target, "target")
    # one row a month and run: a bounded sort
    order = Window.partitionBy(*keys).orderBy("month") if keys else Window.orderBy("month")
    months = target.select(*keys, "month", "holding").distinct().withColumn("j", (F.row_number().over(order) - 1).cast("long"))
    months = settled(months.withColumn("block", F.floor(F.col("j") / F.col("holding"))), "months")
    place = F.col("j") % F.col("holding")
    firsts = target.drop("holding").join(months.where(place == 0), [*keys, "month"]).select(*keys, "ticker", "decile", "w", "block")
    earned_by = returns.select(*kinds, "month", "ticker", F.col("ret_fwd").alias("ret"))
    held = months.join(firsts, [*keys, "block"]).join(earned_by, [*kinds, "month", "ticker"], "left")
    path = Window.partitionBy(*keys, "decile", "ticker", "block").orderBy("j")
    growth = F.coalesce(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    leg = Window.partitionBy(*keys, "j", "decile")
    held = held.withColumn("__g", F.col("w") * growth).withColumn("__t", F.sum("__g").over(leg)).withColumn("w_in", F.when(F.col("__t") > 0, F.col("__g") / F.col("__t")).otherwise(F.col("w")))
    held = held.withColumn("__h", F.col("w_in") * (1 + F.coalesce("ret", F.lit(0.0)))).withColumn("__u", F.sum("__h").over(leg)).withColumn("w_out", F.when(F.col("__u") > 0, F.col("__h") / F.col("__u")).otherwise(F.col("w_in")))
    held = settled(held.select(*keys, "month", "j", "holding", "block", "decile", "ticker", "ret", "w_in", "w_out"), "held")
    priced = F.when(F.col("ret").isNotNull(), F.col("w_in"))
    earned = held.groupBy(*keys, "month", "decile").agg(F.count("*").alias("n"), F.coalesce(ratio(F.sum(priced * F.col("ret")), F.sum(priced)), F.lit(0.0)).alias("ret_gross"))
    # weights at the end of a block meet those at the start of the next
    ends = held.where(place == F.col("holding") - 1).select(*keys, (F.col("block") + 1).alias("block"), "decile", "ticker", F.col("w_out").alias("w"))
    change = turnover(firsts, ends, [*keys, "block", "decile"])
    first_month = months.where(place == 0).select(*keys, "block", "month")
    # a decile that has lost all its names still pays for leaving them
    rows = earned.join(change.join(first_month, [*keys, "block"]).select(*keys, "month", "decile", "turnover"), [*keys, "month", "decile"], "full")
    out = rows.select(*keys, "month", "decile", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ret_gross", F.lit(0.0)).alias("ret_gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    return out.withColumn("ret_net", F.col("ret_gross") - 2 * cost * F.col("turnover"))


def backtest(z: DataFrame, returns: DataFrame, n_deciles: int, cost: float, holding: int = 1, min_names: int = 1, caps: DataFrame | None = None) -> DataFrame:
    """(month, decile, n, ret_gross, turnover, ret_net) from scores (month, ticker, z) and (month, ticker, ret_fwd).

    Months need ``min_names`` scores and some return. ``cost`` is one way.
    """
    return simulate(targets(z, returns, n_deciles, holding, min_names, caps), returns, cost)


def long_short(deciles: DataFrame, n_deciles: int | Column, cost: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, ret_gross, turnover, ret_net): the top decile less the bottom one; both legs trade."""
    sign = F.when(F.col("decile") == n_deciles, 1).when(F.col("decile") == 1, -1)
    rows = deciles.where(sign.isNotNull()).groupBy(*keys, "month").agg(F.sum(sign * F.col("ret_gross")).alias("ret_gross"), F.sum("turnover").alias("turnover"))
    return rows.withColumn("ret_net", F.col("ret_gross") - 2 * cost * F.col("turnover"))


def beta_hedge(ls: DataFrame, market: DataFrame, window: int = 36, least: int = 24, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month, ret_gross, beta, hedged): the series less its slope on the market over the months before.

    ``market`` (month, mkt_rf) is stamped by the month it is earned in, ``ls`` by
    the month before it.
    """
    rows = ls.withColumn("earned", month_after("month")).join(market.select(F.col("month").alias("earned"), "mkt_rf"), "earned")
    order = Window.partitionBy(*keys).orderBy("month") if keys else Window.orderBy("month")
    prior = order.rowsBetween(-window, -1)  # one row a month
    slope = F.when(F.count("mkt_rf").over(prior) >= least, F.regr_slope("ret_gross", "mkt_rf").over(prior))
    return rows.withColumn("beta", slope).where("beta is not null").select(*keys, "month", "ret_gross", "beta", (F.col("ret_gross") - F.col("beta") * F.col("mkt_rf")).alias("hedged"))


def validate(ls: DataFrame, market: DataFrame, factor: str, ret: str = "ret_gross", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, corr) of the series with a benchmark, stamped by the month it is earned in; null under three months."""
    rows = ls.select(*keys, month_after("month").alias("month"), F.col(ret).alias("__r")).join(market.select("month", F.col(factor).alias("__f")), "month")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") > 2, F.corr("__r", "__f")).alias("corr"))


def odd_months(series: DataFrame, keys: list[str], ret: str = "ret_gross", sigmas: float = 4.0, least: int = 4) -> DataFrame:
    """Months whose return is beyond ``sigmas`` deviations of all the others of its series, with ``z``."""
    whole = Window.partitionBy(*keys)
    n, s, q = F.count(ret).over(whole), F.sum(ret).over(whole), F.sum(F.col(ret) * F.col(ret)).over(whole)
    rows = series.withColumns({"__n": n - 1, "__s": s - F.col(ret), "__q": q - F.col(ret) * F.col(ret)}).where(F.col("__n") >= least - 1)
    mean = F.col("__s") / F.col("__n")
    sd = F.sqrt(F.greatest((F.col("__q") - F.col("__s") * mean) / (F.col("__n") - 1), F.lit(0.0)))
    rows = rows.withColumn("z", ratio(F.col(ret) - mean, sd))
    return rows.where(F.abs("z") > sigmas).drop("__n", "__s", "__q")

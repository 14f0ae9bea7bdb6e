"""Raw signals and their place in the cross-section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import clip, finite, ratio
from ledgerline.operators.prices import dense


def momentum(monthly: DataFrame, back: int = 12, skip: int = 1) -> DataFrame:
    """(month, ticker, value): the return from ``back`` to ``skip`` months ago, on a grid without gaps."""
    order = Window.partitionBy("ticker").orderBy("month")
    rows = dense(monthly.select("month", "ticker", "px_me")).withColumn("value", ratio(F.lag("px_me", skip).over(order), F.lag("px_me", back).over(order)) - 1)
    return rows.where("value is not null and px_me is not null").select("month", "ticker", "value")


def volatility(returns: DataFrame, month_ends: DataFrame, window: int = 252, share: float = 0.8) -> DataFrame:
    """(month, ticker, value): minus the annualised deviation of the last ``window`` returns at each month-end day.

    Rows without a return are no part of a window; it needs ``share`` of its rows.
    """
    frame = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = returns.where("ret is not null").withColumns({"__sd": F.stddev_samp("ret").over(frame), "__n": F.count("ret").over(frame)})
    rows = rows.join(F.broadcast(month_ends.select("month", F.col("t").alias("date"))), "date")
    return rows.where(F.col("__n") >= int(window * share)).select("month", "ticker", (-(252**0.5) * F.col("__sd")).alias("value")).where("value is not null")


def beta(returns: DataFrame, market: DataFrame, month_ends: DataFrame, window: int = 252, share: float = 0.8) -> DataFrame:
    """(month, ticker, value): minus the slope on the market's returns (date, mkt)."""
    frame = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = returns.where("ret is not null").join(market, "date").withColumns({"__c": F.covar_samp("ret", "mkt").over(frame), "__v": F.var_samp("mkt").over(frame), "__n": F.count("*").over(frame)})
    rows = rows.join(F.broadcast(month_ends.select("month", F.col("t").alias("date"))), "date")
    return rows.where(F.col("__n") >= int(window * share)).select("month", "ticker", (-ratio("__c", "__v")).alias("value")).where("value is not null")


def winsorise(raw: DataFrame, low: float, high: float) -> DataFrame:
    """Values clipped to two quantiles of their month."""
    month = Window.partitionBy("month")
    bounds = [F.percentile("value", F.lit(q)).over(month) for q in (low, high)]
    return raw.withColumn("value", clip("value", *bounds))


def normalise(raw: DataFrame, sectors: DataFrame | None = None, winsor: tuple[float, float] | None = (0.01, 0.99), min_sector: int = 5) -> DataFrame:
    """(month, ticker, z): distance from the sector's mean in its deviations; from the month's in small or no sectors."""
    rows = raw.where(finite("value"))
    if winsor:
        rows = winsorise(rows, *winsor)
    month = Window.partitionBy("month")
    if sectors is None:
        mean, sd = F.avg("value").over(month), F.stddev_samp("value").over(month)
    else:
        rows = rows.join(sectors.select("ticker", "sector"), "ticker", "left")
        group = Window.partitionBy("month", "sector")
        whole = F.col("sector").isNull() | (F.count("*").over(group) < min_sector)
        mean = F.when(whole, F.avg("value").over(month)).otherwise(F.avg("value").over(group))
        sd = F.when(whole, F.stddev_samp("value").over(month)).otherwise(F.stddev_samp("value").over(group))
    out = rows.withColumns({"__m": mean, "__s": sd}).where("__s > 0")
    return out.select("month", "ticker", ((F.col("value") - F.col("__m")) / F.col("__s")).alias("z"))


def composite(parts: list[DataFrame]) -> DataFrame:
    """(month, ticker, z): the mean of all parts, for names that have each; normalised again."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    mean = both.groupBy("month", "ticker").agg(F.avg("z").alias("value"), F.count("z").alias("__n")).where(F.col("__n") == len(parts))
    return normalise(mean.select("month", "ticker", "value"), None, None)


#: Signals by name; each takes the inputs by keyword and gives (month, ticker, value).
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "momentum": lambda monthly, **_: momentum(monthly),
    "reversal": lambda monthly, **_: momentum(monthly, 1, 0),
    "volatility": lambda returns, month_ends, **_: volatility(returns, month_ends),
    "beta": lambda returns, market, month_ends, **_: beta(returns, market, month_ends),
}


def raw_signal(name: str, **inputs: DataFrame) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"no signal {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**inputs)

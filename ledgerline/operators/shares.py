"""Share counts in one basis, and the count to use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import outside, ratio

# How far a count may stray.
JUMP, AGREE, UNITS, MIN_SHARES, JUMP_WINDOW = 5.0, 1.25, 50.0, 1e5, 61
CAP_PRIOR = (2e8, 2e13)
SOURCES = (("cover", "shares_cover"), ("balance_sheet", "shares"), ("weighted_average", "shares_wavg"))


def split_factor(keys: DataFrame, splits: DataFrame, basis: str = "shares_filed") -> DataFrame:
    """``keys`` with the product of the ticker's split ratios dated after ``basis``, 1 if there are none."""
    later = keys.select("ticker", basis).distinct().join(splits.select("ticker", F.col("date").alias("__d"), "ratio"), "ticker").where(F.col("__d") > F.col(basis))
    product = later.groupBy("ticker", basis).agg(F.product("ratio").alias("split_factor"))
    return keys.join(product.hint("merge"), ["ticker", basis], "left").withColumn("split_factor", F.coalesce("split_factor", F.lit(1.0)))


def resolve(panel: DataFrame, splits: DataFrame, overrides: DataFrame | None = None, prices: DataFrame | None = None, cap_prior: tuple[float, float] = CAP_PRIOR, min_shares: float = MIN_SHARES) -> DataFrame:
    """(month, ticker, n_shares, shares_source, shares_filed, split_factor, n_basis, implausible).

    Every source goes into the price basis. A ticker's reference is the centred
    rolling median, over the panel's own months, of the monthly median of counts
    that pass the size prior. A count is in band if it is within JUMP of the
    reference, or if another source agrees within AGREE and it is within UNITS,
    and if it is no shell's. The first source in band is used, else the first.
    """
    entries = F.array(*(
        F.struct(F.lit(name).alias("shares_source"), F.lit(i).alias("rank"), F.col(c).alias("n_shares"), F.col(f"{c}_filed").alias("shares_filed")) for i, (name, c) in enumerate(SOURCES)
    ))
    long = panel.select("month", "ticker", F.explode(entries).alias("e")).select("month", "ticker", "e.*").where("n_shares > 0")
    if overrides is not None:
        pins = overrides.select("ticker", F.col("source").alias("__pin"))
        long = long.join(pins, "ticker", "left").where(F.col("__pin").isNull() | (F.col("__pin") == F.col("shares_source"))).drop("__pin")
    long = split_factor(long, splits).withColumn("n_basis", F.col("n_shares") * F.col("split_factor"))
    if prices is not None:
        long = long.join(prices.select("month", "ticker", "px_me_raw"), ["month", "ticker"], "left")
        long = long.withColumn("prior_ok", F.coalesce((F.col("n_basis") * F.col("px_me_raw")).between(*cap_prior), F.lit(True))).drop("px_me_raw")
    else:
        long = long.withColumn("prior_ok", F.lit(True))
    # one shuffle by month and ticker serves the median and the agreement; the reference needs another by ticker
    cell = Window.partitionBy("month", "ticker")
    counts = F.collect_list(F.struct("shares_source", "n_basis")).over(cell)
    agrees = F.exists(counts, lambda o: (o["shares_source"] != F.col("shares_source")) & o["n_basis"].between(F.col("n_basis") / AGREE, F.col("n_basis") * AGREE))
    long = long.withColumn("agrees", agrees)
    mid = long.where("prior_ok").groupBy("month", "ticker").agg(F.median("n_basis").alias("n_mid"))
    half = JUMP_WINDOW // 2
    around = Window.partitionBy("ticker").orderBy("month").rowsBetween(-half, half)
    grid = panel.select("month", "ticker").distinct().join(mid, ["month", "ticker"], "left").withColumn("reference", F.percentile("n_mid", F.lit(0.5)).over(around))
    rows = long.join(grid.select("month", "ticker", "reference"), ["month", "ticker"])
    within = lambda k: F.col("n_basis").between(F.col("reference") / k, F.col("reference") * k)
    in_band = F.coalesce((within(JUMP) | (F.col("agrees") & within(UNITS))) & (F.col("n_basis") >= min_shares), F.lit(False))
    rows = rows.withColumn("in_band", in_band)
    best = F.row_number().over(cell.orderBy(F.col("in_band").desc(), "rank"))
    chosen = rows.withColumn("__r", best).where("__r = 1")
    return chosen.select("month", "ticker", "n_shares", "shares_source", "shares_filed", "split_factor", "n_basis", (~F.col("in_band")).alias("implausible"))


def crosscheck(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Counts and caps of two sources (ticker, shares, cap) side by side, flagged outside [0.5, 2]."""
    rows = ours.join(theirs.select("ticker", F.col("shares").alias("their_shares"), F.col("cap").alias("their_cap")), "ticker", "left")
    rows = rows.withColumns({"ratio": ratio("shares", "their_shares"), "cap_ratio": ratio("cap", "their_cap")})
    return rows.withColumn("flag", outside("ratio"))

"""Least squares of many series at once: normal equations solved in columns, with robust errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pivot below this part of its diagonal entry means that the regressors are dependent.
LEAST_PIVOT = 1e-12


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _solved(sums: DataFrame, k: int, kept: list[str]) -> DataFrame:
    """``kept``, the coefficients c_i and the inverse b_i_j of the cross products g_i_j, by Cholesky factors; null if they have none."""
    c = F.col
    for j in range(k):
        pivot = c(f"g_{j}_{j}") - _sum([F.lit(0.0), *(c(f"l_{j}_{m}") * c(f"l_{j}_{m}") for m in range(j))])
        sums = sums.withColumn(f"l_{j}_{j}", F.when(pivot > LEAST_PIVOT * c(f"g_{j}_{j}"), F.sqrt(pivot)))
        below = {f"l_{i}_{j}": (c(f"g_{j}_{i}") - _sum([F.lit(0.0), *(c(f"l_{i}_{m}") * c(f"l_{j}_{m}") for m in range(j))])) / c(f"l_{j}_{j}") for i in range(j + 1, k)}
        sums = sums.withColumns(below) if below else sums
    for i in range(k):  # the inverse of the factor, row by row
        row = {f"m_{i}_{j}": (F.lit(1.0) if i == j else -_sum([c(f"l_{i}_{m}") * c(f"m_{m}_{j}") for m in range(j, i)])) / c(f"l_{i}_{i}") for j in range(i + 1)}
        sums = sums.withColumns(row)
    inverse = {f"b_{i}_{j}": _sum([c(f"m_{m}_{i}") * c(f"m_{m}_{j}") for m in range(max(i, j), k)]) for i in range(k) for j in range(k)}
    sums = sums.withColumns(inverse)
    coef = {f"c_{i}": _sum([c(f"b_{i}_{j}") * c(f"h_{j}") for j in range(k)]) for i in range(k)}
    return sums.select(*kept, *inverse, *(v.alias(n) for n, v in coef.items()))


def least_squares(rows: DataFrame, y: str, names: list[str], keys: list[str], order: str = "month", lags: int = 0) -> DataFrame:
    """(keys, n, const, t_const, and for each regressor beta_<name> and t_<name>, r2): a row for each series.

    A series is the rows of one key in order; rows with a null in y or a regressor are
    left out. Errors are robust, with Bartlett weights on ``lags`` autocovariances of
    the scores. Cross products are summed by key, the system of each key is solved in its
    row, and a second pass sums the scores. A series of no more rows than coefficients,
    or with dependent regressors, has null results.
    """
    x = ["__one", *names]
    k = len(x)
    c = F.col
    rows = rows.dropna(subset=[y, *names]).select(F.lit(0).alias("__all"), *keys, order, c(y).cast("double").alias("__y"), F.lit(1.0).alias("__one"), *(c(n).cast("double").alias(n) for n in names))
    by = ["__all", *keys]
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.var_samp("__y").alias("vy"),
        *(F.sum(c(x[i]) * c(x[j])).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(c(x[i]) * c("__y")).alias(f"h_{i}") for i in range(k)),
    )
    fit = _solved(sums, k, [*by, "n", "vy"])
    on = [c(f"r.{b}").eqNullSafe(c(f"f.{b}")) for b in keys] or [c("r.__all") == c("f.__all")]
    path = Window.partitionBy(*by).orderBy(order)
    resid = c("__y") - _sum([c(f"f.c_{i}") * c(x[i]) for i in range(k)])
    scored = rows.alias("r").join(fit.alias("f"), on).select(*(c(f"r.{b}") for b in by), order, resid.alias("__e"), *(c(n) for n in x))
    scored = scored.withColumns({f"s_{i}": c("__e") * c(x[i]) for i in range(k)})
    lagged = scored.withColumns({f"s{m}_{i}": F.lag(f"s_{i}", m).over(path) for m in range(1, lags + 1) for i in range(k)}) if lags else scored

    def meat(i: int, j: int) -> Column:
        terms = [c(f"s_{i}") * c(f"s_{j}")]
        for m in range(1, lags + 1):
            terms.append((1 - m / (lags + 1)) * F.coalesce(c(f"s_{i}") * c(f"s{m}_{j}") + c(f"s{m}_{i}") * c(f"s_{j}"), F.lit(0.0)))
        return F.sum(_sum(terms)).alias(f"v_{i}_{j}")

    meats = lagged.groupBy(*by).agg(F.var_samp("__e").alias("ve"), *(meat(i, j) for i in range(k) for j in range(k)))
    on = [c(f"f.{b}").eqNullSafe(c(f"v.{b}")) for b in keys] or [c("f.__all") == c("v.__all")]
    both = fit.alias("f").join(meats.alias("v"), on)
    enough = c("n") > k
    t = [F.try_divide(c(f"c_{i}"), F.sqrt(_sum([c(f"b_{i}_{p}") * c(f"v_{p}_{q}") * c(f"b_{q}_{i}") for p in range(k) for q in range(k)]))) for i in range(k)]
    out = [F.when(enough, c("c_0")).alias("const"), F.when(enough, t[0]).alias("t_const")]
    for i, name in enumerate(names, 1):
        out += [F.when(enough, c(f"c_{i}")).alias(f"beta_{name}"), F.when(enough, t[i]).alias(f"t_{name}")]
    return both.select(*(c(f"f.{b}") for b in keys), "n", *out, F.when(enough, 1 - F.try_divide(c("ve"), c("vy"))).alias("r2"))

"""The normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.arrays import let

#: Below this the distribution function is summed from its middle, beyond it the tail is a continued fraction.
TAIL = 3.0
_TERMS, _DEPTH, _STEPS = 60, 60, 12


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _middle(x: Column) -> Column:
    """From 0 to x: the density times x + x^3 / 3 + x^5 / (3 5) + ...; each term is x^2 / (2 k + 1) of the last."""
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        return let(s["term"] * x * x / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))

    return density(x) * F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, add, lambda s: s["sum"])


def _tail(x: Column) -> Column:
    """Above x, for x well over 0: the density over x + 1 / (x + 2 / (x + 3 / ...))."""
    return density(x) / F.aggregate(F.sequence(F.lit(_DEPTH), F.lit(1), F.lit(-1)), x, lambda f, k: x + k / f)


def upper(x: Column) -> Column:
    """The probability above x, accurate in either tail."""
    return let(x.cast("double"), lambda v: F.when(v > TAIL, _tail(v)).when(v < -TAIL, 1 - _tail(-v)).otherwise(0.5 - _middle(v)))


def cdf(x: Column) -> Column:
    """The probability below x."""
    return upper(-x.cast("double"))


def inverse_cdf(p: Column) -> Column:
    """The x that p lies below: Newton's steps on the logarithm of the tail; infinite at 0 and 1, null outside."""

    def solve(q: Column) -> Column:
        start = F.sqrt(-2 * F.ln(q))
        step = lambda x, _: let(upper(x), lambda u: x + (F.ln(u) - F.ln(q)) * u / density(x))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step)

    p = p.cast("double")
    inside = let(F.least(p, 1 - p), solve)
    return F.when(p == 0, F.lit(-math.inf)).when(p == 1, F.lit(math.inf)).when((p > 0) & (p < 0.5), -inside).when((p >= 0.5) & (p < 1), inside)

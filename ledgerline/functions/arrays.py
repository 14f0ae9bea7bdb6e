"""Expressions over arrays that need a value twice or walk two arrays together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_counts(values: Column) -> Column:
    """(key, n) of the distinct values of an array, in order of the key; one sort, then one pass over where the runs begin."""

    def runs(held: Column) -> Column:
        begin = F.filter(F.transform(held, lambda x, i: F.when((i == 0) | (x != F.get(held, i - 1)), i)), lambda i: i.isNotNull())
        return let(begin, lambda at: F.transform(at, lambda s, j: F.struct(F.get(held, s).alias("key"), (F.coalesce(F.get(at, j + 1), F.size(held)) - s).alias("n"))))

    return let(F.sort_array(values), runs)


def merged(a: Column, b: Column) -> Column:
    """(dot, common) of two arrays of (key, n) with distinct keys: the sum of products over shared keys, and how many these are.

    Both are sorted as one array, where a shared key stands twice in a row.
    """
    none = F.struct(F.lit(0).cast("long").alias("dot"), F.lit(0).cast("long").alias("common"))

    def sums(both: Column) -> Column:
        same = F.filter(F.transform(both, lambda x, i: F.when(x["key"] == F.get(both, i - 1)["key"], x["n"].cast("long") * F.get(both, i - 1)["n"])), lambda p: p.isNotNull())
        return F.aggregate(same, none, lambda s, p: F.struct((s["dot"] + p).alias("dot"), (s["common"] + 1).alias("common")))

    return let(F.sort_array(F.concat(a, b)), sums)

"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is one fixed node of the component.

    Each round maps a node to the first among itself and its neighbours and carries
    the edges over; the mapping of each round is kept and all are composed at the
    end. Which is first goes by a hash that is another one in every round, so about
    a third of the nodes of a path are left after it, however they are numbered, and
    rounds grow with the logarithm of the longest path. The first neighbour is a
    partial aggregation, so a hub costs one row per task.
    """
    now = written(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("hash"), F.col(c).alias("node"))
        first = F.least(F.min(place("b")), F.min(place("a"))).getField("node")
        up = written(both.groupBy("a").agg(first.alias("parent")).withColumnRenamed("a", "node"), "parents")
        maps.append(up)
        a = up.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = up.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        now = written(now.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    if not maps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("parent").alias("root"))
    for up in reversed(maps[:-1]):
        above = out.select(F.col("node").alias("parent"), "root")
        out = up.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return out

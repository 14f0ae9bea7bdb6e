"""Differences between two builds, and checks of data quality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.names import normalise_name
from ledgerline.operators.sectors import audit_class
from ledgerline.sources.store import settled

# Annual and quarterly forms of domestic and of foreign filers.
DOMESTIC = ("10-K", "10-Q", "10-KT", "10-QT", "10-K/A", "10-Q/A")
FOREIGN = ("20-F", "40-F", "20-F/A", "40-F/A")
CLASSES = ("map_wrong", "foreign_filer", "no_xbrl", "other")

STAMPS = ("as_of", "tag_map_hash", "fetched_at")


def differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-10, ignore: tuple[str, ...] = STAMPS) -> DataFrame:
    """(what, n): how two tables differ; no rows if they are the same.

    Numbers may be ``tolerance`` apart, everything else must be equal, nulls equal
    nulls, order does not matter. A key may repeat as long as both sides have it as often.
    """
    spark = a.sparkSession
    own, other = [c for c in a.columns if c not in ignore], [c for c in b.columns if c not in ignore]
    if sorted(own) != sorted(other):
        gone, new = sorted(set(own) - set(other)), sorted(set(other) - set(own))
        return spark.createDataFrame([(f"columns only in a: {gone}; only in b: {new}", len(gone) + len(new))], "what string, n long")
    rest = [c for c in own if c not in keys]
    kinds = dict(a.dtypes)

    def numbered(df: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(*(rest or keys))
        return df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in rest), F.row_number().over(order).alias("__i"), F.lit(True).alias(f"__{side}"))

    left, right = numbered(a, "a").alias("l"), numbered(b, "b").alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__i"]]
    both = left.join(right, on, "full")
    checks = {"rows only in a": F.col("__b").isNull(), "rows only in b": F.col("__a").isNull()}
    for c in rest:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        equal = x.eqNullSafe(y)
        if kinds[c] in ("double", "float"):
            equal = equal | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        checks[f"values of {c}"] = F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~equal
    counted = both.agg(*(F.count_if(v).alias(f"c{i}") for i, v in enumerate(checks.values())))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.col(f"c{i}").alias("n")) for i, k in enumerate(checks))))
    return counted.select(pairs.alias("p")).select("p.*").where("n > 0")


def fingerprints(df: DataFrame, keys: list[str], buckets: int, tolerance: float = 1e-10, ignore: tuple[str, ...] = STAMPS) -> DataFrame:
    """(bucket, n, sum_a, sum_b) of a table: rows dealt to buckets by the hash of their keys, and two sums of hashes of whole rows, whatever their order.

    Numbers are hashed at the grid of ``tolerance``: what is further apart has another hash, what is nearer may have.
    """
    digits = max(0, int(-math.log10(tolerance) + 1e-9))
    kinds = dict(df.dtypes)
    cols = sorted(c for c in df.columns if c not in ignore)
    plain = [F.round(F.col(c).cast("double"), digits) + 0.0 if kinds[c] in ("double", "float") else F.col(c) for c in cols]
    held = [F.struct(x.isNull(), x) for x in plain]  # a hash passes over nulls, so they are told apart
    bucket = F.pmod(F.xxhash64(*(F.struct(F.col(k).isNull(), F.col(k)) for k in sorted(keys))), F.lit(buckets)).alias("bucket")
    sums = [F.sum(F.xxhash64(F.lit(seed), *held).cast("decimal(20,0)")) for seed in (1, 2)]
    return df.groupBy(bucket).agg(F.count("*").alias("n"), sums[0].alias("sum_a"), sums[1].alias("sum_b"))


def drifted(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-10, ignore: tuple[str, ...] = STAMPS, buckets: int = 4096) -> DataFrame:
    """``differences``, comparing in full only the buckets of keys whose fingerprints differ.

    Two builds that agree cost a scan and a small aggregation each; rows are
    sorted and joined only where something has changed.
    """
    own, other = (sorted(c for c in df.columns if c not in ignore) for df in (a, b))
    if own != other:
        return differences(a, b, keys, tolerance, ignore)
    left, right = (fingerprints(df, keys, buckets, tolerance, ignore) for df in (a, b))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("n", "sum_a", "sum_b")]
    both = left.alias("l").join(right.alias("r"), "bucket", "full").where(~(same[0] & same[1] & same[2])).select("bucket")
    odd = settled(both, "odd-buckets")  # as long as the number of buckets

    def of(df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*(F.struct(F.col(k).isNull(), F.col(k)) for k in sorted(keys))), F.lit(buckets))
        return df.withColumn("__bucket", bucket).join(F.broadcast(odd.withColumnRenamed("bucket", "__bucket")), "__bucket", "left_semi").drop("__bucket")

    return differences(of(a), of(b), keys, tolerance, ignore)


def quality_checks(counts: DataFrame, coverage: DataFrame, low: int, high: int, max_gap_pct: float) -> DataFrame:
    """(check, passed, value): members within bounds in every month; a small price gap in the last twelve months."""
    size = counts.agg(F.lit("universe_count_in_range").alias("check"), F.bool_and(F.col("n").between(low, high)).alias("passed"), F.min("n").cast("double").alias("value"))
    last = coverage.orderBy(F.col("month").desc()).limit(12)
    gap = last.agg(F.lit("recent_price_gap_is_small").alias("check"), (F.max("gap_pct") <= max_gap_pct).alias("passed"), F.max("gap_pct").alias("value"))
    return size.unionByName(gap)


def missing_by_class(members: DataFrame, panel: DataFrame, concept: str, classes: DataFrame, months: DataFrame) -> DataFrame:
    """A row for each audit month: members without the concept, by why; classes is (ticker, class)."""
    names = ("no_xbrl", "map_wrong", "foreign_filer", "other")
    lacking = members.join(months, "month", "left_semi").join(panel.where(F.col(concept).isNotNull()).select("month", "ticker"), ["month", "ticker"], "left_anti").join(classes, "ticker", "left").withColumn("class", F.coalesce("class", F.lit("other")))
    wide = lacking.groupBy("month").pivot("class", list(names)).count()
    return months.join(wide, "month", "left").select("month", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def coverage_figures(coverage: DataFrame, max_gap_pct: float = 15.0) -> DataFrame:
    """(gap_pct, covered_pct, good_months, first_good) over all months."""
    gap = F.round(100.0 * (F.sum("members") - F.sum("priced")) / F.sum("members"), 2)
    good = F.col("gap_pct") <= max_gap_pct
    return coverage.agg(gap.alias("gap_pct"), F.round(100 - gap, 2).alias("covered_pct"), F.count_if(good).alias("good_months"), F.min(F.when(good, F.col("month"))).alias("first_good"))


def last_of_year(rows: DataFrame, value: str) -> DataFrame:
    """(year, month, value) of the last month of each year."""
    return rows.groupBy(F.year("month").alias("year")).agg(F.max("month").alias("month"), F.max_by(value, "month").alias(value))


def filers_in_window(filings: DataFrame, months: DataFrame, window: int = 18) -> DataFrame:
    """(month, cik, name, n_domestic, n_foreign): who filed in the months up to each audit month, under the latest name."""
    # the audit months are a short list, and a filing is in the window of a few of them
    near = filings.join(F.broadcast(months), (F.col("filed") > F.add_months("month", -window)) & (F.col("filed") <= F.col("month")))
    return near.groupBy("month", "cik").agg(F.max_by("name", F.struct("filed", "name")).alias("name"), F.count_if(F.col("form").isin(*DOMESTIC)).alias("n_domestic"), F.count_if(F.col("form").isin(*FOREIGN)).alias("n_foreign"))


def audit_members(members: DataFrame, panel: DataFrame, concept: str, assigned: DataFrame, filings: DataFrame, months: DataFrame, window: int = 18) -> DataFrame:
    """(month, ticker, security, assigned_cik, assigned_domestic, best_cik, best_run, class): members without a value at the audit months, and why.

    ``members`` is (month, ticker, security), ``assigned`` is (ticker, cik). The best
    filer shares the longest run of first words with the member's name; of ties the
    one with more filings, then the least cik. They meet on the first word.
    """
    filers = filers_in_window(filings, months, window).withColumn("wb", F.split(normalise_name("name"), " "))
    lacking = members.join(months, "month", "left_semi").join(panel.where(F.col(concept).isNotNull()).select("month", "ticker"), ["month", "ticker"], "left_anti")
    rows = lacking.join(assigned.select("ticker", F.col("cik").alias("assigned_cik")), "ticker", "left").join(filers.select("month", F.col("cik").alias("assigned_cik"), F.col("n_domestic").alias("assigned_domestic")), ["month", "assigned_cik"], "left")
    words = F.split(normalise_name("security"), " ")
    a = lacking.select("month", "ticker", words.alias("wa")).withColumn("w", F.col("wa")[0]).where("w <> ''")
    pairs = a.join(filers.withColumn("w", F.col("wb")[0]), ["month", "w"])
    same = F.transform(F.arrays_zip("wa", "wb"), lambda p: F.coalesce(p["wa"] == p["wb"], F.lit(False)))
    run = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))
    rank = F.struct(run.alias("run"), (F.col("n_domestic") + F.col("n_foreign")).alias("n"), (-F.col("cik")).alias("c"), "n_domestic", "n_foreign")
    best = pairs.groupBy("month", "ticker").agg(F.max(rank).alias("b"))
    rows = rows.join(best, ["month", "ticker"], "left")
    files, b = F.coalesce("assigned_domestic", F.lit(0)), F.col("b")
    kind = F.when(files > 0, "other").otherwise(audit_class(b.isNotNull(), (b["n_foreign"] > 0) & (b["n_domestic"] == 0), (b["n_domestic"] > 0) & (b["run"] >= 1)))
    return rows.select("month", "ticker", "security", "assigned_cik", files.alias("assigned_domestic"), (-b["c"]).alias("best_cik"), b["run"].alias("best_run"), kind.alias("class"))


def audit_summary(rows: DataFrame, months: DataFrame) -> DataFrame:
    """(month, class, n) for every audit month and class."""
    grid = months.withColumn("class", F.explode(F.array(*map(F.lit, CLASSES))))
    return grid.join(rows.groupBy("month", "class").agg(F.count("*").alias("n")), ["month", "class"], "left").select("month", "class", F.coalesce("n", F.lit(0)).alias("n"))


def sole(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("__r", last).where("__r = 1").drop("__r")

"""Which filer a ticker is, and its sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.names import normalise_name, sic_to_sector


def _only(names: DataFrame, key: Column) -> DataFrame:
    """(key, cik) of keys that one cik alone has."""
    return names.select(key.alias("key"), "cik").where("key <> ''").groupBy("key").agg(F.countDistinct("cik").alias("n"), F.min("cik").alias("cik")).where("n = 1").drop("n")


def cik_map(members: DataFrame, filers: DataFrame, tickers: DataFrame, current: DataFrame) -> DataFrame:
    """(ticker, security, cik, method) by the first evidence that holds.

    The ticker list counts for current members and filers only; then the cik that
    the constituents name; then the name: whole, without spaces, its first two
    words, each only if one filer has it.
    """
    m = members.select("ticker", "security").distinct().withColumn("name", normalise_name("security"))
    two = lambda c: F.when(F.size(F.split(c, " ")) >= 2, F.array_join(F.slice(F.split(c, " "), 1, 2), " "))
    f = filers.select("cik", normalise_name("name").alias("name")).distinct()
    listed = tickers.join(filers.select("cik").distinct(), "cik", "left_semi").join(current.select("ticker"), "ticker", "left_semi").select("ticker", F.col("cik").alias("c1"))
    named = current.where("cik is not null").select("ticker", F.col("cik").alias("c2"))
    whole = _only(f, F.col("name")).select(F.col("key").alias("name"), F.col("cik").alias("c3"))
    tight = _only(f, F.replace("name", F.lit(" "))).select(F.col("key").alias("tight"), F.col("cik").alias("c4"))
    start = _only(f, F.coalesce(two(F.col("name")), F.lit(""))).select(F.col("key").alias("start"), F.col("cik").alias("c5"))
    rows = m.withColumns({"tight": F.replace("name", F.lit(" ")), "start": two(F.col("name"))})
    rows = rows.join(listed, "ticker", "left").join(named, "ticker", "left").join(whole, "name", "left").join(tight, "tight", "left").join(start, "start", "left")
    methods = ("ticker_list", "constituents", "name", "squashed_name", "two_words")
    method = F.coalesce(*(F.when(F.col(f"c{i + 1}").isNotNull(), F.lit(x)) for i, x in enumerate(methods)), F.lit("unmatched"))
    return rows.select("ticker", "security", F.coalesce(*(F.col(f"c{i + 1}") for i in range(5))).alias("cik"), method.alias("method"))


def sector_map(ciks: DataFrame, filings: DataFrame) -> DataFrame:
    """(ticker, cik, sic, sector) from the latest code of each filer and the latest era of each ticker."""
    latest = filings.where("sic is not null").groupBy("cik").agg(F.max_by("sic", F.struct("filed", "adsh")).alias("sic"))
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("end").desc_nulls_first(), F.col("start").desc_nulls_last(), "cik"))
    eras = ciks.withColumn("__r", last).where("__r = 1").select("ticker", "cik")
    return eras.join(latest, "cik", "left").withColumn("sector", sic_to_sector("sic"))


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """By their sector, and in all: tickers and how many we give the same sector."""
    rows = ours.select("ticker", "sector").join(theirs.select("ticker", F.col("sector").alias("theirs")), "ticker")
    out = rows.rollup("theirs").agg(F.grouping("theirs").alias("__all"), F.count("*").alias("n"), F.count_if(F.col("sector") == F.col("theirs")).alias("same"))
    return out.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col("theirs")).alias("sector"), "n", "same", F.round(100.0 * F.col("same") / F.col("n"), 2).alias("pct"))


def best_filer(names: DataFrame, filers: DataFrame) -> DataFrame:
    """(ticker, cik, run): the filer whose name shares the longest run of first words; of ties the one with more filings."""
    a = names.select("ticker", F.split(normalise_name("security"), " ").alias("wa"))
    b = filers.groupBy("cik").agg(F.max_by("name", "filed").alias("name"), F.count("*").alias("n")).select("cik", "n", F.split(normalise_name("name"), " ").alias("wb"))
    # meet on the first word, so that no pair without a common run is made
    pairs = a.withColumn("w", F.col("wa")[0]).join(b.withColumn("w", F.col("wb")[0]), "w").where("w <> ''")
    same = F.transform(F.arrays_zip("wa", "wb"), lambda p: F.coalesce(p["wa"] == p["wb"], F.lit(False)))
    run = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))
    best = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("run").desc(), F.col("n").desc(), "cik"))
    return pairs.withColumn("run", run).withColumn("__r", best).where("__r = 1").select("ticker", "cik", "run")


def audit_class(has_any: Column, foreign: Column, other_match: Column) -> Column:
    """Why a member has no value: its map names a wrong filer, a foreign one, none with tagged data, or other."""
    return F.when(other_match, "map_wrong").when(foreign, "foreign_filer").when(~has_any, "no_xbrl").otherwise("other")

"""The warehouse tables seen as a market: prices, members, sectors, filings, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticker(key: str):
    return F.concat(F.lit("T"), F.col(key).cast("string")).alias("ticker")


def daily_prices(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(ticker, date, close, adj_close, volume): a price made of a supplier's lines, three trading days a month.

    A supplier ships on few days, and its volume-weighted price jumps; thirds of a
    month and a logarithm give series with some gaps and some jumps.
    """
    day = F.col("l_shipdate").cast("date")
    third = F.least(F.lit(2), F.floor((F.dayofmonth(day) - 1) / 10)).cast("int")
    rows = table(spark, sf_dir, "lineitem").where(where).groupBy(_ticker("l_suppkey"), F.date_add(F.trunc(day, "month"), 10 * third).alias("date"))
    close = F.round(50 + 10 * F.ln(F.sum("l_extendedprice") / F.sum("l_quantity")), 6)
    return rows.agg(close.alias("close"), F.sum("l_quantity").alias("volume")).withColumn("adj_close", F.col("close"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, security, start, end): every supplier is a member for a while, a third for good."""
    start = F.date_add(F.lit("1995-01-01").cast("date"), (37 * F.col("s_suppkey") % 1200).cast("int"))
    end = F.when(F.col("s_suppkey") % 3 != 0, F.date_add(start, 900))
    return table(spark, sf_dir, "supplier").select(_ticker("s_suppkey"), F.col("s_name").alias("security"), start.alias("start"), end.alias("end"))


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, security, date_added) of today's members."""
    return membership(spark, sf_dir).where("end is null").select("ticker", "security", F.col("start").alias("date_added"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, date, added, added_security, removed, removed_security): changes as a page would list them.

    Some additions are missing, and some name the ticker by an old symbol.
    """
    m = membership(spark, sf_dir).withColumn("k", F.substring("ticker", 2, 20).cast("long"))
    none = F.lit(None).cast("string")
    name = F.when(F.col("k") % 15 == 0, F.concat(F.lit("OLD"), F.col("k").cast("string"))).otherwise(F.col("ticker"))
    added = m.where("k % 7 <> 0").select((2 * F.col("k")).alias("row"), F.col("start").alias("date"), name.alias("added"), F.col("security").alias("added_security"), none.alias("removed"), none.alias("removed_security"))
    removed = m.where("end is not null").select((2 * F.col("k") + 1).alias("row"), F.date_add("end", 1).alias("date"), none.alias("added"), none.alias("added_security"), F.col("ticker").alias("removed"), F.col("security").alias("removed_security"))
    twice = removed.where("row % 13 = 0").select((F.col("row") + 1_000_000).alias("row"), F.add_months("date", -6).alias("date"), "added", "added_security", "removed", "removed_security")
    return added.unionByName(removed).unionByName(twice)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector): a supplier's region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(_ticker("s_suppkey"), F.col("r_name").alias("sector"))


def ciks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, cik, start, end): who files for a ticker; a quarter changes filer in 1998."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _ticker("s_suppkey"))
    cut, none = F.lit("1998-06-30").cast("date"), F.lit(None).cast("date")
    plain = s.where("s_suppkey % 4 <> 0").select("ticker", F.col("s_suppkey").alias("cik"), none.alias("start"), none.alias("end"))
    before = s.where("s_suppkey % 4 = 0").select("ticker", F.col("s_suppkey").alias("cik"), none.alias("start"), cut.alias("end"))
    after = s.where("s_suppkey % 4 = 0").select("ticker", (F.col("s_suppkey") + 1).alias("cik"), F.date_add(cut, 1).alias("start"), none.alias("end"))
    return plain.unionByName(before).unionByName(after)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, adsh, concept, tag, ddate, qtrs, value, filed, form, fy): an order is a filed fact."""
    o = table(spark, sf_dir, "orders")
    ddate = F.last_day(F.col("o_orderdate").cast("date"))
    concept = F.substring("o_orderpriority", 1, 1)
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("10-K/A")
    return o.select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("adsh"), F.concat(F.lit("c"), concept).alias("concept"), F.concat(F.lit("Tag"), (F.col("o_orderkey") % 3).cast("string")).alias("tag"),
        ddate.alias("ddate"), (F.col("o_orderkey") % 5).cast("int").alias("qtrs"), F.col("o_totalprice").alias("value"), F.date_add(ddate, (F.col("o_orderkey") % 90).cast("int")).alias("filed"), form.alias("form"), F.year("o_orderdate").alias("fy"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, ratio)."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0")
    return s.select(_ticker("s_suppkey"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") * 11 % 700).cast("int")).alias("date"), (2.0 + F.col("s_suppkey") % 2).alias("ratio"))


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, adsh, ddate, filed, form, value, fy): public floats of annual filings."""
    rows = filings(spark, sf_dir).where("form <> '10-Q'")
    return rows.select("cik", "adsh", "ddate", "filed", "form", F.round(F.col("value") * (1 + F.col("adsh").cast("long") % 7), 2).alias("value"), "fy")


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, adsh, ddate, filed, form, value, fy): share counts on cover pages."""
    rows = filings(spark, sf_dir)
    return rows.select("cik", "adsh", F.date_sub("ddate", 20).alias("ddate"), "filed", "form", (10.0 + F.col("adsh").cast("long") % 90).alias("value"), "fy")


def market_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, mkt_rf, smb, hml): monthly series made of order totals by segment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.last_day(F.col("o_orderdate").cast("date")).alias("month"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("month")

    def part(name: str):
        return F.coalesce(F.avg(F.when(F.col("c_mktsegment") == name, F.col("o_totalprice"))), F.lit(0.0)) / 1e6

    return rows.agg(F.round(F.avg("o_totalprice") / 1e6 - 0.15, 9).alias("mkt_rf"), F.round(part("BUILDING") - part("MACHINERY"), 9).alias("smb"), F.round(part("AUTOMOBILE") - part("FURNITURE"), 9).alias("hml"))

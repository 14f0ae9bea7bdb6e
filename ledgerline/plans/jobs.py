"""Whole builds: each step reads the tables of the steps before it below one root and writes its own."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.config import Config
from ledgerline.operators import audit, facts, intervals, prices, runs, sectors, textsim
from ledgerline.sources import files, incremental, tables, zips


@dataclass(frozen=True)
class Tree:
    """A root folder with one Parquet table a name."""

    spark: SparkSession
    root: str
    #: The stamp of each step that has run or been found, and the names of those that were built.
    stamps: dict[str, str] = field(default_factory=dict)
    built: list[str] = field(default_factory=list)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.uri(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.uri(name))

    def step(self, name: str, build: Callable[[], DataFrame], *after: str, stamp: str = "") -> DataFrame:
        """The table ``name``, built unless it stands under the same stamp: its own and those of the steps it comes ``after``.

        The mark of a table goes before it is written and comes after, so a build that
        broke off goes on from the step that failed, and a step whose input changed
        is done again with all that follow from it.
        """
        own = hashlib.sha256("|".join([stamp, *(f"{a}={self.stamps[a]}" for a in after)]).encode()).hexdigest()[:16]
        marks = self.uri(f"_marks/{name}")
        held = self.spark.read.parquet(marks).first()[0] if tables.exists(self.spark, marks) else None
        if held != own:
            mark = lambda value: self.spark.createDataFrame([(value,)], "stamp string").coalesce(1).write.mode("overwrite").parquet(marks)
            mark("")
            self.save(name, build())
            mark(own)
            self.built.append(name)
        self.stamps[name] = own
        return self.read(name)

    def find(self, name: str) -> DataFrame | None:
        return tables.optional(self.spark, self.uri(name))


def universe(tree: Tree, walked: DataFrame, snapshots: DataFrame, overrides: DataFrame, other: DataFrame, cfg: Config) -> DataFrame:
    """Intervals of the walk, their starts adjudicated and overridden, held against another list."""
    settled = intervals.adjudicate(walked, snapshots)
    tree.save("adjudicated", settled)
    out = tree.save("membership", intervals.apply_overrides(settled.select("ticker", "start", "end"), overrides).select("ticker", "start", "end"))
    tree.save("reconciliation", intervals.reconcile(intervals.member_panel(out, cfg.start, cfg.end), other)[0])
    return out


def price_panel(tree: Tree, daily: DataFrame, second: DataFrame | None, membership: DataFrame, cfg: Config, threshold: float = 0.5) -> DataFrame:
    """Cleaned prices, gaps filled by a second source if there is one, monthly returns and their coverage."""
    clean, log = prices.clean_daily(daily, membership, 1.4, 1.8)
    tree.save("clean_log", log)
    merged = tree.save("prices_daily", clean if second is None else prices.merge_sources(clean, second, threshold).select(*clean.columns))
    monthly = tree.save("returns_monthly", prices.monthly_returns(merged, cfg.lag_days, cfg.start, cfg.end))
    months, gaps = prices.coverage(membership, monthly, cfg.start, cfg.end)
    tree.save("price_gaps", gaps)
    tree.save("price_coverage", months)
    return monthly


def ciks_of(eras: DataFrame, membership: DataFrame) -> DataFrame:
    """(cik): the filers of all names that were ever members."""
    return eras.join(membership.select("ticker").distinct(), "ticker", "left_semi").select("cik").distinct()


def fundamentals(tree: Tree, filings: DataFrame, kinds: DataFrame, cik_months: DataFrame, concepts: list[str], cfg: Config) -> DataFrame:
    """First-filed facts of the universe as of each month, wide, with their coverage."""
    long = tree.save("facts_long", facts.long_panel(cik_months, facts.eligible(filings, kinds), cfg.filing_buffer_days, cfg.max_age_months))
    wide = tree.save("fundamentals_monthly", facts.wide_panel(cik_months, long, concepts))
    tree.save("fundamentals_coverage", facts.concept_coverage(wide, cik_months.select("month", "ticker"), concepts))
    return wide


def ingest(tree: Tree, zips_uri: str, tags: dict[str, tuple[list[str], str]], forms: list[str], version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Typed facts of all quarterly zip files, with ``part`` for the quarter, and the (part, path, stamp) of the quarters that were read now.

    A quarter is read again when its file or the tag map has changed; the others stay as they are.
    """
    names = sorted({tag for own, _ in tags.values() for tag in own})
    salt = files.tag_map_hash(json.dumps(tags, sort_keys=True).encode(), version)
    wanted = incremental.file_stamps(tree.spark, f"{zips_uri}/*.zip", r"([^/]+)\.zip$", salt)

    def build(stale: DataFrame) -> DataFrame:
        paths = [r["path"] for r in stale.select("path").collect()]  # one a quarter
        part = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
        num, _ = files.tab_lines(zips.zip_lines(tree.spark, paths, r"^num\.txt$"), files.NUM, ("path",))
        sub, _ = files.tab_lines(zips.zip_lines(tree.spark, paths, r"^sub\.txt$"), files.SUB)
        return files.filing_values(num.withColumn("part", part), sub, names, forms, ("part",))

    return incremental.refresh(tree.spark, tree.uri("facts"), wanted, build)


def ingest_index(tree: Tree, zips_uri: str, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """The index of annual reports of all quarterly zip files, each report once, and the quarters that were read now."""
    wanted = incremental.file_stamps(tree.spark, f"{zips_uri}/*.zip", r"([^/]+)\.zip$", f"index {version}")

    def build(stale: DataFrame) -> DataFrame:
        paths = [r["path"] for r in stale.select("path").collect()]  # one a quarter
        sub, _ = files.tab_lines(zips.zip_lines(tree.spark, paths, r"^sub\.txt$"), files.SUB, ("path",))
        return files.filing_index(sub.withColumn("part", F.regexp_extract("path", r"([^/]+)\.zip$", 1)), ("part",))

    held, now = incremental.refresh(tree.spark, tree.uri("index"), wanted, build)
    return held.drop("part").dropDuplicates(["adsh"]), now


def filer_map(tree: Tree, members: DataFrame, filers: DataFrame, tickers: DataFrame, current: DataFrame, overrides: DataFrame | None = None, stamp: str = "") -> DataFrame:
    """(ticker, start, end, cik): the filer of each name, eras written by hand in place of the match; the whole log of matches is kept."""
    log = tree.step("cik_log", lambda: sectors.cik_map(members, filers, tickers, current), stamp=stamp)

    def build() -> DataFrame:
        none = F.lit(None).cast("date")
        found = log.where("cik is not null").select("ticker", none.alias("start"), none.alias("end"), "cik").distinct()
        if overrides is None:
            return found
        return found.join(overrides.select("ticker").distinct(), "ticker", "left_anti").unionByName(overrides.select("ticker", "start", "end", "cik"))

    return tree.step("ciks", build, "cik_log")


def share_build(tree: Tree, membership: DataFrame, shares_pages: DataFrame, float_pages: DataFrame, splits: DataFrame, daily: DataFrame, stamp: str = "") -> dict[str, DataFrame]:
    """Cover counts, other share counts, public floats and splits of the filers that were ever members, after ``filer_map``.

    Pages are (cik, json) documents of facts; splits go up to the last day of prices.
    """
    wanted = tree.step("universe_ciks", lambda: ciks_of(tree.read("ciks"), membership), "ciks", stamp=stamp)
    of = lambda pages: pages.join(wanted, "cik", "left_semi")
    last = daily.agg(F.max("date").alias("__last"))
    return {
        "cover_shares": tree.step("cover_shares", lambda: files.facts_cover(of(shares_pages)), "universe_ciks", stamp=stamp),
        "api_shares": tree.step("api_shares", lambda: tables.api_shares(files.facts_fallback(of(shares_pages), "shares")), "universe_ciks", stamp=stamp),
        "public_float": tree.step("public_float", lambda: files.facts_float(of(float_pages)), "universe_ciks", stamp=stamp),
        "splits": tree.step("splits", lambda: splits.join(F.broadcast(last)).where("ratio > 0 and date <= __last").drop("__last"), stamp=stamp),  # one row
    }


def identity_build(tree: Tree, membership: DataFrame, quotes: DataFrame | None, daily: DataFrame, filers: DataFrame, eras: DataFrame, floats: DataFrame, cfg: Config, stamp: str = "") -> DataFrame | None:
    """Exclusion windows of names whose prices are another company's, from levels, first prices and names; None before there are quotes."""
    if quotes is None:
        return None
    levels = tree.step("price_levels", lambda: prices.price_levels(floats, tree.read("cover_shares"), tree.read("splits"), eras, daily, membership, cfg.start, cfg.end), "cover_shares", "splits", stamp=stamp)
    first = daily.groupBy("ticker").agg(F.min("date").alias("first_price"))
    flags = tree.step("identity", lambda: prices.identity_check(membership, quotes, first, prices.names_by_ticker(eras, filers), levels), "price_levels", stamp=stamp)
    return tree.step("identity_windows", lambda: tables.identity_windows(flags, cfg.end), "identity")


def sector_table(tree: Tree, filings: DataFrame, ciks: DataFrame, theirs: DataFrame) -> DataFrame:
    """(ticker, cik, start, end, sector): every era with the sector of the ticker's latest one; and the agreement with another table."""
    latest = sectors.sector_map(ciks, filings).select("ticker", "sector")
    out = tree.save("sectors", ciks.join(latest, "ticker", "left").select("ticker", "cik", "start", "end", "sector"))
    tree.save("sector_check", sectors.agreement(latest, theirs))
    return out


def text_table(tree: Tree, index: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """Similarity of each filing with the one before it, and how many of the documents (doc, text) could be compared."""
    scored = tree.save("text_similarity", textsim.score(textsim.neighbours(index), docs, min_words))
    tree.save("text_coverage", textsim.coverage(index, textsim.lengths(docs), scored, min_words))
    return scored


def benchmarks(tree: Tree, five: DataFrame, momentum: DataFrame, by_value: DataFrame, by_profit: DataFrame) -> DataFrame:
    """Factor returns with the big-cap legs: high less low book-to-market and profitability."""
    value = by_value.select("month", (F.col("big_hibm") - F.col("big_lobm")).alias("big_hml"))
    profit = by_profit.select("month", (F.col("big_hiop") - F.col("big_loop")).alias("big_rmw"))
    return tree.save("factors", five.join(momentum, "month", "left").join(value, "month", "left").join(profit, "month", "left"))


def load_inputs(tree: Tree, raw: dict[str, DataFrame], plain: frozenset[str]) -> runs.Inputs:
    """What runs need from the built tables; those that have not been built are left out, a series of its own joins the factors."""
    factors, extra = tree.read("factors"), tree.find("betting")
    return runs.Inputs(raw, tree.read("returns_monthly"), factors if extra is None else factors.join(extra, "month", "left"), tree.find("sectors"), tree.find("market_cap"), tree.find("returns_terminal"), plain)


def drift(spark: SparkSession, old: Tree, new: Tree, keys: dict[str, list[str]]) -> DataFrame:
    """(table, what, n): how the tables of two builds differ; no rows if the build is repeatable."""
    out = spark.createDataFrame([], "table string, what string, n long")
    for name, own in keys.items():
        out = out.unionByName(audit.drifted(old.read(name), new.read(name), own).select(F.lit(name).alias("table"), "what", "n"))
    return out

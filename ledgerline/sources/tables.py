"""Tables that may be missing, override files with checked domains, and caches that know what made them."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from datetime import date
from io import BytesIO
from xml.etree import ElementTree
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "stamp"
EXCLUSIONS = "ticker string, start date, end date, reason string, source_check string"
SHARE_SOURCES = ("cover", "balance_sheet", "weighted_average", "unresolved")


def exists(spark: SparkSession, uri: str) -> bool:
    """Whether a file or folder is there, in whatever store the URI names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def optional(spark: SparkSession, uri: str) -> DataFrame | None:
    """A Parquet table without its stamps, or None before it has been built."""
    return spark.read.parquet(uri).drop("as_of", STAMP) if exists(spark, uri) else None


def optional_csv(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """A CSV file with a header under a fixed schema; no rows if there is no file."""
    return spark.read.option("header", True).schema(schema).csv(uri) if exists(spark, uri) else spark.createDataFrame([], schema)


def overrides(spark: SparkSession, uri: str, schema: str, column: str | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """An override file; a value of ``column`` that is not allowed is an error at once."""
    rows = optional_csv(spark, uri, schema)
    if column:
        bad = rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).first()
        if bad:
            raise ValueError(f"{uri}: {column} {bad[0]!r} is none of {', '.join(allowed)}")
    return rows


def cached(spark: SparkSession, uri: str, stamp: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table at ``uri`` if it was built under ``stamp``, else built again; and whether it was."""
    if exists(spark, uri):
        held = spark.read.parquet(uri)
        first = held.select(STAMP).limit(1).collect() if STAMP in held.columns else []
        if first and first[0][0] == stamp:
            return held.drop(STAMP), False
    build().withColumn(STAMP, F.lit(stamp)).write.mode("overwrite").parquet(uri)
    return spark.read.parquet(uri).drop(STAMP), True


def tag_map(text: str) -> dict[str, tuple[list[str], str]]:
    """concept -> (tags in order of preference, kind) from TOML."""
    return {name: (list(spec["tags"]), spec["kind"]) for name, spec in tomllib.loads(text)["concept"].items()}


def of_kind(tags: dict[str, tuple[list[str], str]], kind: str) -> list[str]:
    return [name for name, (_, own) in tags.items() if own == kind]


def tag_map_problems(base: dict[str, tuple[list[str], str]], head: dict[str, tuple[list[str], str]]) -> list[str]:
    """What a new tag map breaks: tags may only be added at the end, and nothing may go."""
    out = []
    for name, (tags, kind) in base.items():
        if name not in head:
            out.append(f"{name}: concept removed")
            continue
        if head[name][1] != kind:
            out.append(f"{name}: kind changed")
        if head[name][0][: len(tags)] != tags:
            out.append(f"{name}: existing tags removed or reordered")
    return out


def quarters(spark: SparkSession, first: tuple[int, int], last: date) -> DataFrame:
    """(quarter): "2009q1" and so on, up to the quarter that ``last`` is in."""
    start = date(first[0], 3 * first[1] - 2, 1)
    days = spark.createDataFrame([(start, last)], "a date, b date").where("a <= b")
    day = days.select(F.explode(F.sequence("a", F.col("b"), F.expr("interval 3 months"))).alias("d"))
    return day.select(F.concat(F.year("d").cast("string"), F.lit("q"), F.quarter("d").cast("string")).alias("quarter"))


def identity_windows(flags: DataFrame, end: date) -> DataFrame:
    """Flagged memberships as windows over the whole membership; one without an end runs to ``end``."""
    return flags.where("flag").select("ticker", F.col("member_start").alias("start"), F.coalesce("member_end", F.lit(end)).alias("end"), "reason", F.lit("identity").alias("source_check"))


def exclusions(spark: SparkSession, *checks: tuple[DataFrame | None, str]) -> DataFrame:
    """The windows of all checks that have run, each named; a check that has not adds nothing."""
    out = spark.createDataFrame([], EXCLUSIONS)
    for rows, name in checks:
        if rows is not None:
            out = out.unionByName(rows.select("ticker", "start", "end", "reason", F.lit(name).alias("source_check")))
    return out


def api_shares(rows: DataFrame) -> DataFrame:
    """Fallback share counts in the shape of filed facts."""
    none = F.lit("")
    return rows.select("adsh", "cik", "concept", F.lit("companyconcept").alias("tag"), "ddate", "qtrs", "value", "filed", "form", F.year("ddate").alias("fy"), none.alias("fp"), F.lit(None).cast("int").alias("sic"), none.alias("name"))


def all_floats(api: DataFrame | None, facts: DataFrame, concept: str) -> DataFrame:
    """Public floats of the API, if there are any, and of the annual filings."""
    own = facts.where((F.col("concept") == concept) & F.col("form").startswith("10-K")).select("cik", "adsh", "ddate", "filed", "form", "value", "fy")
    return own if api is None else api.select(own.columns).unionByName(own)


def quotes(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """(ticker, quote_name, exchange, currency, quote_type) from documents of one record a ticker."""
    records = F.from_json(F.col(json_col), "map<string, struct<longName: string, exchange: string, currency: string, quoteType: string>>")
    return pages.select(F.explode(records).alias("ticker", "r")).select("ticker", F.col("r.longName").alias("quote_name"), "r.exchange", "r.currency", F.col("r.quoteType").alias("quote_type"))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet(content: bytes, name: str) -> list[dict[str, str]]:
    """Rows of one sheet of a workbook: column letters to cell texts."""
    with ZipFile(BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        wanted = [s.get(_REL) for s in book.iter(f"{_MAIN}sheet") if s.get("name") == name]
        if not wanted:
            raise ValueError(f"no sheet {name!r}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        root = ElementTree.fromstring(z.read("xl/" + links[wanted[0]].removeprefix("/xl/")))
    out = []
    for row in root.iter(f"{_MAIN}row"):
        cells = {}
        for c in row.iter(f"{_MAIN}c"):
            value = c.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
            cells["".join(x for x in c.get("r") if x.isalpha())] = shared[int(text)] if c.get("t") == "s" else text
        out.append(cells)
    return out


def sheet_cells(books: DataFrame, name: str) -> DataFrame:
    """(path, row, letter, text): the cells of one sheet of each workbook (path, content), read in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, y, letter, text) for y, row in enumerate(sheet(bytes(content), name)) for letter, text in row.items()], columns=["path", "row", "letter", "text"])

    return books.select("path", "content").mapInPandas(run, "path string, row long, letter string, text string")


def dated_column(cells: DataFrame, column: str, name: str) -> DataFrame:
    """(month, name) of sheets whose header is the first row with a cell DATE; rows without a date or a number are dropped."""
    head = cells.where("text = 'DATE'").groupBy("path").agg(F.min("row").alias("head"))
    titles = cells.join(head, "path").where("row = head").select("path", "head", "letter", "text")
    date_at, value_at = (titles.where(F.col("text") == t).groupBy("path", "head").agg(F.min("letter").alias("letter")) for t in ("DATE", column))
    pick = lambda at, out: cells.join(at, ["path", "letter"]).where("row > head").select("path", "row", F.col("text").alias(out))
    rows = pick(date_at, "d").join(pick(value_at, "v"), ["path", "row"])
    return rows.select(F.last_day(F.try_to_date("d", "M/d/yyyy")).alias("month"), F.col("v").try_cast("double").alias(name)).dropna()


def tag_map_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(problem): what a new tag map breaks, both maps as (concept, tags, kind): tags may only be added at the end, and nothing may go."""
    both = base.select("concept", F.col("tags").alias("old"), F.col("kind").alias("old_kind")).join(head.select("concept", "tags", "kind", F.lit(True).alias("held")), "concept", "left")
    held = F.col("held").isNotNull()
    moved = ~F.coalesce(F.slice("tags", F.lit(1), F.size("old")) == F.col("old"), F.lit(False))
    found = [F.when(~held, "concept removed"), F.when(held & ~F.col("kind").eqNullSafe(F.col("old_kind")), "kind changed"), F.when(held & moved, "existing tags removed or reordered")]
    return both.select("concept", F.explode(F.array_compact(F.array(*found))).alias("what")).select(F.concat("concept", F.lit(": "), "what").alias("problem"))

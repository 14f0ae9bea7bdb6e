"""Readers of the raw files: vendor CSV, filing text, nested JSON, HTML tables; and the write-once store."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import compact_date, parse_date
from ledgerline.functions.names import clean_ticker

NUM = "adsh string, tag string, version string, ddate string, qtrs string, uom string, segments string, coreg string, value string, footnote string"
SUB = "adsh string, cik string, name string, sic string, form string, period string, fy string, fp string, filed string, accepted string, instance string"
FACTS = "struct<units: map<string, array<struct<accn: string, start: string, end: string, filed: string, form: string, val: double, fy: int>>>>"


def store_raw(root: Path, name: str, content: bytes, url: str) -> Path:
    """Writes a file once, with its checksum in the manifest; a second write is an error."""
    path = root / name
    if path.exists():
        raise FileExistsError(f"{path} is never overwritten")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    manifest = root / "manifest.json"
    rows = json.loads(manifest.read_text()) if manifest.exists() else []
    rows.append({"path": name, "url": url, "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content), "fetched_at": datetime.now(UTC).isoformat()})
    manifest.write_text(json.dumps(rows, indent=1))
    return path


def latest(root: Path, pattern: str) -> Path:
    """The last file of a pattern by name."""
    found = sorted(root.glob(pattern))
    if not found:
        raise FileNotFoundError(f"no {pattern} below {root}")
    return found[-1]


def tag_map_hash(content: bytes, version: str) -> str:
    return hashlib.sha256(content + version.encode()).hexdigest()[:16]


def vendor_prices(spark: SparkSession, paths: list[str] | str, adjusted: str = "Adj Close", name: str = r"([^/]*)\.csv$") -> DataFrame:
    """(ticker, date, close, adj_close, volume) of one CSV a ticker; prices that are not positive are dropped.

    ``name`` finds the ticker in a file's path: it is the file's name, or a folder's.
    """
    raw = spark.read.option("header", True).csv(paths)
    plain = {re.sub("[^a-z]", "", c.lower()): c for c in raw.columns}
    number = lambda c: F.col(f"`{plain[c]}`").try_cast("double")
    rows = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("ticker"), F.col(f"`{plain['date']}`").try_cast("date").alias("date"),
        number("close").alias("close"), number(re.sub("[^a-z]", "", adjusted.lower())).alias("adj_close"), number("volume").alias("volume"),
    )
    return rows.where("adj_close > 0 and date is not null")


def filing_values(num: DataFrame, sub: DataFrame, tags: list[str], forms: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed facts of chosen tags and forms in dollars or shares, without segments; with columns of ``num`` to ``keep``."""
    kept = num.where(F.col("tag").isin(tags) & F.col("uom").isin("USD", "shares") & (F.coalesce("segments", F.lit("")) == "") & (F.coalesce("coreg", F.lit("")) == ""))
    rows = kept.join(sub.where(F.col("form").isin(forms)), "adsh")
    return rows.select(
        "adsh", F.col("cik").try_cast("bigint").alias("cik"), "tag", compact_date("ddate").alias("ddate"), F.col("qtrs").try_cast("int").alias("qtrs"), F.col("value").try_cast("double").alias("value"),
        compact_date("filed").alias("filed"), "form", F.col("fy").try_cast("int").alias("fy"), F.col("sic").try_cast("int").alias("sic"), "name", *keep,
    ).dropna(subset=["cik", "ddate", "qtrs", "value", "filed"])


def tab_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated text without quoting; lines of another width are dropped."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "DROPMALFORMED").schema(schema).csv(path)


def tab_lines(lines: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of tab-separated lines without quoting, and (path, malformed): how many lines of another width each file has.

    The first line of a member is its header; ``keep`` names columns of the lines that the rows carry.
    """
    names = [x.split()[0] for x in schema.split(",")]
    parts = lines.where("n > 0").withColumn("cells", F.split("line", "\t", -1)).withColumn("whole", F.size("cells") == len(names))
    rows = parts.where("whole").select(*(F.nullif(F.col("cells")[i], F.lit("")).alias(name) for i, name in enumerate(names)), *keep)
    return rows, parts.groupBy("path").agg(F.count_if(~F.col("whole")).alias("malformed"))


def filing_index(sub: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(adsh, cik, form, period, fy, filed, accepted, instance) of original annual reports, with columns of ``sub`` to ``keep``."""
    rows = sub.where(F.col("form").isin("10-K", "10-KT"))
    return rows.select("adsh", F.col("cik").try_cast("bigint").alias("cik"), "form", compact_date("period").alias("period"), F.col("fy").try_cast("int").alias("fy"), compact_date("filed").alias("filed"), F.expr("try_to_timestamp(substr(accepted, 1, 19))").cast("timestamp_ntz").alias("accepted"), "instance", *keep).dropDuplicates(["adsh"])


def company_facts(pages: DataFrame, unit: str, json_col: str = "json") -> DataFrame:
    """(cik, accn, start, end, filed, form, val, fy) of one unit of a facts document; broken documents have none."""
    units = F.from_json(F.col(json_col), FACTS)["units"][unit]
    return pages.select("cik", F.explode(units).alias("u")).select("cik", "u.*")


def facts_float(pages: DataFrame) -> DataFrame:
    rows = company_facts(pages, "USD").where("form like '10-K%' and val > 0")
    return rows.select("cik", F.col("accn").alias("adsh"), F.col("end").try_cast("date").alias("ddate"), F.col("filed").try_cast("date").alias("filed"), "form", F.col("val").alias("value"), "fy")


def facts_cover(pages: DataFrame) -> DataFrame:
    rows = company_facts(pages, "shares").where("val > 0")
    return rows.select("cik", F.col("accn").alias("adsh"), F.col("end").try_cast("date").alias("ddate"), F.col("filed").try_cast("date").alias("filed"), "form", F.col("val").alias("value"), "fy")


def facts_fallback(pages: DataFrame, concept: str) -> DataFrame:
    """Share counts with their length in quarters: 0 for an instant, at least 1 for a span."""
    rows = company_facts(pages, "shares").withColumns({"ddate": F.col("end").try_cast("date"), "from": F.col("start").try_cast("date")})
    months = F.months_between("ddate", "from")
    quarters = F.when(F.col("from").isNull(), 0).otherwise(F.greatest(F.lit(1), F.bround(months / 3).cast("int")))
    return rows.select("cik", F.col("accn").alias("adsh"), F.lit(concept).alias("concept"), "ddate", quarters.alias("qtrs"), F.col("val").alias("value"), F.col("filed").try_cast("date").alias("filed"), "form")


def ticker_list(text: DataFrame, json_col: str = "json") -> DataFrame:
    """(ticker, cik) of a document of numbered records, under both spellings of a share class."""
    records = F.from_json(F.col(json_col), "map<string, struct<cik_str: bigint, ticker: string>>")
    rows = text.select(F.explode(F.map_values(records)).alias("r")).select(F.upper("r.ticker").alias("ticker"), F.col("r.cik_str").alias("cik"))
    return rows.unionByName(rows.withColumn("ticker", F.replace("ticker", F.lit("-"), F.lit(".")))).distinct()


def primary_documents(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """(adsh, form, filed, document) from submission pages, whether the lists stand at the top or under filings.recent."""
    lists = "struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, primaryDocument: array<string>>"
    top, nested = F.from_json(F.col(json_col), lists), F.from_json(F.col(json_col), f"struct<filings: struct<recent: {lists}>>")["filings"]["recent"]
    best = F.when(top["accessionNumber"].isNotNull(), top).otherwise(nested)
    rows = pages.select(best.alias("p")).select(F.explode(F.arrays_zip("p.accessionNumber", "p.form", "p.filingDate", "p.primaryDocument")).alias("z"))
    return rows.select(F.col("z.accessionNumber").alias("adsh"), F.col("z.form").alias("form"), F.col("z.filingDate").try_cast("date").alias("filed"), F.col("z.primaryDocument").alias("document"))


def monthly_block(texts: DataFrame, names: list[str]) -> DataFrame:
    """(path, month, names…) of the first block of yyyymm lines of factor files (path, text), percent as fractions; what is no number is null."""
    lines = texts.select("path", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("at", "line")).withColumn("cells", F.split("line", ","))
    months = lines.where(F.trim(F.get("cells", F.lit(0))).rlike("^\\d{6}$"))
    order = Window.partitionBy("path").orderBy("at")
    block = F.col("at") - F.row_number().over(order)
    first = months.withColumn("block", block).withColumn("first", F.first("block").over(order)).where("block = first")
    values = [(F.trim(F.get("cells", F.lit(i))).try_cast("double") / 100).alias(n) for i, n in enumerate(names, 1)]
    return first.select("path", F.last_day(F.try_to_date(F.trim(F.get("cells", F.lit(0))), "yyyyMM")).alias("month"), *values)


def dotted_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(date, name) of a two-column CSV whose missing values are dots."""
    raw = spark.read.option("header", True).option("nullValue", ".").csv(path)
    return raw.select(F.col(f"`{raw.columns[0]}`").try_cast("date").alias("date"), F.col(f"`{raw.columns[1]}`").try_cast("double").alias(name)).dropna()


def delistings(spark: SparkSession, path: str, universe: DataFrame) -> DataFrame:
    """(ticker, delisting_date, reason) of members, dashes spelled as dots."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(F.replace("ticker", F.lit("-"), F.lit(".")).alias("ticker"), F.col("delisting_date").try_cast("date").alias("delisting_date"), "reason")
    return rows.join(universe.select("ticker").distinct(), "ticker", "left_semi")


def snapshots(rows: DataFrame) -> DataFrame:
    """(date, ticker) from (date, tickers): comma lists, without date suffixes, dashes as dots."""
    each = rows.select(F.col("date").try_cast("date").alias("date"), F.explode(F.split("tickers", ",")).alias("one"))
    return each.select("date", F.replace(F.regexp_replace(F.trim("one"), r"-\d{6}$", ""), F.lit("-"), F.lit(".")).alias("ticker")).where("ticker <> ''").distinct()


class _Cells(HTMLParser):
    """Cells of one table, by its id or the first: (row, text, rowspan, colspan)."""

    def __init__(self, table_id: str | None):
        super().__init__(convert_charrefs=True)
        self.want, self.depth, self.skip = table_id, 0, 0
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.done = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        if tag == "table" and not self.done and (self.depth or self.want is None or have.get("id") == self.want):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            self.cell, self.spans = [], (int(have.get("rowspan") or 1), int(have.get("colspan") or 1))
        elif self.depth and tag in ("sup", "style"):
            self.skip += 1
        elif self.cell is not None and tag == "br":
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.depth:
            return
        if tag == "table":
            self._close()
            self.depth -= 1
            self.done = self.depth == 0
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()
        elif tag in ("sup", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.skip:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.spans))
        self.cell = None


def table_rows(html: str, table_id: str | None = None) -> list[list[str]]:
    """The table as a grid: a cell that spans rows or columns stands in each of them."""
    parser = _Cells(table_id)
    parser.feed(html or "")
    parser.close()
    grid: dict[tuple[int, int], str] = {}
    for y, row in enumerate(parser.rows):
        x = 0
        for text, down, across in row:
            while (y, x) in grid:
                x += 1
            for dy in range(down):
                for dx in range(across):
                    grid[y + dy, x + dx] = text
            x += across
    height = len(parser.rows)
    return [[grid[y, x] for x in range(1 + max((c for r, c in grid if r == y), default=-1)) if (y, x) in grid] for y in range(height)]


def html_table(pages: DataFrame, id_col: str, html_col: str, table_id: str | None = None) -> DataFrame:
    """(id, row, cells) of a table in every page; parsing is the one thing Spark has no function for."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, y, cells) for i, html in zip(batch["id"], batch["html"], strict=True) for y, cells in enumerate(table_rows(html, table_id))]
            yield pd.DataFrame(rows, columns=["id", "row", "cells"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, row int, cells array<string>")


def constituents(cells: DataFrame) -> DataFrame:
    """Current members from table rows: symbol, security, sector, sub-industry, headquarters, date added, cik."""
    c = F.col("cells")
    return cells.where(F.size("cells") >= 7).select(clean_ticker(c[0]).alias("ticker"), c[1].alias("security"), c[2].alias("sector"), c[3].alias("sub_industry"), parse_date(c[5]).alias("date_added"), F.lpad(c[6], 10, "0").alias("cik")).where("ticker is not null")


def changes(cells: DataFrame) -> DataFrame:
    """(row, date, added, added_security, removed, removed_security, reason) from table rows."""
    c = F.col("cells")
    rows = cells.where(F.size("cells") >= 6).select(F.col("row").cast("long").alias("row"), parse_date(c[0]).alias("date"), clean_ticker(c[1]).alias("added"), c[2].alias("added_security"), clean_ticker(c[3]).alias("removed"), c[4].alias("removed_security"), c[5].alias("reason"))
    return rows.where("date is not null and (added is not null or removed is not null)")


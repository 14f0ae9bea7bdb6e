"""Exact dedup by recipes of content-defined chunks: DataFrame functions only.

A text, A-Z lower-cased, is cut where its own content says so: after three code
points of fixed classes or a line's end, at least ``SHORTEST`` and at most
``LONGEST`` code points from the last cut. A chunk is known by two 64-bit hashes,
and its identifier is verified: all chunks of the corpus are brought together
once by hash and content, with a partial aggregation before the shuffle, and
where one pair of hashes stands for several contents each content after the first
(in byte order) gets a number of its own. A document is then the ordered list of
its identifiers, about a hundredth of its text, and only these lists are grouped
and joined; two texts are equal if and only if their lists are.

The lists of a group are counted by partial aggregation and its verdict is joined
back to the rows, so a group that holds a third of all rows is split by the
adaptive skew join; no group is gathered.

Edge cases: null and empty text are both the empty list, hence equal; the row
with the largest id stays, null ids come last; of rows that share both id and text
one stays; an empty table gives an empty result; the input's other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.columns import lower_ascii
from ledgerline.llm.store import written

#: Least and most code points of a chunk (the last of a text may be shorter).
SHORTEST, LONGEST = 256, 2048
#: What a cut follows.
CUT = r"[hpx][aeimquy][bfjnrvz]|[\n。！？]"
HASHES = ["h1", "h2"]


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text, in order; they join to the text itself."""
    pattern = rf"(?s).{{{shortest},{longest - 1}}}?(?:{CUT})|.{{1,{longest}}}+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hashes(chunk: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 64 - bits).alias(name) for h, name in zip((F.xxhash64(chunk), F.xxhash64(F.lit(1), chunk)), HASHES, strict=True)]


def twins(texts: DataFrame, bits: int = 64) -> DataFrame:
    """(h1, h2, chunk, twin): contents that share their hashes with a smaller one; twin counts from 1.

    ``texts`` has one column ``text``. Nearly always empty; that it is so is the proof
    that hashes identify the chunks of this corpus.
    """
    known = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(*_hashes(F.col("chunk"), bits), "chunk").distinct()
    shared = written(known.groupBy(*HASHES).count().where("count > 1").drop("count"), "twin-hashes")
    if shared.isEmpty():
        return shared.selectExpr(*HASHES, "'' AS chunk", "1 AS twin")
    order = F.row_number().over(Window.partitionBy(*HASHES).orderBy("chunk")) - 1
    return written(known.join(shared, HASHES).withColumn("twin", order).where("twin > 0"), "twins")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): one row a document, ``recipe`` the identifiers of its chunks in order.

    ``bits`` is how many of each hash count; fewer make twins likely, for tests.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    other = twins(texts.select("text"), bits)
    if other.isEmpty():
        recipe = F.transform("chunks", lambda c: F.struct(*_hashes(c, bits), F.lit(0).alias("twin")))
        return written(rows.select("row", "doc_id", "text_sha256", recipe.alias("recipe")), "recipes")
    parts = rows.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk")).select("*", *_hashes(F.col("chunk"), bits))
    named = parts.join(other, [*HASHES, "chunk"], "left").select("row", "doc_id", "text_sha256", F.when(F.col("pos").isNotNull(), F.struct("pos", *HASHES, F.coalesce("twin", F.lit(0)).alias("twin"))).alias("part"))
    listed = named.groupBy("row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return written(listed.select("row", "doc_id", "text_sha256", F.transform("parts", lambda p: F.struct(*(p[c].alias(c) for c in [*HASHES, "twin"]))).alias("recipe")), "recipes")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks): a row for each row of ``docs``."""
    rows = recipes(docs, id_col, text_col, bits).withColumn("key", F.xxhash64("recipe"))
    last = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "row")
    groups = written(rows.groupBy("key", "recipe").agg(F.max(last).alias("last"), F.count("*").alias("group_size")), "groups")  # a join of two tables, of which the rows' side can be split
    return rows.join(groups, ["key", "recipe"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks")
    )

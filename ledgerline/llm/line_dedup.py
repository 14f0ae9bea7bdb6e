"""Line dedup without moving text: DataFrame functions only.

Each line becomes two 64-bit hashes of its key with document and position. Each line becomes two 64-bit hashes of its key with document and position. The
texts are split and hashed once, into a table without text; its rows are
range-partitioned with a secondary sort by document and position, and windows
stream over the sorted runs to find first occurrences. A hash that a third of all
documents share would make one run too long, so runs are cut by a salt of the
document: a first round settles each (hash, salt) run, a second one the at most
one document of each salt that is left of a hash. There are as many salts as the
square root of the lines, so neither round has a run that grows as the corpus
does. What goes back to the documents is a keep bitmap, compressed by leaving out
its all-ones 64-bit words.

Edge cases: null or empty text is one empty line; keys under ``min_chars`` code
points always stay; rows with a null id keep all lines and never cost another
row a line; rows that share an id count as one document (each keeps the lines
that the id holds first); repeated rows get equal bitmaps; an empty table gives
an empty result; other columns are carried along untouched, but columns named
``__n_lines`` or ``__n_dropped`` give way to the results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.store import written

#: Least number of salts.
SALTS = 64
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_id, pos) of every line that an earlier document already has."""
    text = F.col(text_col).cast("string")
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), _text_id(text).alias("text_id"), F.posexplode(_lines(text)).alias("pos", "line"))
        .select("doc_id", "text_id", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    hashed = written(lines, "line-hashes")
    salts = max(SALTS, math.isqrt(hashed.count()))
    runs = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    in_run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    settled = written(runs.withColumn("lost", F.col("doc_id") != F.first("doc_id").over(in_run)).drop("salt"), "line-runs")
    of_hash = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    last = settled.where("not lost").withColumn("lost", F.col("doc_id") != F.first("doc_id").over(of_hash))
    return settled.where("lost").unionByName(last.where("lost")).select("doc_id", "text_id", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_id, n_dropped, keep) for documents that lose lines.

    ``keep`` maps a word's index to its 64 keep bits (bit i of word w is line
    64w+i); a word that is not there is all ones.
    """
    word, bit = F.floor(F.col("pos") / 64).cast("int"), (F.col("pos") % 64).cast("int")
    words = (
        dropped_lines(docs, id_col, text_col, min_chars)
        .groupBy("doc_id", "text_id", word.alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    )
    return words.groupBy("doc_id", "text_id").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cut to the kept lines, and ``__n_lines`` and ``__n_dropped`` added."""
    text = F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit(""))
    word = F.col("b.keep")

    def kept(_: Column, i: Column) -> Column:
        bits = F.coalesce(word[F.floor(i / 64).cast("int")], F.lit(-1).cast("long"))
        return F.call_function("getbit", bits, (i % 64).cast("int")) == 1

    rest = F.array_join(F.filter(_lines(text), kept), "\n")
    on = (F.col(f"d.{id_col}") == F.col("b.doc_id")) & (_text_id(text) == F.col("b.text_id"))
    cols = [F.when(word.isNull(), F.col(f"d.{c}")).otherwise(rest).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    return docs.alias("d").join(bitmaps.alias("b"), on, "left").select(
        *cols, F.size(_lines(text)).cast("long").alias("__n_lines"), F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("__n_dropped")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents with lines that an earlier document has taken out; see ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)

"""Word counts of documents, similarity of neighbouring filings, and the signal made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.arrays import merged, run_counts
from ledgerline.functions.words import to_words
from ledgerline.operators.asof import known_by
from ledgerline.sources.store import settled


def word_counts(docs: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(doc, word, n). Counting is a partial aggregation in the tasks; nothing is gathered."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(to_words(text_col)).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))


def first_originals(index: DataFrame) -> DataFrame:
    """The earliest original filing of each (cik, period)."""
    rank = F.row_number().over(Window.partitionBy("cik", "period").orderBy("filed", "accepted", "adsh"))
    return index.withColumn("__r", rank).where("__r = 1").drop("__r")


def neighbours(index: DataFrame, months: int = 18) -> DataFrame:
    """(cik, adsh, period, filed, prev_adsh, prev_period): each filing with the one before, if it is not too old."""
    order = Window.partitionBy("cik").orderBy("period")
    rows = first_originals(index).withColumns({"prev_adsh": F.lag("adsh").over(order), "prev_period": F.lag("period").over(order)})
    return rows.where(F.col("prev_adsh").isNotNull() & (F.col("prev_period") >= F.add_months("period", -months))).select("cik", "adsh", "period", "filed", "prev_adsh", "prev_period")


def term_vectors(docs: DataFrame, pairs: DataFrame | None = None, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(doc, terms, sq, words, length) of the documents that are in a pair (a, b), or of all.

    ``terms`` are the (hash of a word, count) of a document in order of the hash, so a
    document is one row from its text on and no (document, word) table is made.
    """
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if pairs is not None:
        source = source.join(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "doc", "left_semi")
    rows = source.select("doc", run_counts(F.transform(to_words("text"), lambda w: F.xxhash64(w))).alias("terms"))
    add = lambda part: F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + part(t["n"].cast("long")))
    return rows.select("doc", "terms", add(lambda n: n * n).alias("sq"), F.size("terms").cast("long").alias("words"), add(lambda n: n).alias("length"))


def lengths(docs: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(doc, length): the words of each document that has any."""
    return docs.select(F.col(id_col).alias("doc"), F.size(to_words(text_col)).cast("long").alias("length")).where("length > 0")


def similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine, jaccard, length_a, length_b) of pairs (a, b); 0 and 0 if either has no words.

    The two vectors of a pair meet in its row and are merged there.
    """
    side = lambda c: vectors.select(F.col("doc").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("terms", "sq", "words", "length")))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("shared", merged(F.col("terms_a"), F.col("terms_b")))
    cosine = F.try_divide(F.col("shared.dot"), F.sqrt(F.col("sq_a").cast("double") * F.col("sq_b")))
    jaccard = F.try_divide(F.col("shared.common"), F.col("words_a") + F.col("words_b") - F.col("shared.common"))
    return rows.select(*pairs.columns, F.coalesce(cosine, F.lit(0.0)).alias("cosine"), F.coalesce(jaccard, F.lit(0.0)).alias("jaccard"), F.coalesce("length_a", F.lit(0)).alias("length_a"), F.coalesce("length_b", F.lit(0)).alias("length_b"))


def score(pairs: DataFrame, docs: DataFrame, min_words: int, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """Similarity of neighbouring filings that both have at least ``min_words`` words; texts of other documents are not split."""
    named = settled(pairs.withColumnsRenamed({"adsh": "a", "prev_adsh": "b"}), "pairs")
    vectors = settled(term_vectors(docs, named, id_col, text_col), "vectors")
    rows = similarities(named, vectors).where((F.col("length_a") >= min_words) & (F.col("length_b") >= min_words))
    return rows.withColumnsRenamed({"a": "adsh", "b": "prev_adsh"})


def signal(months: DataFrame, scored: DataFrame, measure: str, buffer_days: int, max_age: int) -> DataFrame:
    """(month, ticker, value): the measure as known at each month (month, ticker, cik), unless it is too old."""
    facts = scored.select("cik", F.col("period").alias("ddate"), "filed", F.col(measure).alias("value"))
    known = known_by(months, facts, buffer_days)
    return known.where(F.col("value").isNotNull() & (F.col("period_end") >= F.add_months("month", -max_age))).select("month", "ticker", "value")


def coverage(index: DataFrame, lengths: DataFrame, scored: DataFrame, min_words: int) -> DataFrame:
    """By filing year: filings, fetched, long enough, median words, and paired."""
    rows = index.join(lengths.select(F.col("doc").alias("adsh"), F.col("length")), "adsh", "left").join(scored.select("adsh", F.lit(1).alias("paired")), "adsh", "left")
    return rows.groupBy(F.year("filed").alias("year")).agg(
        F.count("*").alias("filings"), F.count("length").alias("fetched"), F.count_if(F.col("length") >= min_words).alias("long_enough"), F.median("length").alias("median_words"), F.count("paired").alias("paired")
    )

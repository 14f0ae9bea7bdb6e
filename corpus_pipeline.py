"""A training corpus from raw documents: rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of documents. ``run``
applies them to the documents of a folder, each written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from ledgerline.llm.queries import TARGETS, tokenizer_path
from ledgerline.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the genetic packing.
ORACLE_SQL = None


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps.

    The ledger's verdict goes back by id and text, so that rows which share an id
    are each judged for themselves; equal rows have equal verdicts.
    """
    source = docs.select(F.struct("doc_id", "lang", "source", "n_chars", "text").alias("row"), "text")
    judged = quality_rules.verdicts(quality_rules.ledger(source, "row", "text"))
    return judged.where("kept").select(*(F.col(f"doc_id.{c}").alias(c) for c in COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; one that loses all its lines goes."""
    rest = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("__n_dropped < __n_lines")
    return rest.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest id, null ids last.

    A row goes by its id, a digest of its text and its other columns, so that rows
    which share an id, or have none, are each judged by their own text; of wholly
    equal rows one stays. Texts without words are near-copies of nothing, and all stay.
    """
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), *others)
    keyed = docs.select(*COLUMNS, key.alias("key"))
    classes = ngram_join.similar_classes(keyed, id_col="key")
    first = classes.where("component_id <=> doc_id").groupBy(F.col("doc_id").alias("key")).agg(F.max("n_shingles").alias("n"))
    kept = keyed.alias("d").join(first.alias("f"), F.col("d.key").eqNullSafe(F.col("f.key"))).select("d.*", "n")
    own = F.when(F.col("n") == 0, F.monotonically_increasing_id())
    return kept.withColumn("own", own).dropDuplicates(["key", "own"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of whole documents whose tokens have the target shares."""
    weighed = docs.withColumns({"n_tokens": mixing.word_count(F.col("text")), "topic": mixing.topic(F.col("text"))})
    return mixing.mix(weighed, TARGETS, "n_tokens").where("sampled").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the training sequences."""
    packed = packing.pack_documents(docs, tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", drop_rejected),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs

"""Tables built part by part: a part is built again only when its stamp changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.tables import exists

_DYNAMIC = {"partitionOverwriteMode": "dynamic"}


def file_stamps(spark: SparkSession, path: str, name: str, salt: str) -> DataFrame:
    """(part, path, stamp) of files: the part is the first group of the pattern ``name`` in the path.

    The stamp changes with a file's length or time of change, or with ``salt`` (the
    hash of what else the build depends on); contents are not read.
    """
    held = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    part = F.regexp_extract("path", name, 1)
    own = F.md5(F.concat_ws("|", part, F.col("length").cast("string"), F.col("modificationTime").cast("string"), F.lit(salt)).cast("binary"))
    return held.select(part.alias("part"), "path", own.alias("stamp")).where("part <> ''")


def refresh(spark: SparkSession, uri: str, wanted: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The table below ``uri`` as ``wanted`` (part, stamp, ...) asks for it, and the rows of ``wanted`` whose parts were built now.

    ``build`` gets those rows and returns their data with a column ``part``. Rows carry
    the stamp that they were built under and only rows under the wanted stamp are
    read, so a part that has become empty, or that is wanted no more, has no rows. A stale
    part's mark is taken away before its rows are written and set again after
    them: what a broken run leaves behind is built again. Other parts are not touched.
    """
    rows_uri, marks_uri = f"{uri}/rows", f"{uri}/marks"
    stale = wanted
    if exists(spark, marks_uri):
        stale = wanted.join(spark.read.schema("stamp string, part string").parquet(marks_uri), ["part", "stamp"], "left_anti").select(*wanted.columns)
    parts = stale.collect()  # one row a part: a file of the input
    now = spark.createDataFrame(parts, wanted.schema)
    if parts:
        marks = now.select("stamp", "part").dropDuplicates(["part"])
        marks.withColumn("stamp", F.lit("")).write.mode("overwrite").options(**_DYNAMIC).partitionBy("part").parquet(marks_uri)
        stamped = build(now).join(F.broadcast(now.select("part", "stamp")), "part")  # as long as the list of stale parts
        stamped.write.mode("overwrite").options(**_DYNAMIC).partitionBy("part").parquet(rows_uri)
        marks.write.mode("overwrite").options(**_DYNAMIC).partitionBy("part").parquet(marks_uri)
    schema = spark.read.parquet(rows_uri).schema if exists(spark, rows_uri) else build(now).withColumn("stamp", F.lit("")).schema
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'part' else f.dataType.simpleString()}" for f in schema)
    held = spark.read.schema(kinds).parquet(rows_uri) if exists(spark, rows_uri) else spark.createDataFrame([], kinds)
    return held.join(wanted.select("part", "stamp"), ["part", "stamp"], "left_semi").drop("stamp"), now

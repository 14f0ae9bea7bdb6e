"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]


def _base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the session is local, a temporary folder for the life of the process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, urlparse(base).path, ignore_errors=True)
    return base.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """The URI of a table or file that a query is about to write; removed at exit."""
    uri = f"{_base(spark)}/tables-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"
    atexit.register(_remove, spark, uri)
    return uri


def _remove(spark: SparkSession, uri: str) -> None:
    """Removes a folder: a mounted one by path, another by the store's own interface while the session lives."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        shutil.rmtree(unquote(parts.path), ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back.

    For tables that several branches of a plan read: they are computed once, the
    plan above stays small (self-joins rewrite all that is below them), and a lost
    executor takes nothing with it.
    """
    uri = new_table(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)

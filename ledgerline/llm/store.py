"""Intermediate tables and model files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """Root of this run's intermediate files, below ``spark.checkpoint.dir``.

    The setting comes from the session. Where it is unset and the session is local
    (tests, a laptop) a temporary folder takes its place for the life of the process.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, local_path(base), ignore_errors=True)
    return f"{base.rstrip('/')}/ledgerline-{_RUN}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI for ``name``; made on first write, removed at exit."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    path = local_path(uri)
    if path:
        os.makedirs(path, exist_ok=True)
    atexit.register(_remove, spark, uri)
    return uri


def _remove(spark: SparkSession, uri: str) -> None:
    """Removes a folder: a mounted one by path, another by the store's own interface while the session lives."""
    path = local_path(uri)
    if path:
        shutil.rmtree(path, ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(uri)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for any other store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    atexit.register(_remove, spark, uri)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def put(uri: str, name: str, data) -> None:
    """Writes one file of bytes below ``uri`` so that a repeated task leaves one whole copy."""
    path = local_path(uri)
    if path:
        os.makedirs(path, exist_ok=True)
        tmp = os.path.join(path, f".{name}.{uuid.uuid4().hex}")
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, os.path.join(path, name))
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(data)


def mapped_file(uri: str, name: str) -> str:
    """A local path of the file ``name`` below ``uri``, fit for memory mapping.

    On a mounted share it is the file itself; from another store the worker
    fetches a copy once and removes it when it ends.
    """
    path = local_path(uri)
    if path:
        return os.path.join(path, name)
    from pyarrow import fs

    own = os.path.join(tempfile.gettempdir(), f"ledgerline-{os.getpid()}", uri.rsplit("/", 1)[-1])
    target = os.path.join(own, name)
    if not os.path.exists(target):
        os.makedirs(own, exist_ok=True)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        store, root = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(f"{root}/{name}") as f, open(target + ".part", "wb") as g:
            shutil.copyfileobj(f, g, 1 << 22)
        os.replace(target + ".part", target)
    return target

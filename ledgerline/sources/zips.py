"""A data source whose partitions are the members of zip files.

The driver reads the directories at the ends of the files, and no content; each
task opens its zip file where it lies, seeks to its member and unpacks it as its lines
are read, so memory holds a batch of lines, however long the member or the file.
"""

from __future__ import annotations

import fnmatch
import re
import zipfile
from collections.abc import Iterator
from io import TextIOWrapper
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "zipmembers"
SCHEMA = "path string, member string, n long, line string"


def _store(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path or URI, the path within it, and what to put before such a path to name it again."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path), "file://" if parts.scheme else ""
    store, path = fs.FileSystem.from_uri(uri)
    return store, path, uri[: uri.index(path)] if path in uri else f"{parts.scheme}://{parts.netloc}/"


def _found(uri: str) -> list[str]:
    """The zip files that a path names: one file, a folder's, or those that a pattern in the last step fits."""
    store, path, before = _store(uri)
    folder, _, pattern = path.rstrip("/").rpartition("/")
    if not re.search(r"[*?\[]", pattern):
        if store.get_file_info(path).type == fs.FileType.File:
            return [uri]
        folder, pattern = path.rstrip("/"), "*.zip"
    held = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(before + f.path for f in held if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


class Member(InputPartition):
    """A member of a zip file; without a path for a reading that finds none."""

    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.member = options["path"], options.get("member", "")
        self.batch_lines, self.encoding = int(options.get("batchlines", 20_000)), options.get("encoding", "latin-1")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in [p for uri in self.path.split("\n") for p in _found(uri)]:
            store, inner, _ = _store(path)
            with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                out += [Member(path, name) for name in sorted(z.namelist()) if not name.endswith("/") and re.search(self.member, name)]
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, inner, _ = _store(partition.path)
        with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            n, lines = 0, []
            for line in TextIOWrapper(raw, self.encoding, newline="\n"):
                lines.append(line.rstrip("\r\n"))
                if len(lines) == self.batch_lines:
                    yield self._batch(partition, n, lines)
                    n, lines = n + len(lines), []
            if lines:
                yield self._batch(partition, n, lines)

    def _batch(self, at: Member, first: int, lines: list[str]) -> pa.RecordBatch:
        k = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([at.path] * k), pa.array([at.name] * k), pa.array(range(first, first + k), pa.int64()), pa.array(lines)], ["path", "member", "n", "line"])


class ZipMembers(DataSource):
    """``spark.read.format("zipmembers")``; options: path (several by line), member (a pattern), batchLines, encoding."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def zip_lines(spark: SparkSession, path: str | list[str], member: str, batch_lines: int = 20_000, encoding: str = "latin-1") -> DataFrame:
    """(path, member, n, line): the lines of the members that a pattern names, of zip files, folders of them or patterns."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format(FORMAT).options(path=path if isinstance(path, str) else "\n".join(path), member=member, batchLines=batch_lines, encoding=encoding).load()


def put_zips(rows: DataFrame, uri: str, headers: dict[str, str]) -> None:
    """Writes a zip file ``<name>.zip`` below ``uri`` for each name of ``rows`` (file, member, n, line), each member under its header.

    The lines of a file are sorted in Spark and written as they come; a repeated task writes the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, _ = _store(uri)
        store.create_dir(root, recursive=True)
        at = out = packed = to = None
        for batch in batches:
            for name, member, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, member) != at:
                    if to:
                        to.close()
                    if at is None or name != at[0]:
                        if packed:
                            packed.close()
                            out.close()
                        out = store.open_output_stream(f"{root}/{name}.zip")
                        packed = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    at, to = (name, member), packed.open(member, "w", force_zip64=True)
                    to.write(f"{headers[member]}\n".encode("latin-1"))
                to.write(f"{line}\n".encode("latin-1"))
        if packed:
            to.close()
            packed.close()
            out.close()
        yield from ()

    rows.repartition("file").sortWithinPartitions("file", "member", "n").select("file", "member", "line").mapInArrow(write, "done long").count()

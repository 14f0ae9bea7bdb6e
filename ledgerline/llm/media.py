"""Media columns: byte payloads kept as lossless WebP files in a binary column, and features read off them.

A payload is the UTF-8 text, padded with bytes 255 to a positive multiple of
``BLOCK``; it becomes a grey image whose rows are ``ROW`` bytes, or ``BLOCK`` bytes
if it is too tall for that. Beyond ``MOST_ROWS`` of these it becomes several
images, in order. Files are read back by the decoder of the whole format.

Edge cases: null or empty text is one block of padding; equal texts give equal
files; repeated rows and null ids are carried along; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import webp
from ledgerline.llm.textkernel import slices

BLOCK, ROW, PAD = 576, 24, 255
#: Bytes of text that are coded side by side, unless one document alone is longer.
GROUP_BYTES = 3 << 20
#: Bytes of files that are read back side by side.
READ_BYTES = 6 << 20
#: Rows of an image of wide rows: about a million samples, as far as back-references reach.
MOST_ROWS = 1820


def images(length: int) -> list[tuple[int, int]]:
    """(samples, row width) of the images of a payload."""
    if length <= ROW * webp.MAX_SIDE:
        return [(length, ROW)]
    most = BLOCK * min(MOST_ROWS, webp.MAX_SIDE)
    return [(min(most, length - at), BLOCK) for at in range(0, length, most)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the files of each text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), GROUP_BYTES // 3):
                n = np.diff(part.offsets)
                padded = np.maximum(-(-n // BLOCK), 1) * BLOCK
                first = np.cumsum(padded) - padded
                samples = np.full(int(padded.sum()), PAD, np.uint8)
                samples[(first - part.offsets[:-1]).repeat(n) + np.arange(len(part.data))] = part.data
                cut = [images(p) for p in padded.tolist()]
                sizes = [s for x in cut for s, _ in x]
                files = webp.encode_many(samples, np.cumsum([0, *sizes]), np.array([w for x in cut for _, w in x]))
                ends = np.cumsum([0] + [len(x) for x in cut]).astype(np.int32)
                media = pa.ListArray.from_arrays(pa.array(ends), pa.array(files, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(n, pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media array<binary>")


def _groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + limit, "right")))
        yield at, to
        at = to


def pixels(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each file, flat."""
    return [p[..., 1].ravel() for p in webp.decode_many(files)]


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: sizes, checksums and a feature of the pixel arrays."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2).to_pylist()
            for a, b in _groups(np.array([sum(map(len, x)) for x in stored], np.int64), READ_BYTES):
                own = stored[a:b]
                flat = pixels([f for x in own for f in x])
                rows, at = [], 0
                for files in own:
                    samples = np.concatenate(flat[at : at + len(files)])
                    at += len(files)
                    payload, held = samples.tobytes(), b"".join(files)
                    counts = np.bincount(samples, minlength=256)
                    feature = f"{len(files)}:{int((counts > 0).sum())}:{int(counts.argmax())}:{1000 * int(samples.sum(dtype=np.int64)) // len(samples)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(held), hashlib.sha256(held).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *cols], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

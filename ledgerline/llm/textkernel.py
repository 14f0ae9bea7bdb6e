"""Vectorised words, lines and hashes over Arrow string columns.

Everything here works on the UTF-8 buffer of a batch, in slices of bounded size,
so a worker's memory follows the slice and not the batch. Hashes are 64-bit and
the same in every process: a polynomial over byte values drawn from a fixed
splitmix sequence, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless one document alone is longer.
SLICE_BYTES = 1 << 20

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_P = U(0x5851F42D4C957F2B)  # odd, 3 mod 8
_Q = U(0xD1342543DE82EF93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
    TABLE_LOWER = TABLE[LOWER]
    _SIZE = 1 << 16
    _POW = np.cumprod(np.concatenate([[U(1)], np.full(_SIZE - 1, _P)]), dtype=np.uint64)
    _INVERSE = U(pow(int(_P), -1, 1 << 64))
    _INV = np.cumprod(np.concatenate([[U(1)], np.full(_SIZE - 1, _INVERSE)]), dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    while len(_POW) < n:
        with np.errstate(over="ignore"):
            k = len(_POW)
            _POW = np.concatenate([_POW, _POW * (_POW[-1] * _P)])
            _INV = np.concatenate([_INV, _INV * (_INV[-1] * _INVERSE)])
            assert len(_POW) == 2 * k
    return _POW[:n], _INV


class Slice:
    """Some consecutive documents of a batch: their bytes, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[self.offsets])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document of each of some ascending byte positions."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.offsets)))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each maximal run without ASCII white space, documents apart."""
        solid = ~SPACE[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[True], ~solid[:-1]]) | edge[:-1]
        after = np.concatenate([~solid[1:], [True]]) | edge[1:]
        return np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each \\n-separated line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        docs = np.concatenate([np.arange(self.n), self.doc_of(breaks)])
        by = np.lexsort((starts, docs))
        starts, docs = starts[by], docs[by]
        ends = ends[np.lexsort((ends, np.concatenate([np.arange(self.n), self.doc_of(breaks)])))]
        return starts, ends, docs

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hashes of byte ranges, A-Z lower-cased if asked."""
        with np.errstate(over="ignore"):
            power, inverse = _powers(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((TABLE_LOWER if lower else TABLE)[self.data] * power[:-1], out=total[1:])
            return mix((total[ends] - total[starts]) * inverse[starts] + _GOLD)


def texts(column: pa.Array) -> pa.Array:
    """The column as strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of whole documents that together are the column; null text counts as empty."""
    column = texts(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each run of k words inside one document."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = out * _Q + words[j : n + j]
        inside = np.flatnonzero(docs[:n] == docs[k - 1 :])
        return mix(out[inside] + U(k) * _GOLD), inside


def within_docs(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys that are equal only if the documents are equal too."""
    with np.errstate(over="ignore"):
        return mix(keys ^ mix((docs.astype(np.uint64) + U(1)) * _GOLD))


def shingle_sets(part: Slice, k: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct k-word shingle hashes; the whole sequence as one if it is shorter."""
    starts, ends = part.words()
    docs = part.doc_of(starts)
    words = part.hashes(starts, ends, lower=True)
    hashes, at = windows(words, docs, k)
    counts = np.bincount(docs, minlength=part.n)
    first = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.searchsorted(at, first)
    for i in range(part.n):
        if counts[i] >= k:
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])
        elif counts[i]:
            own = words[first[i] : first[i + 1]]
            yield windows(own, np.zeros(len(own), int), len(own))[0]
        else:
            yield np.zeros(0, np.uint64)

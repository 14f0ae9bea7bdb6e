"""Interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays.

Counting takes two passes in Spark, each with counts combined in the tasks before
they are dealt by hash range: words, which fixes the vocabulary and gives each
word a dense number (its rank among the sorted hashes); then pairs of numbers,
mixed by a bijection to uniform 64-bit keys, so that pairs of a frequent word
spread over all ranges. Each range becomes files of sorted arrays in the shared
folder; workers map them and look up sorted batches of keys. Continuation and
follower counts go the same way, by ranges of word numbers.

A text is its lower-cased (A-Z) words and one end token, after a start mark that
is context only. p(w|v) = (c(vw) - D(c(vw)))/c(v) + g(v) p(w) with three discounts
from counts of counts, p(w) the same over continuation counts, and 1/(V+1) at the
end, where the +1 is the unknown word.

Edge cases: null or empty text is the end token alone; with nothing to learn from
every token has probability 1/(V+1) = 1; unknown words as context give the
unigram; discounts whose counts of counts are missing fall back to 0.5, 1, 1.5;
repeated rows count as often as they occur; null ids are scored, and learned from
as the caller says; other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.store import mapped_file, new_dir, put, written
from ledgerline.llm.textkernel import Slice, U, mix, slices

#: Bytes of text for each range of keys, and entries that a task combines before it hands them on.
SHARD_BYTES = 32 << 20
HOLD = 2_000_000
END = U(0x0E4D_0E4D_0E4D_0E4D)  # hash that stands for the end token


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's tokens, each text's end included, and where each text's begin."""
    starts, ends = part.words()
    n = np.bincount(part.doc_of(starts), minlength=part.n)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(bounds[-1], np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[bounds[1:] - 1] = True
    out[is_end], out[~is_end] = END, part.hashes(starts, ends, lower=True)
    return out, bounds


def _combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _by_range(keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys cut into ranges of the 64-bit space: keys seen once, the others, and their counts."""
    cuts = np.searchsorted(keys, _lower_bounds(shards))
    rows = []
    for s, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
        if a < b:
            once = counts[a:b] == 1
            rows.append((s, keys[a:b][once].tobytes(), keys[a:b][~once].tobytes(), counts[a:b][~once].astype(np.uint64).tobytes()))
    if rows:
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "once", "more", "times"])


_RANGE_FORM = "shard int, once binary, more binary, times binary"


def _lower_bounds(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(shards)], np.uint64)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    def read(name: str) -> np.ndarray:
        return np.frombuffer(b"".join(table[name].to_pylist()), np.uint64)

    once, more, times = read("once"), read("more"), read("times")
    return _combine(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.uint64), times]))


class _Held:
    """Key counts of a task, handed on when there are many."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.n = shards, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts.astype(np.uint64)))
        self.n += len(found)
        if self.n > HOLD:
            both = _combine(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.n = [both], len(both[0])
            if self.n > HOLD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from _by_range(*_combine(*(np.concatenate(x) for x in zip(*self.parts, strict=True))), self.shards)
        self.parts, self.n = [], 0


class Arrays:
    """Sorted 64-bit keys in range files, mapped when first used."""

    def __init__(self, uri: str, name: str, shards: int, sizes: list[int]):
        self.uri, self.name, self.low = uri, name, _lower_bounds(shards)
        self.sizes, self.first = sizes, np.cumsum([0, *sizes])
        self.maps: dict[int, np.ndarray] = {}

    def _map(self, s: int) -> np.ndarray:
        if s not in self.maps:
            self.maps[s] = np.memmap(mapped_file(self.uri, f"{self.name}-{s}"), np.uint64, "r") if self.sizes[s] else np.zeros(0, np.uint64)
        return self.maps[s]

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank over all ranges of each of some sorted keys; -1 if it is not there."""
        out = np.full(len(keys), -1, np.int64)
        cuts = [*np.searchsorted(keys, self.low), len(keys)]
        for s in range(len(self.low)):
            a, b = cuts[s], cuts[s + 1]
            own = self._map(s) if a < b else ()
            if len(own):
                at = np.searchsorted(own, keys[a:b])
                at[at == len(own)] = 0
                out[a:b] = np.where(own[at] == keys[a:b], at + self.first[s], -1)
        return out


class Values:
    """Fixed-width values by rank in range files, mapped when first used."""

    def __init__(self, uri: str, name: str, sizes: list[int], width: int = 1):
        self.uri, self.name, self.sizes, self.width = uri, name, sizes, width
        self.first = np.cumsum([0, *sizes])
        self.maps: dict[int, np.ndarray] = {}

    def __call__(self, ranks: np.ndarray) -> np.ndarray:
        """Rows at some ranks; zeros where the rank is -1."""
        out = np.zeros((len(ranks), self.width), np.uint64)
        of = np.searchsorted(self.first, ranks, "right") - 1
        for s in np.unique(of[ranks >= 0]).tolist():
            if s not in self.maps:
                self.maps[s] = np.memmap(mapped_file(self.uri, f"{self.name}-{s}"), np.uint64, "r").reshape(-1, self.width)
            own = (of == s) & (ranks >= 0)
            out[own] = self.maps[s][ranks[own] - self.first[s]]
        return out


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One-to-one 64-bit keys of pairs of word numbers below 2^32."""
    with np.errstate(over="ignore"):
        return mix(before.astype(np.uint64) << U(32) | after.astype(np.uint64))


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(31)) ^ (x >> U(62))
        x = x * U(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = x ^ (x >> U(27)) ^ (x >> U(54))
        x = x * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return x ^ (x >> U(30)) ^ (x >> U(60))


def discounts(t: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    if min(t) <= 0:
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    raw = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
    return [min(max(d, 0.01), k) for d, k in zip(raw, (1, 2, 3), strict=True)]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    uri: str
    shards: int
    word_sizes: list[int]
    pair_sizes: list[int]
    word_shards: int
    n_tokens: int
    n_docs: int
    n_pairs: int
    pair_discounts: list[float]
    word_discounts: list[float]
    word_mass: float  # share of the continuation mass that discounts set free

    @property
    def n_words(self) -> int:
        return sum(self.word_sizes)


def _stage(docs: DataFrame, shards: int, keys) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(shards)
        for batch in batches:
            for part in slices(batch.column(0)):
                yield from held.add(keys(part))
        yield from held.flush()

    return docs.mapInArrow(run, _RANGE_FORM)


def _numbers(words: Arrays, part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a slice's tokens (-1: unknown), and where each text's begin."""
    own, bounds = tokens(part)
    distinct, inverse = np.unique(own, return_inverse=True)
    return words.rank(distinct)[inverse], bounds


def _pairs(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; ``start`` at the head of a text."""
    before = np.concatenate([[start], ids[:-1]])
    before[bounds[:-1]] = start
    return before


def _word_ranges(n_words: int, shards: int) -> np.ndarray:
    """First word number of each range, and the end; the start mark is the last number."""
    return np.array([(n_words + 1) * s // shards for s in range(shards + 1)], np.int64)


def train(docs: DataFrame, learn: Column, text_col: str = "text") -> Model:
    """Counts all documents for which ``learn`` holds; the arrays grow with the corpus."""
    spark = docs.sparkSession
    source = docs.where(learn).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(4, math.ceil(size["bytes"] / SHARD_BYTES))
    uri = new_dir(spark, "kneser-ney")

    def save_words(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, counts = _merge(table)
        put(uri, f"word-{s}", keys.tobytes())
        put(uri, f"count-{s}", counts.tobytes())
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    words = _stage(source, shards, lambda part: tokens(part)[0]).groupBy("shard").applyInArrow(save_words, "shard int, n long, total long").collect()
    word_sizes = [0] * shards
    for r in words:
        word_sizes[r["shard"]] = r["n"]
    n_words, n_tokens = sum(word_sizes), sum(r["total"] for r in words)
    if n_words >= 1 << 32:
        raise ValueError(f"{n_words} distinct words; pair keys hold 2^32")

    vocabulary = Arrays(uri, "word", shards, word_sizes)
    ranges = _word_ranges(n_words, shards)

    def pair_keys_of(part: Slice) -> np.ndarray:
        ids, bounds = _numbers(vocabulary, part)
        return pair_keys(_pairs(ids, bounds, n_words), ids)

    def save_pairs(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, counts = _merge(table)
        put(uri, f"pair-{s}", keys.tobytes())
        put(uri, f"times-{s}", counts.tobytes())
        plain = _unmix(keys)
        before, after = (plain >> U(32)).astype(np.int64), (plain & U(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(counts, U(3)).astype(np.int64)
        # by word number: followers seen once, twice, more often; distinct words before it
        ids, inverse = np.unique(np.concatenate([before, after]), return_inverse=True)
        column = np.concatenate([kind - 1, np.full(len(after), 3)])
        sums = np.bincount(inverse * 4 + column, minlength=len(ids) * 4).reshape(-1, 4).astype(np.uint32)
        cuts = np.searchsorted(ids, ranges)
        rows = [(w, ids[a:b].astype(np.uint32).tobytes(), sums[a:b].tobytes()) for w, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        of = [int((counts == U(k)).sum()) for k in (1, 2, 3, 4)]
        m = len(rows)
        return pa.table({
            "shard": pa.array([s] * m, pa.int32()), "n": pa.array([len(keys)] + [0] * (m - 1), pa.int64()), "t": pa.array([of] + [[0] * 4] * (m - 1), pa.list_(pa.int64())),
            "range": pa.array([r[0] for r in rows], pa.int32()), "ids": pa.array([r[1] for r in rows], pa.binary()), "sums": pa.array([r[2] for r in rows], pa.binary()),
        })

    form = "shard int, n long, t array<long>, range int, ids binary, sums binary"
    partial = written(_stage(source, shards, pair_keys_of).groupBy("shard").applyInArrow(save_pairs, form), "pair-sums")
    pair_sizes, pair_t = [0] * shards, [0] * 4
    for r in partial.where("n > 0").select("shard", "n", "t").collect():
        pair_sizes[r["shard"]] = r["n"]
        pair_t = [x + y for x, y in zip(pair_t, r["t"], strict=True)]

    def save_sums(key: tuple, table: pa.Table) -> pa.Table:
        w = key[0].as_py()
        low, high = ranges[w], ranges[w + 1]
        out = np.zeros((high - low, 4), np.uint64)
        for ids, sums in zip(table["ids"].to_pylist(), table["sums"].to_pylist(), strict=True):
            out[np.frombuffer(ids, np.uint32).astype(np.int64) - low] += np.frombuffer(sums, np.uint32).reshape(-1, 4)
        put(uri, f"sums-{w}", out.tobytes())
        cont = out[:, 3]
        return pa.table({"t": pa.array([[int((cont == U(k)).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())), "more": pa.array([int((cont >= U(3)).sum())], pa.int64())})

    sums = partial.groupBy("range").applyInArrow(save_sums, "t array<long>, more long").collect()
    word_t = [sum(r["t"][k] for r in sums) for k in range(4)]
    n_pairs, d = sum(pair_sizes), discounts(word_t)
    freed = d[0] * word_t[0] + d[1] * word_t[1] + d[2] * sum(r["more"] for r in sums)
    model = Model(uri, shards, word_sizes, pair_sizes, shards, n_tokens, size["n"], n_pairs, discounts(pair_t), d, freed / n_pairs if n_pairs else 1.0)
    put(uri, "model.json", json.dumps(model.__dict__).encode())
    return model


class Scorer:
    """A worker's view of a model."""

    def __init__(self, m: Model):
        self.m = m
        self.words = Arrays(m.uri, "word", m.shards, m.word_sizes)
        self.counts = Values(m.uri, "count", m.word_sizes)
        self.pairs = Arrays(m.uri, "pair", m.shards, m.pair_sizes)
        self.times = Values(m.uri, "times", m.pair_sizes)
        self.sums = Values(m.uri, "sums", np.diff(_word_ranges(m.n_words, m.word_shards)).tolist(), 4)

    @staticmethod
    def _cut(counts: np.ndarray, d: list[float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(counts, U(3)).astype(np.int64)]

    def score(self, part: Slice) -> dict[str, np.ndarray]:
        m = self.m
        own, bounds = tokens(part)
        distinct, inverse = np.unique(own, return_inverse=True)
        rank = self.words.rank(distinct)
        count = self.counts(rank)[:, 0].astype(float)
        sums = self.sums(rank).astype(float)
        cont = sums[:, 3]
        unigram = m.word_mass / (m.n_words + 1) + np.maximum(cont - self._cut(cont.astype(np.uint64), m.word_discounts), 0) / max(1, m.n_pairs)
        free = np.where(count > 0, sums[:, :3] @ np.array(m.pair_discounts) / np.maximum(count, 1), 1.0)
        start = self.sums(np.array([m.n_words]))[0].astype(float) if m.n_pairs else np.zeros(4)
        start_free = start[:3] @ np.array(m.pair_discounts) / m.n_docs if m.n_docs else 1.0

        head = np.zeros(len(own), bool)
        head[bounds[:-1]] = True
        ids = rank[inverse]
        before = _pairs(ids, bounds, m.n_words)
        total = np.concatenate([[0.0], count[inverse][:-1]])
        left = np.concatenate([[1.0], free[inverse][:-1]])
        total[head], left[head] = m.n_docs, start_free
        known = (ids >= 0) & (before >= 0)
        keys, at = np.unique(pair_keys(before[known], ids[known]), return_inverse=True)
        seen = np.zeros(len(own), np.uint64)
        seen[known] = self.times(self.pairs.rank(keys))[:, 0][at]
        direct = np.maximum(seen.astype(float) - self._cut(seen, m.pair_discounts), 0) / np.maximum(total, 1)
        p = np.log10(direct + left * unigram[inverse])
        base = np.log10((count + 1) / (m.n_tokens + m.n_words + 1))[inverse]
        first = bounds[:-1]
        return {
            "n_tokens": np.diff(bounds),
            "n_known": np.add.reduceat((count > 0)[inverse].astype(np.int64), first),
            "base_score": np.add.reduceat(base, first),
            "score": np.add.reduceat(p, first),
        }


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of every whole text; scores are log10."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch.column(1)):
                out = scorer.score(part)
                perplexity = 10 ** np.minimum(-out["score"] / out["n_tokens"], 300)
                ids = batch.column(0).slice(part.first, part.n)
                names = ["n_tokens", "n_known", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[k]) for k in names), pa.array(perplexity)], ["doc_id", *names, "perplexity"])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")

"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j | x) = sigmoid(threshold_j - w.x): one set of hashed-text weights for
all grades and ordered thresholds. Features are the distinct lower-cased letter
runs of the whole text and their first 4 and 6 bytes, the distinct runs of other visible characters, and the
share of capitals in eight steps, each hashed into 2^20 weights. The model is
fitted on at most ``MAX_RATED`` rated documents, chosen by hash of the id (a
documented bound); every document is scored on its whole text.

Edge cases: null or empty text has only the bias features and gets the grade of
the thresholds; documents without a rating are scored, not learned from; if one
id has several ratings each counts; without any rating every document gets the
middle of the scale; ties at a cut are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.textkernel import SPACE, U, slices

BITS = 20
#: Rated documents that the fit takes at most.
MAX_RATED = 24_000
#: Leading bytes of longer letter runs that are features too.
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE, DECAY, SCREEN = 60, 64, 1.0, 1e-5, 4.5

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letter, 2 other
_KIND[SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(part) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all documents of a slice in a row, and where each document's begin."""
    kind = _KIND[part.data]
    edge = np.zeros(len(kind) + 1, bool)
    edge[part.offsets] = True
    turn = np.flatnonzero(edge[:-1] | np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    ends = np.concatenate([turn[1:], [len(kind)]]) if len(turn) else turn
    solid = kind[turn] > 0
    starts, ends = turn[solid], ends[solid]
    docs = part.doc_of(starts)
    letter = kind[starts] == 1
    runs = [(starts, ends, docs)]
    for k in PREFIXES:
        more = letter & (ends - starts > k)
        runs.append((starts[more], starts[more] + k, docs[more]))
    docs = np.concatenate([r[2] for r in runs])
    hashes = np.concatenate([part.hashes(s, e, lower=True) + U(i * 0x9E3779B97F4A7C15 % (1 << 64)) for i, (s, e, _) in enumerate(runs)])
    hashes = (hashes >> U(64 - BITS)).astype(np.int64)
    letters = part.per_doc(((part.data | 32) >= 97) & ((part.data | 32) <= 122))
    capitals = part.per_doc((part.data >= 65) & (part.data <= 90))
    step = np.where(letters > 0, 8 * capitals // np.maximum(letters, 1), 9)
    keys = np.unique(np.concatenate([docs << BITS | hashes, np.arange(part.n) << BITS | step]))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(part.n + 1) << BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights and ordered thresholds, the latter as a first one and positive gaps."""

    def __init__(self, grades: int):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.thresholds = np.arange(grades - 1, dtype=float) - (grades - 2) / 2

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        return _sigmoid(score[:, None] - self.thresholds)


def _pull(score: np.ndarray, y: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of each row's log-likelihood in its score, in the threshold below its grade, and in the one above."""
    above = np.concatenate([np.ones((len(y), 1)), model.tails(score), np.zeros((len(y), 1))], axis=1)
    upper, lower = above[np.arange(len(y)), y], above[np.arange(len(y)), y + 1]
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    return du - dl, du, dl


def fit(flat: np.ndarray, bounds: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """AdaGrad on the ordinal log-likelihood, over the features that a score test singles out.

    Under a model without weights a feature's summed pull has mean 0; those within
    ``SCREEN`` standard deviations of it stay 0, so that rare words of a single
    document are not learned by heart.
    """
    model, dice = Model(n_grades), np.random.default_rng(seed)
    if not len(grades):
        return model
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
    share = np.clip(share, 0.5 / len(grades), 1 - 0.5 / len(grades))
    model.thresholds = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    doc = np.repeat(np.arange(len(grades)), np.diff(bounds))
    pull, _, _ = _pull(np.zeros(len(grades)), grades, model)
    often, summed = np.bincount(flat, minlength=1 << BITS), np.bincount(flat, weights=pull[doc], minlength=1 << BITS)
    chosen = np.abs(summed) > SCREEN * np.sqrt(np.maximum(often, 3) * max(pull.var(), 1e-12))
    names, keep = np.flatnonzero(chosen), chosen[flat]
    flat, doc = np.searchsorted(names, flat[keep]), doc[keep]
    bounds = np.searchsorted(doc, np.arange(len(grades) + 1))
    weights, squares, t_squares = np.zeros(len(names)), np.full(len(names), 1e-2), np.full(n_grades - 1, 1.0)
    for _ in range(epochs):
        order = dice.permutation(len(grades))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            size = bounds[own + 1] - bounds[own]
            row = np.repeat(np.arange(len(own)), size)
            idx = flat[np.repeat(bounds[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            y = grades[own]
            pull, below, above = _pull(np.bincount(row, weights=weights[idx], minlength=len(own)), y, model)
            grad = DECAY * weights - np.bincount(idx, weights=pull[row], minlength=len(names)) / len(own)
            squares += grad**2
            weights -= RATE * grad / np.sqrt(squares)
            gt = np.bincount(y, weights=below, minlength=n_grades)[1:] - np.bincount(y, weights=above, minlength=n_grades)[:-1]
            gt /= len(own)
            t_squares += gt**2
            model.thresholds = np.maximum.accumulate(model.thresholds - 0.1 * gt / np.sqrt(t_squares) + 1e-6 * np.arange(n_grades - 1))
    model.weights[names] = weights
    return model


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rated: int = MAX_RATED) -> Model:
    """Fits on (doc_id, text) and (doc_id, grade); at most ``max_rated`` ratings, the first by hash of the id."""
    chosen = ratings.where("grade is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rated)
    rated = docs.join(F.broadcast(chosen), "doc_id").select("grade", "text")  # bounded by max_rated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                flat, bounds = features(part)
                grades = batch.column(0).slice(part.first, part.n).cast(pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([grades, lists], ["grade", "features"])

    table = rated.mapInArrow(run, "grade int, features array<int>").toArrow()
    if not table.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), n_grades)
    lists = table["features"].combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    # rows come in any order; sort by content so that a fit can be repeated
    flat, grades = lists.values.to_numpy().astype(np.int64), table["grade"].to_numpy().astype(np.int64)
    size = np.diff(bounds)
    sums = np.add.reduceat(np.concatenate([flat, [0]]), bounds[:-1]) if len(flat) else size
    order = np.lexsort((sums, size, grades))
    moved = np.repeat(bounds[:-1][order] - np.cumsum(size[order]) + size[order], size[order]) + np.arange(len(flat))
    return fit(flat[moved], np.concatenate([[0], np.cumsum(size[order])]), grades[order], n_grades)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_above): the expected grade and P(grade > j) for each j."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 4 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        own = Model(len(thresholds) + 1)
        own.weights, own.thresholds = weights, thresholds
        for batch in batches:
            for part in slices(batch.column(1)):
                flat, bounds = features(part)
                total = np.concatenate([[0], np.cumsum(weights[flat], dtype=float)])
                tails = own.tails(total[bounds[1:]] - total[bounds[:-1]])
                ids = batch.column(0).slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(tails.sum(axis=1)), pa.array(list(tails))], ["doc_id", "expected_grade", "p_above"])

    return source.mapInArrow(run, f"doc_id {kind}, expected_grade double, p_above array<double>")

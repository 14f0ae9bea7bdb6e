"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to order 3 with symbol counts.
Statistics are frozen after training: a symbol is coded in the longest context
that has seen it, escapes (method C) lead to shorter contexts, symbols of the
longer ones are excluded, and the last resort is uniform over the bytes left. The
code length of a byte then depends on three bytes before it only, so all lengths
of a language are worked out once, for each of its contexts and symbols, and a
text's length is a sum of table entries. The shortest code wins.

A language's tree has all contexts of its sample; its table is built in a task of
its own, written to the shared folder and memory-mapped by the workers, so nothing
that grows with the number of languages passes the driver. At most ``MAX_DOCS``
documents a language are learned from, the first by hash of the id (a documented
bound on labelled rows). Whole texts are read, in learning and in prediction.

Edge cases: null text, or text without a letter, is ``und`` with score 0; empty
tables give empty results; without any learned language all is ``und``; equal code
lengths go to the first language in alphabetical order; repeated rows get equal
results; rows with a null id are predicted but not learned from; of an id that
several texts share each text is learned from; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.store import mapped_file, new_dir, put, written
from ledgerline.llm.textkernel import slices

ORDER = 3
MAX_DOCS = 400
#: Chosen ids up to this many (a few MB) are broadcast, so that no text is shuffled to learn from a bounded sample.
MAX_CHOSEN = 1 << 17
#: First bits of the hashes by which a language's documents are counted before they are ranked.
BITS = 12
START = 256  # stands before every text; context only
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _before(part, symbols: np.ndarray, start: int) -> list[np.ndarray]:
    """The symbols ORDER, ..., 1 places before each byte; ``start`` before a text's first."""
    at = np.arange(len(symbols)) - np.repeat(part.offsets[:-1], np.diff(part.offsets))
    out = []
    for k in range(ORDER, 0, -1):
        moved = np.concatenate([np.full(k, start, symbols.dtype), symbols[: len(symbols) - k]])[: len(symbols)]
        out.append(np.where(at >= k, moved, start))
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) from (lang, text): grams of ORDER context bytes and the byte after them, in base 257."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                langs, own = np.unique(np.array(batch.column(0).slice(part.first, part.n).to_pylist(), object), return_inverse=True)
                symbols = part.data.astype(np.int64)
                gram = np.zeros(len(symbols), np.int64)
                for c in [*_before(part, symbols, START), symbols]:
                    gram = gram * 257 + c
                lang = np.repeat(own, np.diff(part.offsets))
                keys, n = np.unique(lang * 257 ** (ORDER + 1) + gram, return_counts=True)
                which, gram = np.divmod(keys, 257 ** (ORDER + 1))
                yield pa.RecordBatch.from_arrays([pa.array(langs[which], pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Code lengths in bits of every symbol after every context of one language.

    ``classes`` numbers the bytes that the language has: 0 is a byte never seen,
    the last one the start mark. A row of ``table`` is a context, its shorter ones
    before it; ``node`` gives the row of the deepest context that ends in some classes.
    """

    def __init__(self, classes: np.ndarray, node: np.ndarray, table: np.ndarray):
        self.classes, self.node, self.table = classes, node, table
        self.size = int(classes[START]) + 1

    @staticmethod
    def of(gram: np.ndarray, n: np.ndarray) -> Tree:
        parts = []
        rest = gram
        for _ in range(ORDER + 1):
            parts.append(rest % 257)
            rest = rest // 257
        symbol, *back = parts  # back: nearest byte first
        seen = np.unique(symbol)
        classes = np.zeros(257, np.int64)
        classes[seen] = np.arange(1, len(seen) + 1)
        a = len(seen) + 2
        classes[START] = a - 1
        symbol, back = classes[symbol], [classes[b] for b in back]
        codes = [np.zeros(len(gram), np.int64)]
        for k in range(ORDER):
            codes.append(codes[-1] + back[k] * a**k)  # a context's code: its k nearest classes
        nodes = [np.unique(c) for c in codes]
        first = np.cumsum([0] + [len(x) for x in nodes])
        table = np.zeros((first[-1], a), np.float32)
        for depth, all_ in enumerate(nodes):
            for at in range(0, len(all_), 4096):
                some = all_[at : at + 4096]
                table[first[depth] + at :][: len(some)] = _lengths(some, depth, codes, symbol, n, a)
        node = np.zeros(a**ORDER, np.int32)
        every = np.arange(a**ORDER)
        for k in range(1, ORDER + 1):
            short = np.full(a**k, -1, np.int64)
            short[nodes[k]] = first[k] + np.arange(len(nodes[k]))
            found = short[every % a**k]
            node = np.where(found >= 0, found, node).astype(np.int32)
        return Tree(classes, node, table.ravel())

    def lengths(self, part) -> np.ndarray:
        """Bits of each document of a slice."""
        out = np.zeros(part.n)
        full = np.diff(part.offsets) > 0
        if full.any():
            symbols = self.classes[:256].astype(np.int32)[part.data]
            code = np.zeros(len(symbols), np.int32)
            for c in _before(part, symbols, self.size - 1):
                code *= np.int32(self.size)
                code += c
            cells = self.node[code].astype(np.int64)
            cells *= self.size
            cells += symbols
            out[full] = np.add.reduceat(self.table[cells], part.offsets[:-1][full], dtype=float)
        return out


def _counts(want: np.ndarray, code: np.ndarray, symbol: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Symbol counts of the wanted context codes."""
    known, inv = np.unique(want, return_inverse=True)
    at = np.searchsorted(known, code)
    at[at == len(known)] = 0
    hit = known[at] == code
    flat = np.bincount(at[hit] * size + symbol[hit], weights=n[hit], minlength=len(known) * size)
    return flat.reshape(len(known), size)[inv]


def _lengths(some: np.ndarray, depth: int, codes: list[np.ndarray], symbol: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Code lengths of every symbol in some contexts of one depth."""
    p = np.zeros((len(some), size))
    escape = np.ones((len(some), 1))
    out = np.zeros(p.shape, bool)
    for k in range(depth, -1, -1):
        counts = _counts(some % size**k, codes[k], symbol, n, size)
        left = np.where(out, 0, counts)
        total, kinds = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        p = np.where(left > 0, escape * left / whole, p)
        escape = np.where(total > 0, escape * kinds / whole, escape)
        out |= counts > 0
    rest = np.maximum(256 - out.sum(axis=1, keepdims=True), 1)
    return -np.log2(np.where(out, p, escape / rest))


@dataclass
class Coder:
    """The learned languages in alphabetical order, and where their trees are."""

    uri: str
    langs: list[str]

    def trees(self) -> Iterator[Tree]:
        for i in range(len(self.langs)):
            kinds = (("classes", np.int64), ("node", np.int32), ("table", np.float32))
            yield Tree(*(np.memmap(mapped_file(self.uri, f"{i}-{name}"), kind, "r") for name, kind in kinds))


def _no_letter(part) -> np.ndarray:
    none = part.per_doc(_ASCII_LETTER[part.data]) == 0
    for i in np.flatnonzero(none & (part.per_doc(part.data >= 128) > 0)):
        text = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        none[i] = not any(c.isalpha() for c in text)
    return none


def _first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct (doc_id, lang) of each language, those of the least hashes.

    Counts by the hashes' first bits tell how far the ranking has to look, so it
    reads little more than ``most`` rows of a language, however many it has.
    """
    hashed = ids.withColumn("hash", F.xxhash64("doc_id")).withColumn("first_bits", F.call_function("shiftright", F.col("hash"), F.lit(64 - BITS)))
    counts = hashed.groupBy("lang", "first_bits").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("lang").orderBy("first_bits").rowsBetween(Window.unboundedPreceding, -1))
    wanted = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).where(F.col("earlier") < most).select("lang", "first_bits")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    return hashed.join(wanted, ["lang", "first_bits"]).withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "lang")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Coder:
    """A coder from the documents for which ``learn`` holds and id, lang and text are not null."""
    usable = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    chosen = written(_first_by_hash(written(named.select("doc_id", "lang").distinct(), "ids"), max_docs), "chosen")
    side = F.broadcast(chosen) if chosen.count() <= MAX_CHOSEN else chosen  # then the texts stay where they are read
    grams = written(gram_counts(named.join(side, ["doc_id", "lang"])), "grams")
    uri = new_dir(docs.sparkSession, "language-id")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(langs)}

    def build(key: tuple, table: pa.Table) -> pa.Table:
        i = number[key[0].as_py()]
        table = table.sort_by("gram")
        tree = Tree.of(table["gram"].to_numpy(), table["n"].to_numpy())
        for name in ("classes", "node", "table"):
            put(uri, f"{i}-{name}", getattr(tree, name).tobytes())
        return pa.table({"contexts": pa.array([len(tree.table) // tree.size], pa.int64())})

    grams.groupBy("lang").applyInArrow(build, "contexts long").collect()
    return Coder(uri, langs)


def predict(docs: DataFrame, coder: Coder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of the shortest code and its share of 2^-length."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = list(coder.trees())
        names_of = np.array([*coder.langs, "und"], object)
        for batch in batches:
            for part in slices(batch.column(1)):
                und = _no_letter(part)
                best, score = np.full(part.n, len(trees)), np.zeros(part.n)
                if trees:
                    bits = np.stack([t.lengths(part) for t in trees], axis=1)
                    best = bits.argmin(axis=1)
                    score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                names = names_of[best]
                names[und], score[und] = "und", 0.0
                ids = batch.column(0).slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")

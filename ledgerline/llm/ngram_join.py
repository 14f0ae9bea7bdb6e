"""N-gram Jaccard join: an exact prefix filter, and count-vector R-trees in its buckets.

A document is its set of distinct k-word shingles. Shingles are hashed into
``GROUPS`` groups; a document's group counts are a point. Two sets share at most
the sum of the coordinate minima of their points, so a tree node whose summed
minima with a query fall short of the overlap that the threshold asks for holds
no partner, and is skipped. Pairs that survive are verified on the sets.

One tree over all documents would meet a fixed part of all unrelated documents of
like size, so candidates come from a prefix filter on whole shingle hashes. Order
the shingles from rare to common; a set of n that shares none of its first
n - ceil(tn) + 1 shares fewer than tn at all, so it is enough to look where two
documents meet on one of these. The order takes corpus counts of 2^21 fine groups
(a table of fixed size), which sends common passages to the end. Any order loses
nothing. Small buckets compare all pairs; trees work in larger ones.

Steps: (1) collapse documents with equal sets; (2) list the leading shingles of
each class and keep those that two classes hold; classes that hold the same one
meet in parts first, and a part with more than ``RUN`` of them is linked to one of
its own, which alone goes on, so no task gets a whole hot shingle; what meets such
a one is linked to it without a bound, as those it stands for may be near; (3) in each
bucket that is left, a tree finds the pairs that the bound allows; where sets are
large, what it puts together must pass trees over finer points; of large buckets a
spanning forest is kept; (4) the connected parts are gathered in chunks of about
``CHUNK`` classes, and a tree with exact verification finds their true links. The
leaders of the clusters of all chunks are chunked and verified again, as long as
that makes them fewer; only where a part is still in pieces, blocks of ``BLOCK``
classes meet in pairs.

Edge cases: null or empty text, or text without words, is an empty set and links
with nothing; fewer than k words are one shingle; repeated rows are copies; null
ids are kept and never become a component's id unless all of it is null; rows that
share an id are each taken by their own text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.store import written
from ledgerline.llm.textkernel import shingle_sets, slices

#: Groups of the points that travel to the buckets; sets above FINE_FROM have finer points too, for pairs that pass.
GROUPS, FINE_FROM, MOST_GROUPS = 64, 400, 1 << 16
#: Sets above this size are never ruled out by their 16-bit points.
UNBOUNDED = 2_000_000
FINE_BITS = 21
FINE_PARTS = 32
LEAF = 32
FAN = 8
CHUNK, BLOCK = 256, 2048
RUN = 1024
SMALL_BUCKET = 12


def _fine(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count_vector(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point of a set: how many of its shingles fall in each group."""
    of = ((hashes >> np.uint64(8)) & np.uint64(groups - 1)).astype(np.int64)
    return np.minimum(np.bincount(of, minlength=groups), 65535).astype(np.uint16)


def fine_groups(n: int) -> int:
    """Groups that tell sets of n apart: a few shingles in each."""
    return min(MOST_GROUPS, max(GROUPS, 1 << (n // 4).bit_length()))


def fine_point(hashes: np.ndarray) -> bytes | None:
    """The finer point of a large set: a byte a group, two where a count does not fit in one; None if the set is small."""
    if len(hashes) <= FINE_FROM:
        return None
    point = count_vector(hashes, fine_groups(len(hashes)))
    return (point.astype(np.uint8) if point.max() < 256 else point).tobytes()


def _fine_counts(point: bytes, n: int) -> np.ndarray:
    """The counts of the finer point of a set of n."""
    return np.frombuffer(point, np.uint8 if len(point) == fine_groups(n) else np.uint16).astype(np.int64)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least intersection i of sets of n and m with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


class GroupTree:
    """R-tree over count vectors, packed by size, that forgets the points it has given out.

    A node keeps the coordinate maxima and the span of set sizes of its points,
    and how many of them are left.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((*points.T[:3], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.place = np.empty(len(sizes), np.int64)
        self.place[self.order] = np.arange(len(sizes))
        self.alive = np.ones(len(sizes), bool)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []
        top, low, high, left, fan = self.points, self.sizes, self.sizes, np.ones(len(sizes), np.int64), LEAF
        while len(low) > 1 or not self.levels:
            at = np.arange(0, len(low), fan)
            top, low, high, left = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(left, at)
            self.levels.append((top, low, high, left, fan))
            fan = FAN

    def _may(self, q: np.ndarray, n: int, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        fits = (100 * high >= self.percent * n) & (self.percent * low <= 100 * n)
        least = np.maximum(low, -(-self.percent * n // 100))
        return fits & ((np.minimum(top, q).sum(axis=1, dtype=np.int64) >= least_overlap(n, least, self.percent)) | (high > UNBOUNDED))

    def search(self, i: int) -> np.ndarray:
        """Points still there that the bound allows as partners of point i."""
        at = self.place[i]
        q, n = self.points[at], int(self.sizes[at])
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, left, fan = self.levels[depth]
            nodes = nodes[(left[nodes] > 0) & self._may(q, n, top[nodes], low[nodes], high[nodes])]
            below = len(self.levels[depth - 1][1]) if depth else len(self.sizes)
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = nodes[nodes < below]
        nodes = nodes[self.alive[nodes]]
        return self.order[nodes[self._may(q, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]]

    def remove(self, found: np.ndarray) -> None:
        at = self.place[found]
        self.alive[at] = False
        for _, _, _, left, fan in self.levels:
            at = at // fan
            np.subtract.at(left, at, 1)


def clusters(points: np.ndarray, sizes: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (seed, member) of a spanning forest over pairs that the bound allows, verified on ``sets`` if given, and the first point of each one's tree."""
    tree = GroupTree(points, sizes, percent)
    seen = np.zeros(len(sizes), bool)
    home = np.arange(len(sizes))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    left = len(sizes)
    for seed in range(len(sizes)):
        if seen[seed]:
            continue
        seen[seed] = True
        tree.remove(np.array([seed]))
        left -= 1
        todo = [seed]
        while todo and left:
            i = todo.pop()
            found = tree.search(i)
            if sets is not None and len(found):
                own, n = sets[i], len(sets[i])
                found = np.array([j for j in found.tolist() if 100 * (s := _shared(own, sets[j])) >= percent * (n + len(sets[j]) - s)], np.int64)
            if len(found):
                seen[found] = True
                home[found] = seed
                tree.remove(found)
                left -= len(found)
                a.append(np.full(len(found), i))
                b.append(found)
                todo += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), home) if a else (none, none, home)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows of documents (part null) and of fine group counts (part set), from one reading of the texts (doc_id, text, digest)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        names = ["doc_id", "digest", "n", "sig", "part", "counts"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for piece in slices(batch.column(1)):
                sizes, sigs, all_ = [], [], []
                for s in shingle_sets(piece, k):
                    sizes.append(len(s))
                    sigs.append(_signature(s))
                    all_.append(_fine(s, bits))
                counts += np.bincount(np.concatenate(all_), minlength=1 << bits)
                ids, digests = (batch.column(c).slice(piece.first, piece.n) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, digests, pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(piece.n, pa.int32()), pa.nulls(piece.n, pa.binary())], names)
        if id_type is not None:
            blobs = [zlib.compress(c.astype(np.int64).tobytes(), 1) for c in np.split(counts, FINE_PARTS)]
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(m), pa.int32()), pa.array(blobs, pa.binary())], names)

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, digest binary, n long, sig binary, part int, counts binary")


def _fine_levels(scan: DataFrame, bits: int) -> np.ndarray:
    """The logarithm of each fine group's corpus count, in eighths of an octave; 2^bits bytes whatever the corpus."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // FINE_PARTS, np.int64)
        for blob in table["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(blob), np.int64)
        level = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    rows = scan.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, levels binary").collect()
    out = np.zeros((FINE_PARTS, (1 << bits) // FINE_PARTS), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def _leading(docs: DataFrame, k: int, percent: int, levels, bits: int) -> DataFrame:
    """(doc_id, digest, sig, n, point, fine, leading): the points and the leading shingles of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for piece in slices(batch.column(1)):
                sigs, sizes, points, fine, first = [], [], [], [], []
                for s in shingle_sets(piece, k):
                    n = len(s)
                    sigs.append(_signature(s))
                    sizes.append(n)
                    points.append(count_vector(s).tobytes())
                    fine.append(fine_point(s))
                    first.append(s[np.argsort(level[_fine(s, bits)], kind="stable")[: n + percent * -n // 100 + 1 if n else 0]].view(np.int64))
                ids, digests = (batch.column(c).slice(piece.first, piece.n) for c in (0, 2))
                ends = np.cumsum([0] + [len(f) for f in first]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays([ids, digests, pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), lists], ["doc_id", "digest", "sig", "n", "point", "fine", "leading"])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, sig binary, n long, point binary, fine binary, leading array<long>")


def _column(batches: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches])


def _held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (g, node) in order, and where each g begins."""
    held = [b for b in batches if b.num_rows]
    if not held:
        none = np.zeros(0, np.int64)
        return none, none, none
    g, node = _column(held, 0), _column(held, 1)
    by = np.lexsort((node, g))
    g, node = g[by], node[by]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (node[1:] != node[:-1])])
    g, node = g[new], node[new]
    return g, node, np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names)


def _rows_and_links(g: np.ndarray, node: np.ndarray, marked: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (g, node, other), where ``other`` is null, or the node itself in a marked row; and distinct links, whose g is null."""
    for at in range(0, len(g), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(g[part]), pa.array(node[part]), pa.array(node[part], mask=~marked[part])], ["g", "node", "other"])
    links = np.unique(np.stack([a, b]), axis=1)
    for batch in _batches(["node", "other"], links[0], links[1]):
        yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(0), batch.column(1)], ["g", "node", "other"])


def _runs_linked(run: int):
    """Of rows (g, node), dealt by g and a salt: the rows, but of more than ``run`` of one g only the first, marked, and its links to the others."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, node, starts = _held(batches)
        size = np.diff(np.concatenate([starts, [len(g)]]))
        large = np.repeat(size, size) > run
        first = np.repeat(starts, size)
        kept = ~large | (np.arange(len(g)) == first)
        yield from _rows_and_links(g[kept], node[kept], large[kept], node[first[~kept]], node[~kept])

    return collapse


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, node, other), dealt by g, those whose g at least two nodes hold; where a row is marked, links of all nodes of its g instead.

    A marked row stands for others, which may be near to what it is not near to
    itself: no bound may keep it from meeting the rest.
    """
    held = [b for b in batches if b.num_rows]
    g, node, starts = _held(iter(held))
    size = np.diff(np.concatenate([starts, [len(g)]]))
    first = np.repeat(starts, size)
    hot = np.isin(g, np.concatenate([g[:0], *(b.column(0).filter(b.column(2).is_valid()).to_numpy(zero_copy_only=False) for b in held)]))
    kept, linked = (np.repeat(size, size) > 1) & ~hot, hot & (np.arange(len(g)) != first)
    yield from _rows_and_links(g[kept], node[kept], np.zeros(int(kept.sum()), bool), node[first[linked]], node[linked])


def _candidates(percent: int):
    """Of rows (g, node, n, point), dealt by g: what the trees of the buckets allow, as rows (kind, a, b).

    Small buckets give every pair that passes, larger ones a spanning forest. Kind 0
    is a link that stands, kind 1 one of large sets that a finer bound may look at
    again. Kind 2 has the members b of a tree with large sets, named a: what finer
    bounds link among them takes the place of the tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        g, node, n = (_column(held, i) for i in range(3))
        points = np.concatenate([np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(-1, GROUPS) for b in held])
        by = np.lexsort((n, g))
        g, node, n, points = g[by], node[by], n[by], points[by]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.concatenate([starts, [len(g)]]))
        of = np.repeat(size, size)
        kind, a, b = [], [], []

        def add(k: np.ndarray | int, x: np.ndarray, y: np.ndarray) -> None:
            kind.append(np.broadcast_to(k, len(y)))
            a.append(np.broadcast_to(x, len(y)))
            b.append(y)

        for d in range(1, SMALL_BUCKET):
            i = np.flatnonzero((g[d:] == g[:-d]) & (of[d:] <= SMALL_BUCKET))
            pairs = np.unique(np.stack([np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])]), axis=1, return_index=True)[1] if len(i) else i
            i = i[pairs] if len(i) else i
            ok = (percent * n[i + d] <= 100 * n[i]) & ((np.minimum(points[i], points[i + d]).sum(axis=1, dtype=np.int64) >= least_overlap(n[i], n[i + d], percent)) | (n[i + d] > UNBOUNDED))
            x, y = node[i[ok]], node[i[ok] + d]
            add((n[i[ok]] > FINE_FROM).astype(np.int64), np.minimum(x, y), np.maximum(x, y))
        trees = set()
        for s, m in zip(starts[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
            own = node[s : s + m]
            i, j, home = clusters(points[s : s + m], n[s : s + m], percent)
            large = np.zeros(m, bool)
            np.logical_or.at(large, home, n[s : s + m] > FINE_FROM)
            plain = ~large[home[i]]
            add(0, np.minimum(own[i[plain]], own[j[plain]]), np.maximum(own[i[plain]], own[j[plain]]))
            for first in np.flatnonzero(large).tolist():
                members = np.sort(own[home == first])
                name = int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
                if len(members) > 1 and name not in trees:
                    trees.add(name)
                    add(2, np.int64(name), members)
        rows = np.stack([np.concatenate(kind), np.concatenate(a), np.concatenate(b)]).astype(np.int64)
        if rows.shape[1]:
            yield from _batches(["kind", "a", "b"], *np.unique(rows, axis=1))

    return run


def _finer(percent: int):
    """Links (a, b) among the members (node, n, point, fine) of a tree that finer points allow.

    A tree for each number of groups, over the sets that have as many groups or
    twice as many: sets that may link have sizes too near to be further apart.
    """

    def run(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        own = [np.frombuffer(p, np.uint16).astype(np.int64) if f is None else _fine_counts(f, m) for p, f, m in zip(table["point"].to_pylist(), table["fine"].to_pylist(), n.tolist(), strict=True)]
        groups = np.array([len(p) for p in own])
        a, b = [], []
        for level in np.unique(groups).tolist():
            some = np.flatnonzero((groups == level) | (groups == 2 * level))
            points = np.stack([own[i].reshape(-1, level).sum(axis=0) for i in some]).clip(0, 65535).astype(np.uint16)
            i, j, _ = clusters(points, n[some], percent)
            a.append(node[some[i]])
            b.append(node[some[j]])
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _refined(percent: int):
    """Of rows (a, b, na, nb, fa, fb): links (a, b) that the finer points allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)
            keep = []
            for na, nb, fa, fb in rows:
                if fa is None or fb is None:
                    keep.append(True)
                    continue
                x, y = _fine_counts(fa, na), _fine_counts(fb, nb)
                size = min(len(x), len(y))  # a group's number is the low bits of a finer one's
                x, y = x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)
                keep.append(bool(np.minimum(x, y).sum() >= least_overlap(na, nb, percent)))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return run


def _verified(k: int, percent: int):
    """True links among the rows (root, i, j, node, text) of a group, and whether a node leads its cluster."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        nodes = table["node"].to_numpy()
        sets = [s for piece in slices(table["text"]) for s in shingle_sets(piece, k)]
        sizes = np.array([len(s) for s in sets], np.int64)
        groups = fine_groups(int(sizes.max()))
        points = np.stack([count_vector(s, groups) for s in sets])
        a, b, _ = clusters(points, sizes, percent, sets)
        follower = np.zeros(len(nodes), bool)
        follower[b] = True
        lead = np.flatnonzero(~follower)
        return pa.table({"a": np.concatenate([nodes[a], nodes[lead]]), "b": np.concatenate([nodes[b], nodes[lead]])})

    return run


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    scan = written(_scan(source, k, FINE_BITS), "scan")
    rows = scan.where("part is null").select("doc_id", "digest", "n", "sig")
    same = rows.where("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("row"), F.first("n").alias("n"))
    classes = written(same.select("sig", "row.doc_id", "row.digest", "n").withColumn("node", F.monotonically_increasing_id()), "classes")

    def its_row(x: str) -> Column:
        return (F.col(f"{x}.digest") == F.col("c.digest")) & F.col(f"{x}.doc_id").eqNullSafe(F.col("c.doc_id"))

    levels = spark.sparkContext.broadcast(_fine_levels(scan, FINE_BITS))
    named = _leading(source, k, percent, levels, FINE_BITS).alias("l").join(classes.alias("c"), its_row("l"))
    points = written(named.select("c.node", "l.n", "l.point", "l.fine", "l.leading"), "points")

    salts = max(4, math.isqrt(classes.count()) // 64)
    leading = points.select(F.explode("leading").alias("g"), "node").repartition(F.col("g"), F.pmod(F.xxhash64("node"), F.lit(salts)))
    parts = written(leading.mapInArrow(_runs_linked(RUN), "g long, node long, other long"), "leading")
    meets = written(parts.where("g is not null").repartition("g").mapInArrow(_met, "g long, node long, other long"), "meets")
    runs = parts.unionByName(meets).where("g is null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    once = points.select("node", "n", "point").dropDuplicates(["node"])
    buckets = meets.where("g is not null").join(once, "node").select("g", "node", "n", "point").repartition("g")
    found = written(buckets.mapInArrow(_candidates(percent), "kind long, a long, b long").groupBy("kind", "a", "b").agg(F.count("*").alias("times")), "pairs")
    fine = points.select("node", "n", "point", "fine").dropDuplicates(["node"])
    left, right = (fine.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"f{c}")) for c in "ab")
    stands = found.where("kind = 0").select("a", "b").unionByName(runs)
    looked = found.where("kind = 1").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_refined(percent), "a long, b long")
    trees = found.where("kind = 2").select(F.col("a").alias("tree"), F.col("b").alias("node")).join(fine, "node")
    finer = trees.groupBy("tree").applyInArrow(_finer(percent), "a long, b long")
    parts = written(components(stands.unionByName(looked).unionByName(finer)), "parts")

    members = parts.groupBy("root").agg(F.count("*").alias("members"))
    wanted = parts.join(members, "root").join(classes, "node").select("node", "root", "members", "doc_id", "digest").alias("c")
    texts = written(source.alias("d").join(wanted, its_row("d")).select("c.node", "c.root", "c.members", "d.text").dropDuplicates(["node"]), "texts")

    verify, form = _verified(k, percent), "a long, b long"

    def verified(some: DataFrame, turn: int) -> DataFrame:
        """Links within chunks of the members of each part; a row (a, a) is the leader of a cluster."""
        chunk = F.pmod(F.xxhash64(F.lit(turn), "node"), F.ceil(F.col("members") / CHUNK))
        return written(some.withColumn("chunk", chunk).groupBy("root", "chunk").applyInArrow(verify, form), "links")

    links = now = verified(texts, 0)
    large = texts.where(F.col("members") > CHUNK)
    turn, before = 0, math.inf
    while True:
        leaders = large.join(now.where("a = b").select(F.col("a").alias("node")), "node", "left_semi")
        count = leaders.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
        several = written(leaders.drop("members").join(count, "root"), "leaders")
        n = several.count()
        if n == 0 or n > 0.9 * before:
            break
        turn, before = turn + 1, n
        now = verified(several, turn)
        links = links.unionByName(now)
    if n:
        own = components(links)
        split = large.join(own.select("node", F.col("root").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
        open_ = split.groupBy("root").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("root")
        blocks = F.ceil(F.col("members") / BLOCK)
        split = split.join(open_, "root", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        others = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda c: c != F.col("block")))
        pairs = split.withColumn("other", F.explode(others)).select("root", "node", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        links = links.unionByName(written(pairs.groupBy("root", "i", "j").applyInArrow(verify, form), "links"))

    joined = components(links)
    by_class = classes.select("sig", "node", F.col("doc_id").alias("least")).join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named_classes = by_class.join(ids, "root").select("sig", "component_id")
    return rows.join(named_classes, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id"))

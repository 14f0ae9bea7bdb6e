"""Best-fit packing with a grouping genetic algorithm on islands.

Documents become token pieces; pieces go into sequences of at most ``capacity``
tokens, as few as can be. The pieces are dealt by hash into shards of about
``SHARD_ITEMS``, so the work of one task does not follow the corpus. Each shard
is a bin-packing problem of its own that several islands solve from different
seeds; after each epoch an island's elite migrates to the next island and joins
its population. The least filled bins of every shard are opened again and
their pieces are packed together on the next level, until one shard is left.

A solution is a grouping of items into bins. Crossover injects whole well-filled
bins of one parent into the other, removes the bins that then hold an item
twice, and best-fits the displaced items by decreasing length. Fewer bins are
better; of as many, those whose room is gathered in the fewest bins, so that fewer
pieces climb to the next level. Every island breeds ``GENERATIONS`` children in
every epoch, at the lower bound too, where only the second aim is left; an island
above the bound is widened and breeds on as long as that helps. Each starts from best fit of a shuffled decreasing order.

Edge cases: null or empty text is one piece that holds only the end token; equal
lengths and repeated rows are told apart by a row id; a document longer than
``capacity`` is cut into full pieces and a rest; an empty table gives no rows;
null ids are carried along; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.store import written
from ledgerline.llm.textkernel import SPACE, Slice, slices

CAPACITY = 4096
END_ID = 1
SHARD_ITEMS = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 6
#: An island above the lower bound: its population, children without a better one until it rests, and children at most.
WIDE, PATIENCE, MOST = 8, 60, 400
MAX_LEVELS = 8
#: Units whose tokens one worker remembers before it starts afresh.
CACHE_UNITS = 600_000
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 ASCII letter, 2 digit, 3 other ASCII, 4 what may bind across these
_KIND[SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[39, *range(128, 256)]] = 4


def units(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the parts of a slice that the tokenizer treats apart.

    Words, and in ASCII words without an apostrophe the runs of letters, of digits
    and of other characters. Anything else keeps its word whole: contractions and
    combining marks reach across such runs.
    """
    starts, ends = part.words()
    kind = _KIND[part.data]
    binding = np.concatenate([[0], np.cumsum(kind == 4)])
    whole = np.zeros(len(kind) + 1, np.int32)
    sticky = binding[ends] > binding[starts]
    whole[starts[sticky]] += 1
    whole[ends[sticky]] -= 1
    turn = np.zeros(len(kind) + 1, bool)
    turn[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    turn &= np.cumsum(whole) == 0
    begin, stop = turn.copy(), turn
    begin[starts] = True
    stop[ends] = True
    return np.flatnonzero(begin), np.flatnonzero(stop)


class WordTokens:
    """Token ids of the units of texts, remembered between slices.

    Fit for tokenizers that lower-case, drop white space and split letters, digits
    and other characters, so that a text's ids are those of its units in a row.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.bounds = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Appends the ids of some units, encoded in one call as a text."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0] + [len(w) + 1 for w in words])
        spans = np.fromiter((s for s, _ in encoded.offsets), np.int64)
        counts = np.bincount(np.searchsorted(begins, spans, "right") - 1, minlength=len(words))
        self.bounds = np.concatenate([self.bounds, len(self.flat) + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, np.array(encoded.ids, np.uint32)])

    def __call__(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and how many each document has."""
        starts, ends = units(part)
        docs = part.doc_of(starts)
        keys, first, inverse = np.unique(part.hashes(starts, ends, lower=True), return_index=True, return_inverse=True)
        if len(self.place) > CACHE_UNITS:
            self._clear()
        place, names = self.place, keys.tolist()
        at = np.fromiter((place.get(k, -1) for k in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            data, base = part.data.tobytes(), len(place)
            self._learn([data[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at[new] = np.arange(base, base + len(new))
            place.update(zip(keys[new].tolist(), at[new].tolist(), strict=True))
        from_, size = self.bounds[at][inverse], (self.bounds[at + 1] - self.bounds[at])[inverse]
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        ids = self.flat[np.repeat(from_, size) + step]
        return ids, np.bincount(docs, weights=size, minlength=part.n).astype(np.int64)


@functools.lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and one end id, cut at ``capacity``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer_path)
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, counts = encode(part)
                row, piece, start, length, crc, own = [], [], [], [], [], []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    doc = np.empty(n + 1, "<u4")
                    doc[:n], doc[n] = ids[at : at + n], END_ID
                    at += n
                    for p, s in enumerate(range(0, n + 1, capacity)):
                        cut = doc[s : s + capacity]
                        row.append(i), piece.append(p), start.append(s), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            own.append(cut.astype(np.int32))
                cols = [batch.column(0).take(pa.array(np.array(row, np.int64) + part.first)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


class Bins:
    """A grouping: items of each bin, what each bin holds, and bins by the room they have."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def place(self, order: list[int], size: list[int]) -> Bins:
        """Best fit of items in the given order; the fullest bin with room takes each."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_ = 0
        for b, f in enumerate(self.fill):
            room[self.capacity - f].append(b)
            open_ |= 1 << (self.capacity - f)
        for i in order:
            n = size[i]
            fit = open_ >> n
            if fit:
                r = n + (fit & -fit).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_ ^= 1 << r
                self.items[b].append(i)
                self.fill[b] += n
            else:
                r, b = self.capacity, len(self.fill)
                self.items.append([i])
                self.fill.append(n)
            room[r - n].append(b)
            open_ |= 1 << (r - n)
        return self

    @property
    def cost(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones (Falkenauer's sum of squares)."""
        return len(self.fill), -sum(f * f for f in self.fill)

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, own in enumerate(self.items):
            out[own] = b
        return out

    @staticmethod
    def of(assignment: np.ndarray, size: list[int], capacity: int) -> Bins:
        out = Bins(capacity)
        for i, b in enumerate(assignment.tolist()):
            while len(out.fill) <= b:
                out.items.append([])
                out.fill.append(0)
            out.items[b].append(i)
            out.fill[b] += size[i]
        return out


def crossover(a: Bins, b: Bins, size: list[int], dice: random.Random) -> Bins:
    """Some well-filled bins of ``b`` injected whole into ``a``."""
    ranked = sorted(range(len(b.fill)), key=lambda k: (-b.fill[k], k))
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = dice.sample(best, max(1, len(best) // 2))
    injected = {i for k in chosen for i in b.items[k]}
    child, displaced = Bins(a.capacity), []
    for own, fill in zip(a.items, a.fill, strict=True):
        if injected.isdisjoint(own):
            child.items.append(list(own))
            child.fill.append(fill)
        else:
            displaced += [i for i in own if i not in injected]
    for k in chosen:
        child.items.append(list(b.items[k]))
        child.fill.append(b.fill[k])
    return child.place(sorted(displaced, key=lambda i: (-size[i], i)), size)


def mutate(a: Bins, size: list[int], dice: random.Random) -> Bins:
    """The emptiest bins and a few others opened, their items best-fitted in a shuffled order."""
    ranked = sorted(range(len(a.fill)), key=lambda k: (a.fill[k], k))
    gone = {*ranked[:2], *dice.sample(ranked, min(len(ranked), 3))}
    child = Bins(a.capacity)
    child.items = [list(x) for k, x in enumerate(a.items) if k not in gone]
    child.fill = [f for k, f in enumerate(a.fill) if k not in gone]
    free = [i for k in gone for i in a.items[k]]
    free.sort(key=lambda i: (-size[i] * (0.8 + 0.4 * dice.random()), i))
    return child.place(free, size)


def evolve(size: list[int], capacity: int, seed: int, immigrants: list[np.ndarray], population: int, generations: int) -> Bins:
    """The best grouping of one island after an epoch of ``generations`` crossovers.

    Above the lower bound the island is widened and breeds on, until it reaches the
    bound or ``PATIENCE`` children in a row were no better than the best, ``MOST`` at most.
    """
    dice = random.Random(seed)
    down = sorted(range(len(size)), key=lambda i: (-size[i], i))
    least = -(-sum(size) // capacity)
    pool = [Bins.of(x, size, capacity) for x in immigrants]

    def widen(to: int) -> None:
        while len(pool) < to:
            noise = 0.02 * len(pool)
            order = sorted(down, key=lambda i: (-size[i] * (1 - noise + 2 * noise * dice.random()), i))
            pool.append(Bins(capacity).place(order, size))

    widen(population)
    best = min(p.cost for p in pool)
    if best[0] > least and population > 1:
        widen(WIDE)
    bred = idle = 0
    while len(pool) > 1 and (bred < generations or (best[0] > least and idle < PATIENCE and bred < MOST)):
        pool.sort(key=lambda p: p.cost)
        a, b = dice.sample(pool, 2)
        child = crossover(a, b, size, dice)
        if dice.random() < 0.5:
            child = mutate(child, size, dice)
        if child.cost < pool[-1].cost and all(child.cost != p.cost for p in pool):  # equal costs are mostly equal groupings
            pool[-1] = child
        bred, idle = bred + 1, 0 if child.cost < best else idle + 1
        best = min(best, child.cost)
    return min(pool, key=lambda p: p.cost)


def _items(table: pa.Table) -> tuple[pa.Table, list[int]]:
    table = table.sort_by("rid")
    return table, table["length"].to_pylist()


def _level(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, population: int, generations: int, level: int) -> DataFrame:
    """(rid, length, shard, bin, offset, again) of one level; ``again`` marks the emptiest bins, by the room that is left in all."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    form = "shard long, island int, bins int, assignment binary"

    def elite(shard: int, island: int, size: list[int], best: Bins) -> pa.Table:
        return pa.table({"shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()), "bins": pa.array([len(best.fill)], pa.int32()), "assignment": pa.array([best.assignment(len(size)).tobytes()], pa.binary())})

    def seed(epoch: int, shard: int, island: int) -> int:
        return ((level * 64 + epoch) * islands + island) * (1 << 40) + shard

    def begin(key: tuple, table: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        _, size = _items(table)
        return elite(shard, island, size, evolve(size, capacity, seed(0, shard, island), [], population, generations))

    def go_on(epoch: int):
        def run(key: tuple, table: pa.Table, guests: pa.Table) -> pa.Table:
            shard, island = (k.as_py() for k in key)
            _, size = _items(table)
            guests = guests.sort_by([("bins", "ascending"), ("home", "ascending")])
            found = [np.frombuffer(x, np.int32) for x in guests["assignment"].to_pylist()]
            return elite(shard, island, size, evolve(size, capacity, seed(epoch, shard, island), found, population, generations))

        return run

    elites = written(on_islands.groupBy("shard", "island").applyInArrow(begin, form), "elites")
    for epoch in range(1, epochs):

        home = F.col("island").alias("home")
        stay = elites.select("shard", "island", home, "bins", "assignment")
        move = elites.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), home, "bins", "assignment")
        guests = stay.unionByName(move) if islands > 1 else stay
        elites = written(on_islands.groupBy("shard", "island").cogroup(guests.groupBy("shard", "island")).applyInArrow(go_on(epoch), form), "elites")

    def settle(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table, size = _items(table)
        found = found.sort_by([("bins", "ascending"), ("island", "ascending")])
        bin_of = np.frombuffer(found["assignment"][0].as_py(), np.int32)
        length = np.array(size, np.int64)
        order = np.lexsort((np.arange(len(size)), bin_of))
        fill = np.bincount(bin_of, weights=length).astype(np.int64)
        before = np.cumsum(length[order]) - length[order]
        first = np.cumsum(fill) - fill
        rank = np.empty(len(fill), np.int64)
        rank[np.lexsort((np.arange(len(fill)), fill))] = np.arange(len(fill))
        spare = int((capacity - fill).sum())
        again = (rank < min(len(fill) // 4 + 1, 2 * (spare // capacity) + 3)) & (fill < capacity)
        b = bin_of[order]
        return pa.table({"rid": table["rid"].take(pa.array(order)), "length": length[order], "shard": np.full(len(size), key[0].as_py(), np.int64), "bin": b.astype(np.int64), "offset": before - first[b], "again": again[b]})

    both = dealt.groupBy("shard").cogroup(elites.groupBy("shard"))
    return written(both.applyInArrow(settle, "rid long, length long, shard long, bin long, offset long, again boolean"), "placed")


def pack(
    items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS,
    population: int = POPULATION, generations: int = GENERATIONS,
) -> DataFrame:
    """(rid, sequence_id, offset) for items (rid, length) with unique rids and lengths from 1 to ``capacity``."""
    left = items.select(F.col("rid").cast("long").alias("rid"), F.col("length").cast("long").alias("length"))
    done = None
    for level in range(MAX_LEVELS):
        n = left.count()
        shards = max(1, math.ceil(n / shard_items))
        placed = _level(left, shards, capacity, islands, epochs, population, generations, level)
        last = shards == 1 or level == MAX_LEVELS - 1
        sequence = F.lit(level).cast("long") * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 16) + F.col("bin")
        closed = (placed if last else placed.where("not again")).select("rid", sequence.alias("sequence_id"), "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        left = placed.where("again").select("rid", "length")
    raise AssertionError("unreachable")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of the documents, each with its sequence and its offset there."""
    cut = written(pieces(docs, tokenizer_path, capacity, with_ids, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    return cut.join(pack(cut, capacity), "rid").drop("rid")

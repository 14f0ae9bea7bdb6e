import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import packing
from ledgerline.llm.queries import op1_best_fit_packing, tokenizer_path
from ledgerline.llm.textkernel import slices
from tests.llm.conftest import ODD, SF, rows


def ids_of(texts):
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check_pieces(got, docs):
    """Pieces cover each document, hold the ids of a whole encoding, and fill sequences without gaps."""
    want = defaultdict(list)
    for (doc_id, *_), ids in zip(docs, ids_of([d[1] for d in docs]), strict=True):
        for p, s in enumerate(range(0, len(ids), 4096)):
            cut = ids[s : s + 4096]
            want[doc_id].append((p, s, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    have, bins = defaultdict(list), defaultdict(list)
    for doc_id, piece, start, length, crc, sequence, offset in got:
        have[doc_id].append((piece, start, length, crc))
        bins[sequence].append((offset, length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), sum(len(i) for i in ids_of([d[1] for d in docs]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé12 '\t.!-=<|>sStTreEvVmMlLdD\u0301\u0338\x1c\x85\u00a0日İ"), max_size=30), min_size=1, max_size=5))
def test_units_give_the_ids_of_whole_texts(texts):
    encode = packing.word_tokens(tokenizer_path())
    got = []
    for part in slices(pa.array(texts), 16):
        ids, counts = encode(part)
        ends = np.cumsum(counts)
        got += [ids[e - n : e].tolist() + [1] for e, n in zip(ends, counts)]
    assert got == ids_of(texts)


def test_documents(spark, documents):
    n, total = check_pieces(rows(op1_best_fit_packing(spark, SF)), documents)
    assert n <= math.ceil(total / 4096) + 1


def test_odd_documents(spark, odd):
    packed = packing.pack_documents(odd, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    check_pieces(rows(packed), ODD)


def test_many_shards_and_ids(spark):
    dice = random.Random(3)
    items = [(i, dice.randint(1, 100)) for i in range(900)]
    placed = rows(packing.pack(spark.createDataFrame(items, "rid long, length long"), capacity=100, shard_items=120))
    assert sorted(r[0] for r in placed) == list(range(900))
    fill = defaultdict(int)
    for rid, sequence, _ in placed:
        fill[sequence] += items[rid][1]
    assert max(fill.values()) <= 100
    whole = packing.evolve([n for _, n in items], 100, 1, [], 4, 8)
    assert len(fill) <= 1.03 * len(whole.fill)  # against one shard for all


@pytest.mark.parametrize("seed", range(3))
def test_crossover_keeps_every_item_once(seed):
    dice = random.Random(seed)
    size = [dice.randint(1, 60) for _ in range(80)]
    order = list(range(80))
    a = packing.Bins(100).place(dice.sample(order, 80), size)
    b = packing.Bins(100).place(dice.sample(order, 80), size)
    for child in (packing.crossover(a, b, size, dice), packing.mutate(a, size, dice)):
        assert sorted(i for own in child.items for i in own) == order
        assert child.fill == [sum(size[i] for i in own) for own in child.items] and max(child.fill) <= 100


def test_every_island_breeds_and_never_pays_for_it(monkeypatch):
    """Crossovers happen where best fit is already at the lower bound, and the room ends up in fewer bins."""
    calls = []
    whole = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *args: calls.append(1) or whole(*args))
    dice = random.Random(9)
    for _ in range(4):
        size = [min(4096, max(1, int(dice.lognormvariate(6, 1)))) for _ in range(1500)]
        plain = packing.Bins(4096).place(sorted(range(1500), key=lambda i: (-size[i], i)), size)
        before = len(calls)
        first = packing.evolve(size, 4096, 7, [], packing.POPULATION, packing.GENERATIONS)
        other = packing.evolve(size, 4096, 8, [], packing.POPULATION, packing.GENERATIONS)
        best = packing.evolve(size, 4096, 9, [first.assignment(1500), other.assignment(1500)], packing.POPULATION, packing.GENERATIONS)
        assert len(calls) - before == 3 * packing.GENERATIONS
        assert sorted(i for own in best.items for i in own) == list(range(1500))
        assert best.cost <= min(first.cost, other.cost) and first.cost <= plain.cost


def test_breeding_beats_best_fit(spark):
    """Triples that fill a bin exactly: best fit of decreasing lengths is above the bound, the islands come nearer to it."""
    for seed in range(3):
        dice = random.Random(seed)
        size = []
        for _ in range(60):
            a = dice.randint(1556, 2007)
            b = dice.randint((4096 - a) * 42 // 100, (4096 - a) // 2)
            size += [a, b, 4096 - a - b]
        down = sorted(range(len(size)), key=lambda i: (-size[i], i))
        plain = packing.Bins(4096).place(down, size)
        best = packing.evolve(size, 4096, seed, [], packing.POPULATION, packing.GENERATIONS)
        assert sorted(i for own in best.items for i in own) == list(range(180)) and max(best.fill) <= 4096
        assert 60 <= len(best.fill) <= len(plain.fill) - 3
    packed = rows(packing.pack(spark.createDataFrame(list(enumerate(size)), "rid long, length long")).select("sequence_id").distinct())
    assert len(packed) <= len(plain.fill) - 3

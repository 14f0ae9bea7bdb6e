import random
import re

import numpy as np
import pyarrow as pa

from ledgerline.llm import ngram_join
from ledgerline.llm.components import components
from tests.llm.conftest import ODD, rows

WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    sets = []
    for doc_id, text in docs:
        w = re.findall(WORD, (text or "").translate(LOWER))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def edited(base, n, dice):
    words = list(base)
    for _ in range(n):
        words[dice.randrange(len(words))] = f"e{dice.randrange(10**6)}"
    return " ".join(words)


def test_documents(spark, documents):
    docs = [(d[0], d[1]) for d in documents]
    assert sorted(rows(ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))), key=str) == brute(docs)


def test_odd_documents(spark, odd):
    assert sorted(rows(ngram_join.similar_classes(odd)), key=str) == brute([r[:2] for r in ODD])


def test_chains_passages_and_chunks(spark, monkeypatch):
    """A chain of edits, a passage in unrelated documents, and a group that is cut into chunks."""
    for name, value in (("CHUNK", 7), ("BLOCK", 16), ("RUN", 9)):
        monkeypatch.setattr(ngram_join, name, value)
    dice = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    docs, text = [], base
    for i in range(12):  # each next to the last, the ends apart
        text = edited(text, 1, dice).split()
        docs.append((i, " ".join(text)))
    docs += [(100 + i, edited(base, dice.randint(0, 4), dice)) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(200 + i, " ".join(f"u{dice.randrange(10**7)}" for _ in range(80)) + " " + passage) for i in range(30)]
    docs += [(300 + i, passage) for i in range(3)]
    got = sorted(rows(ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))), key=str)
    assert got == brute(docs)


def test_components(spark):
    dice = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 105), (300, 300)] + [(500 + dice.randrange(30), 500 + dice.randrange(30)) for _ in range(25)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(got) == set(near)
    for a in near:
        reach, todo = {a}, [a]
        while todo:
            for y in near[todo.pop()] - reach:
                reach.add(y)
                todo.append(y)
        assert {x for x in got if got[x] == got[a]} == reach


def test_long_path_takes_few_rounds(spark, monkeypatch):
    from ledgerline.llm import components as C

    rounds = []
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, name: rounds.append(name) or written(df, name))
    got = rows(components(spark.range(999).selectExpr("id as a", "id + 1 as b")))
    assert len(got) == 1000 and len({r[1] for r in got}) == 1 and rounds.count("parents") <= 20


def test_shared_passage_makes_no_part(spark, monkeypatch):
    """Long unrelated texts with one passage, under counts that tell nothing: the finer trees keep them apart."""
    monkeypatch.setattr(ngram_join, "FINE_BITS", 6)
    dice = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(300))
    docs = [(i, " ".join(f"u{dice.randrange(10**7)}" for _ in range(2700 + 3 * i)) + " " + passage) for i in range(120)]
    long = docs[0][1].split()
    docs += [(500 + i, edited(long, 5, dice)) for i in range(20)]
    parts = []
    own = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda e: parts.append(own(e)) or parts[-1])
    got = sorted(rows(ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))), key=str)
    assert [r[2] for r in got if r[0] >= 500 or r[0] == 0] == [0] * 21 and all(r[2] == r[0] for r in got if 0 < r[0] < 500)
    assert max(r[1] for r in rows(parts[0].groupBy("root").count())) <= 21


def test_large_sets_at_the_borders_of_finer_points(spark):
    """Near-copies of sets around the sizes from which points get finer."""
    dice = random.Random(8)
    docs = []
    for t, n in enumerate((390, 404, 420, 511, 515, 1023, 1030, 2050)):
        base = [f"t{t}w{i}" for i in range(n)]
        docs += [(100 * t + i, edited(base, dice.randint(0, n // 60), dice)) for i in range(16)] + [(100 * t + 50, " ".join(base[: int(0.81 * n)])), (100 * t + 51, " ".join(base[: int(0.78 * n)]))]
    got = sorted(rows(ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))), key=str)
    assert got == brute(docs)


def test_counts_beyond_a_byte_lose_no_link():
    """A large set with more than 255 shingles in one group, and its copy without three of them."""
    dice = np.random.default_rng(2)
    hashes = np.unique(dice.integers(0, 1 << 62, 3_000, dtype=np.int64).astype(np.uint64))
    hashes[:600] = (hashes[:600] & ~np.uint64(0xFFFF00)) | np.uint64(5 << 8)  # one group of all that are
    hashes = np.unique(hashes)
    sets = [hashes, hashes[3:], hashes[: len(hashes) // 2], np.unique(hashes[700:])]
    fine = [ngram_join.fine_point(s) for s in sets]
    assert len(fine[0]) == 2 * ngram_join.fine_groups(len(sets[0])) and ngram_join._fine_counts(fine[0], len(sets[0])).max() > 255
    table = pa.table({"node": pa.array(range(4)), "n": pa.array([len(s) for s in sets]), "point": pa.array([ngram_join.count_vector(s).tobytes() for s in sets]), "fine": pa.array(fine)})
    out = ngram_join._finer(80)((), table).to_pydict()
    assert set(zip(out["a"], out["b"], strict=True)) == {(0, 1)}
    rows_ = pa.RecordBatch.from_pydict({"a": [0, 0], "b": [1, 2], "na": [len(hashes)] * 2, "nb": [len(sets[1]), len(sets[2])], "fa": [fine[0]] * 2, "fb": fine[1:3]})
    assert [b.to_pydict() for b in ngram_join._refined(80)(iter([rows_]))] == [{"a": [0], "b": [1]}]


def test_rows_that_share_an_id(spark):
    text = lambda w, n=30: " ".join(f"{w}{i}" for i in range(n))
    docs = [(1, text("a")), (1, text("b")), (2, text("b")), (None, text("a")), (None, text("c")), (None, text("c", 31)), (3, text("b") + " x")]
    got = sorted(rows(ngram_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))), key=str)
    assert got == brute(docs)


def test_links_across_the_parts_of_a_hot_shingle(spark, monkeypatch):
    """Pairs that meet on one hot shingle only, in parts of it whose own leaders are unlike."""
    monkeypatch.setattr(ngram_join, "RUN", 9)
    dice = random.Random(8)
    pool = [f"p{i}" for i in range(30)]
    texts = [[f"a{i}", f"b{i}", *dice.sample(pool, 7)] for i in range(300)] + [[f"c{i}", "hot", *dice.sample(pool, 7)] for i in range(40)]
    want = [(i, 9, i) for i in range(340)]
    for i in range(340, 360, 2):
        same = dice.sample(pool, 7)
        texts += [[f"d{i}", "hot", *same], [f"e{i}", "hot", *same]]
        want += [(i, 9, i), (i + 1, 9, i)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all parts come into one task
    try:
        assert sorted(rows(ngram_join.similar_classes(docs, k=1))) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

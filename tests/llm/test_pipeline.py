"""Every stage against a brute-force version of what it should keep."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P
from ledgerline.llm import mixing
from tests.llm.conftest import ODD, SF, rows
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check_pieces

WORD = "[^\x20\x09-\x0d]+"
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rejected(text):
    t = text or ""
    w = re.findall(WORD, t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = t.split("\n")
    seen, dups = set(), 0
    for x in lines:
        if re.search(WORD, x):
            dups += x in seen
            seen.add(x)
    letters, upper = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
    return (
        len(w) < 20 or 100 * len(covered) > 30 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > 3 * len(w) or (dups >= 4 and 100 * dups > 40 * len(lines))
        or sum(map(len, w)) > 40 * len(w) or (10 * upper > 7 * letters and letters >= 50)
    )


def without_lines(docs):
    key = lambda x: x.strip(STRIP).translate(LOWER)
    first = {}
    for d, text, *_ in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(d, first.get(key(x), d))
    out = []
    for d, text, lang, source in docs:
        kept = [x for x in (text or "").split("\n") if not (len(key(x)) >= 10 and first[key(x)] != d)]
        if kept:
            out.append((d, "\n".join(kept), lang, source))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for i, (_, f) in enumerate(P.STAGES):
        docs = P.written(f(spark, docs, SF), f"test-{i}")
        out.append(docs)
    return out


def plain(df):
    return sorted(rows(df.select("doc_id", "text", "lang", "source")))


def test_stages_in_turn(stages, documents):
    want = sorted(d for d in documents if not rejected(d[1]))
    assert plain(stages[0]) == want
    want = sorted(without_lines(want))
    assert plain(stages[1]) == want
    first = {d for d, _, c in brute([d[:2] for d in want]) if d == c}
    want = [d for d in want if d[0] in first]
    assert plain(stages[2]) == want
    mixed = plain(stages[3])
    tokens = lambda some: sum(len((t or "").split()) for _, t, *_ in some)
    assert set(mixed) <= set(want) and abs(tokens(mixed) / tokens(want) - mixing.SIZE) < 0.2
    check_pieces(rows(stages[4]), mixed)
    for s in stages[:4]:
        assert s.columns == P.COLUMNS


def test_near_copies_with_shared_and_null_ids(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    docs = [
        (3, text("x"), "en", "s", 1), (5, text("a"), "en", "s", 1), (5, text("x") + " more", "en", "s", 1), (5, text("a"), "en", "s", 1), (5, text("a"), "de", "s", 1), (7, text("a"), "en", "s", 1),
        (None, text("b"), "en", "s", 1), (None, text("c"), "en", "s", 1), (None, text("c") + " more", "en", "s", 1), (None, text("x"), "en", "s", 1),
        (8, "\n", "en", "s", 1), (8, "\n", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = rows(P.drop_near_copies(spark, df, SF))
    whole = [d for d in kept if d[1] and len(d[1]) > 1]
    assert sorted(d[:3] for d in whole if d[0] is not None) == [(3, text("x"), "en"), (5, text("a"), "de")]
    nulls = [d[1] for d in whole if d[0] is None]
    assert len(nulls) == 2 and text("b") in nulls and set(nulls) & {text("c"), text("c") + " more"}
    assert sorted(map(str, (d for d in kept if d not in whole))) == sorted(map(str, docs[-4:]))


def test_mixture_has_the_target_shares(spark):
    docs = [(i, "a b c", f"src{i % 7 % 3}", ["en", "de", "fr", "es"][i % 4], "prose") for i in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, topic string").withColumn("n", mixing.word_count(mixing.F.col("text")))
    kept = rows(mixing.mix(df, {"source": {"src0": 0.3, "*": 0.7}, "lang": {"en": 0.4, "de": 0.3, "*": 0.3}}, "n").where("sampled").select("source", "lang"))
    share = Counter(s == "src0" for s, _ in kept)[True] / len(kept)
    langs = Counter(x for _, x in kept)
    assert abs(share - 0.3) < 0.02 and abs(langs["en"] / len(kept) - 0.4) < 0.02 and abs(langs["de"] / len(kept) - 0.3) < 0.02


def test_rows_without_an_id_are_sampled(spark):
    """Null ids, and one id that many rows share, are taken at the probability of their cell."""
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} of three", "src0") for i in range(6_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n", mixing.F.lit(3))
    for frame in (df, df.withColumnRenamed("text", "body")):
        mixed = rows(mixing.mix(frame, {"source": {"*": 1.0}}, "n", text_col=frame.columns[1]).select("doc_id", "probability", "sampled"))
        assert {p for _, p, _ in mixed} == {0.5}
        for kind in (lambda i: i is None, lambda i: i == 7, lambda i: i not in (None, 7)):
            taken = [s for i, _, s in mixed if kind(i)]
            assert len(taken) >= 1_999 and abs(sum(taken) - len(taken) / 2) < 3 * (len(taken) / 4) ** 0.5
    by_id = rows(mixing.mix(df.drop("text"), {"source": {"*": 1.0}}, "n").select("doc_id", "sampled").distinct())
    assert len(by_id) == len({i for i, _ in by_id})
    assert rows(mixing.mix(df.unionByName(df), {"source": {"*": 1.0}}, "n").groupBy("text").agg(mixing.F.count_distinct("sampled").alias("c")).where("c > 1")) == []


def test_scarce_category_gives_all_it_has(spark):
    docs = [(i, "src0" if i % 2 else "src1", "markup" if i < 30 else "prose", 10) for i in range(10_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, topic string, n long")
    targets = {"source": {"src0": 0.3, "*": 0.7}, "topic": {"prose": 0.9, "markup": 0.1}}
    kept = rows(mixing.mix(df, targets, "n").where("sampled").select("source", "topic"))
    assert Counter(t for _, t in kept)["markup"] == 30 and abs(len(kept) / len(docs) - 0.5) < 0.02
    assert abs(Counter(s for s, _ in kept)["src0"] / len(kept) - 0.3) < 0.02


def test_values_without_a_target_keep_their_share(spark):
    langs = ["en", "de", "fr", "es", None, "it", "en", "en", "de", "en"]
    docs = [(i, "a b c", f"src{i % 7 % 3}", langs[i % 10]) for i in range(20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    mixed = rows(P.mixing.mix(df.withColumn("n", mixing.word_count("text")).withColumn("topic", mixing.topic(mixing.F.col("text"))), P.TARGETS, "n").select("lang", "probability", "sampled"))
    assert all(p > 0 for _, p, _ in mixed)
    kept = Counter(x for x, _, sampled in mixed if sampled)
    share = {x: n / sum(kept.values()) for x, n in kept.items()}
    assert abs(share[None] - 0.1) < 0.02 and abs(share["it"] - 0.1) < 0.02
    assert abs(share["en"] - 0.8 * 0.55) < 0.02 and abs(share["es"] - 0.8 * 0.13) < 0.02
    staged = Counter(r[0] for r in rows(P.mix_sources(spark, df.withColumn("n_chars", mixing.F.lit(5)), SF).select("lang")))
    assert staged[None] == kept[None] and staged["it"] == kept["it"]
    alone = rows(mixing.mix(df.where("lang is null").withColumn("n", mixing.F.lit(3)), {"lang": {"en": 0.6, "de": 0.4}}, "n").select("probability"))
    assert {p for (p,) in alone} == {0.5}


def test_attainable_weights_equal_a_search():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (1.0, 30.0, 200.0, 1e6):
        shares, tokens = rng.random(6) * [1, 1, 0, 1, 1, 1], rng.random(6) * [1, 100, 10, 0, 10, 50]
        low, high = 0.0, 1e9
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if np.minimum(tokens, shares * middle).sum() < size else (low, middle)
        assert np.allclose(mixing.attainable(shares, tokens, size), np.minimum(tokens * (shares > 0), shares * high))
    assert not mixing.attainable(np.ones(3), np.zeros(3), 0.0).any()


def test_run_equals_the_stages(spark, stages):
    assert sorted(rows(P.run(spark, SF))) == sorted(rows(stages[-1]))


def test_odd_and_empty_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, f in P.STAGES:
            docs = P.written(f(spark, docs, SF), "odd")
            docs.count()
    kept = rows(P.drop_rejected(spark, odd, SF))
    assert sorted((r[0] for r in kept), key=str) == sorted((d[0] for d in ODD if not rejected(d[1])), key=str)


def test_ledger_policies_and_ablations(spark, odd):
    from ledgerline.llm import quality_rules as Q

    ledger = Q.ledger(odd)
    bits = [r[0] for r in rows(ledger.select("fail_bits"))]
    for version, mask in Q.POLICIES.items():
        kept = rows(Q.verdicts(ledger, version).select("fail_bits", "kept"))
        assert all(k == (b & mask == 0) for b, k in kept)
        for rule, failed, alone, all_ in rows(Q.ablations(ledger, version)):
            assert failed == sum(bool(b & mask & Q.BIT[rule]) for b in bits)
            assert alone == sum(b & mask == Q.BIT[rule] for b in bits)
            assert all_ == sum(b & mask != 0 for b in bits)


def test_line_bitmaps_of_long_documents(spark):
    from ledgerline.llm import line_dedup

    shared = [f"shared line number {i}" for i in range(300)]
    docs = [(1, "\n".join(shared[:200])), (2, "\n".join(x for i in range(300) for x in (shared[i].upper() + " ", f"own {i}"))), (None, shared[0]), (3, shared[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: r[1:] for r in rows(line_dedup.dedup_lines(df))}
    assert got[1] == (docs[0][1], 200, 0) and got[None] == (shared[0], 1, 0) and got[3] == ("", 1, 1)
    assert got[2] == ("\n".join(x for i in range(300) for x in ([shared[i].upper() + " "] if i >= 200 else []) + [f"own {i}"]), 600, 200)


def test_url_edge_cases(spark):
    from datetime import date

    from ledgerline.llm import url_filter as U

    d = date
    entries = [("bad.example", "spam", d(2020, 1, 1), 1, True), ("bad.example", "spam", d(2020, 2, 1), 1, False), ("bad.example", "spam", d(2020, 2, 1), 2, True), ("bad.example", "spam", d(2020, 3, 1), 1, False), ("h.org/a/b", "adult", d(2020, 1, 5), 1, True), ("never.org", "spam", d(2020, 1, 1), 1, False)]
    e = spark.createDataFrame(entries, "pattern string, category string, day date, seq int, active boolean")
    urls = [(1, "http://u:p@WWW.Bad.example:80/x?q", d(2020, 1, 31)), (2, "http://bad.example", d(2020, 3, 1)), (3, "http://bad.example", d(2019, 12, 31)), (4, "https://h.org/a/b/c#f", d(2020, 1, 5)), (5, "https://h.org/a/bc", d(2021, 1, 5)), (6, None, d(2021, 1, 5)), (7, "no url", None), (8, "http://never.org/", d(2021, 1, 1)), (9, "http://bad.example/", d(2020, 2, 1)), (9, "http://bad.example/", d(2020, 2, 1))]
    c = spark.createDataFrame(urls, "page_id long, url string, day date")
    got = {r[0]: (r[3], r[4], r[6]) for r in rows(U.filter_urls(c, e))}
    assert got == {1: (1, "spam", False), 2: (0, None, True), 3: (0, None, True), 4: (1, "adult", False), 5: (0, None, True), 6: (0, None, True), 7: (0, None, True), 8: (0, None, True), 9: (1, "spam", False)}
    assert U.filter_urls(c, e.limit(0)).where("kept").count() == len(urls) and U.filter_urls(c.limit(0), e).count() == 0
    both = spark.createDataFrame([("a.b", "spam", d(2020, 1, 1), 1, True), ("a.b", "adult", d(2020, 2, 1), 1, True), ("a.b", "adult", d(2020, 3, 1), 1, False)], e.schema)
    deep = "http://a.b" + "/x" * 100_000
    seen = spark.createDataFrame([(1, deep, d(2020, 1, 5), "x"), (1, "http://x.a.b/", d(2020, 2, 5), "y"), (None, "http://a.b", d(2020, 3, 5), None), (None, "http://a.b", None, "z")], "page_id long, url string, day date, category string")
    assert sorted((str(r[0]), r[3], r[4]) for r in rows(U.filter_urls(seen, both))) == [("1", 1, "spam"), ("1", 2, "spam"), ("None", 0, None), ("None", 1, "spam")]



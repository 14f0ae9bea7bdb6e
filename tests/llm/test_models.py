"""Language model, language ID and ordinal classifier against brute force and held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import kneser_ney, language_id, ordinal_quality, textkernel
from ledgerline.llm.queries import op5_ordinal_quality, op8_lm_scoring, op9_language_id
from tests.llm.conftest import ODD, SF, rows

WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF2 = "/root/testdata/sf0.01"


def brute_model(docs, held):
    toks = {i: [*re.findall(WORD, (t or "").translate(LOWER)), 0] for i, (_, t) in enumerate(docs)}
    train = [toks[i] for i, (d, _) in enumerate(docs) if not held(d)]
    c, pairs, ctx = Counter(), Counter(), Counter()
    for t in train:
        c.update(t)
        pairs.update(zip([1, *t[:-1]], t))
        ctx.update([1, *t[:-1]])
    n, v = sum(c.values()), len(c)
    cont, by = Counter(w for _, w in pairs), {}
    for (a, _), k in pairs.items():
        by.setdefault(a, Counter())[min(k, 3)] += 1
    d2 = kneser_ney.discounts([sum(k == j for k in pairs.values()) for j in (1, 2, 3, 4)])
    d1 = kneser_ney.discounts([sum(k == j for k in cont.values()) for j in (1, 2, 3, 4)])
    freed = sum(d1[min(k, 3) - 1] for k in cont.values()) / len(pairs)

    def p1(w):
        k = cont[w]
        return (k - d1[min(k, 3) - 1] if k else 0) / len(pairs) + freed / (v + 1)

    def p2(a, w):
        if not ctx[a]:
            return p1(w)
        k = pairs[a, w]
        left = sum(d2[j - 1] * m for j, m in by[a].items()) / ctx[a]
        return (k - d2[min(k, 3) - 1] if k else 0) / ctx[a] + left * p1(w)

    for a in (1, *list(c)[:3]):  # it is a distribution over the vocabulary and the unknown word
        if a != 0:
            assert math.isclose(sum(p2(a, w) for w in c) + p2(a, "\0new"), 1, abs_tol=1e-6)
    out = {}
    for i, (d, _) in enumerate(docs):
        t = toks[i]
        out[d] = (held(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p2(a, w)) for a, w in zip([1, *t[:-1]], t)))
    return out


@pytest.mark.parametrize("hold", [2_000_000, 50])
def test_kneser_ney_equals_brute_force(spark, documents, monkeypatch, hold):
    docs = [(d[0], d[1]) for d in documents]
    if hold == 50:
        monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 1 << 16)
    want = brute_model(docs, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    for r in rows(op8_lm_scoring(spark, SF)):
        assert r[1:5] == want[r[0]][:4]
        assert r[5] == pytest.approx(want[r[0]][4]) and r[6] == pytest.approx(want[r[0]][5])


def test_kneser_ney_odd(spark, odd, empty):
    docs = [r[:2] for r in ODD]
    want = brute_model([(i, t) for i, (_, t) in enumerate(docs)], lambda i: docs[i][0] is None or docs[i][0] % 3 == 0)
    got = sorted(rows(kneser_ney.score(odd, kneser_ney.train(odd, F.col("doc_id") % 3 != 0))), key=str)
    for r, (_, w) in zip(got, sorted((((docs[i][0], *w[1:3]), w) for i, w in want.items()), key=str), strict=True):
        assert r[1:3] == w[1:3] and r[4] == pytest.approx(w[5])
    nothing = rows(kneser_ney.score(odd, kneser_ney.train(empty, F.lit(True))))
    assert all(r[2] == 0 and r[3] == 0 and r[4] == 0 for r in nothing)


def test_held_out_text_is_likelier_than_by_unigrams(spark):
    held = [r for r in rows(op8_lm_scoring(spark, SF2)) if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def slow_bits(coder_docs, lang, text):
    """Code length by walking contexts, with exclusion, from raw counts."""
    counts = {}
    for own, t in coder_docs:
        if own == lang:
            s = [256] * 3 + list(t.encode())
            for i in range(3, len(s)):
                for k in range(4):
                    counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    s, bits = [256] * 3 + list(text.encode()), 0.0
    for i in range(3, len(s)):
        out, p = set(), 1.0
        for k in range(3, -1, -1):
            have = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in out}
            if not have:
                continue
            whole = sum(have.values()) + len(have)
            if s[i] in have:
                p *= have[s[i]] / whole
                break
            p *= len(have) / whole
            out |= set(have)
        else:
            p /= 256 - len(out)
        bits -= math.log2(p)
    return bits


def trees_of(spark, docs):
    table = language_id.gram_counts(spark.createDataFrame(docs, "lang string, text string")).toPandas()
    return {lang: language_id.Tree.of(t["gram"].to_numpy(), t["n"].to_numpy()) for lang, t in table.groupby("lang")}


def test_code_lengths_are_exact(spark):
    docs = [("a", "abracadabra abra"), ("a", "cab"), ("b", "zebra zoo é"), ("b", "")]
    trees = trees_of(spark, docs)
    texts = ["abra", "zebra abz", "", "éq日 cad", "oo"]
    (part,) = textkernel.slices(pa.array(texts))
    for lang in "ab":
        assert trees[lang].lengths(part) == pytest.approx([slow_bits(docs, lang, t) for t in texts], abs=1e-3)


def test_forty_languages_keep_all_their_contexts(spark):
    dice = np.random.default_rng(1)
    docs = []
    for k in range(40):
        letters = [chr(0x250 + 9 * k + i) for i in range(9)] + list("aeiou ")
        docs += [(f"l{k:02d}", "".join(dice.choice(letters, 300))) for _ in range(3)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)] + [(None, "xyz", "l99")], "doc_id long, text string, lang string")
    coder = language_id.train(df, F.lit(True))
    assert coder.langs == sorted({lang for lang, _ in docs})
    texts = [t[:80] for _, t in docs[::17]] + ["abc"]
    (part,) = textkernel.slices(pa.array(texts))
    got = [t.lengths(part) for t in coder.trees()]
    for k in (0, 1, 20, 39):
        assert got[k] == pytest.approx([slow_bits(docs, coder.langs[k], t) for t in texts], rel=1e-5)
    found = {r[0]: r[1] for r in rows(language_id.predict(df, coder))}
    assert all(found[i] == lang for i, (lang, _) in enumerate(docs))


def test_choice_of_documents_is_the_least_hashes(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    got = {tuple(r) for r in rows(language_id._first_by_hash(ids, 40))}
    hashes = sorted(rows(ids.select(F.xxhash64("doc_id"), "doc_id", "lang")))
    assert got == {r[1:] for lang in "ab" for r in [r for r in hashes if r[2] == lang][:40]}


def test_predictions_are_those_of_the_shortest_code(spark):
    """The query against the slow coder, on its own sample."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    sample = [(r[1], r[2]) for r in rows(docs.select("doc_id", "lang", "text")) if not held(r[0])]
    got = {r[0]: r for r in rows(op9_language_id(spark, SF))}
    short = sorted((r for r in rows(docs.select("doc_id", "text")) if r[1]), key=lambda r: len(r[1]))[:6]
    langs = sorted({x for x, _ in sample})
    for d, text in short:
        bits = [slow_bits(sample, lang, text) for lang in langs]
        assert got[d][1] == held(d)
        if any(c.isalpha() for c in text):
            assert got[d][2] == langs[int(np.argmin(bits))] and got[d][3] == pytest.approx(1 / sum(2 ** (min(bits) - b) for b in bits), abs=1e-3)


def test_language_of_held_out(spark):
    lang = dict(rows(spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang")))
    got = [r for r in rows(op9_language_id(spark, SF2)) if r[1]]
    assert all(0 <= r[3] <= 1 for r in got)
    assert sum(lang[r[0]] == r[2] for r in got) >= 0.97 * len(got)


def test_language_odd(spark, odd, empty):
    coder = language_id.train(odd, F.lit(True))
    got = {r[0]: r[1:] for r in rows(language_id.predict(odd, coder))}
    assert got[1] == got[2] == got[3] == got[14] == ("und", 0.0)
    assert got[8][0] == "de" and got[16][0] != "und"
    assert {r[1] for r in rows(language_id.predict(odd, language_id.train(empty, F.lit(True))))} == {"und"}


def test_toxic_documents_are_found(spark):
    """Fitted on three quarters of the ratings; the rest must be told apart."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    ratings = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", grade.alias("grade"))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.xxhash64("doc_id") % 4 == 0
    model = ordinal_quality.train(docs, ratings.where(~held), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = rows(ordinal_quality.score(docs.where(held), model).join(ratings, "doc_id"))
    toxic = [r for r in got if r[3] == 0]
    clean = [r for r in got if r[3] > 0]
    assert np.mean([r[2][0] < 0.5 for r in toxic]) > 0.7
    assert np.mean([r[2][0] >= 0.5 for r in clean]) > 0.97
    assert np.mean([r[2][1] >= 0.5 for r in got if r[3] == 2]) > 0.95


def test_ordinal_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = rows(ordinal_quality.score(odd, ordinal_quality.train(odd, none, 3)))
    assert len(got) == len(ODD) and all(0 <= r[1] <= 2 and len(r[2]) == 2 for r in got)
    one = spark.createDataFrame([(4, 2), (4, 2), (9, 0), (None, 1), (8, None)], "doc_id long, grade int")
    assert len(rows(ordinal_quality.score(odd, ordinal_quality.train(odd, one, 3)))) == len(ODD)
    assert rows(op5_ordinal_quality(spark, SF))


def log_likelihood(score, grades, thresholds):
    """Row by row: the probability of each grade is a difference of two logistic curves."""
    total = 0.0
    for x, y in zip(score, grades, strict=True):
        curve = lambda j: 1.0 if j < 0 else 0.0 if j == len(thresholds) else 1 / (1 + math.exp(thresholds[j] - x))
        total += math.log(curve(y - 1) - curve(y))
    return total


def test_ordinal_slopes_are_those_of_the_likelihood():
    dice = np.random.default_rng(3)
    model = ordinal_quality.Model(4)
    model.thresholds = np.array([-1.1, 0.2, 0.9])
    score, grades = dice.normal(0, 1, 40), dice.integers(0, 4, 40)
    pull, below, above = ordinal_quality._pull(score, grades, model)
    h = 1e-6
    for i in range(40):
        up, down = ([score[i] + d] for d in (h, -h))
        assert pull[i] == pytest.approx((log_likelihood(up, grades[i : i + 1], model.thresholds) - log_likelihood(down, grades[i : i + 1], model.thresholds)) / (2 * h), abs=1e-5)
    for j in range(3):
        moved = [model.thresholds + d * (np.arange(3) == j) for d in (h, -h)]
        slope = (log_likelihood(score, grades, moved[0]) - log_likelihood(score, grades, moved[1])) / (2 * h)
        assert slope == pytest.approx(above[grades == j].sum() - below[grades == j + 1].sum(), abs=1e-4)


def test_ordinal_fit_is_repeatable_and_gains_likelihood():
    dice = np.random.default_rng(5)
    grades = dice.integers(0, 3, 600)
    rows = [np.unique(np.concatenate([dice.integers(100, 400, 8), [g] * 1, [10 + g // 2]])) for g in grades]
    flat, bounds = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    models = [ordinal_quality.fit(flat, bounds, grades, 3) for _ in range(2)]
    assert (models[0].weights == models[1].weights).all() and (models[0].thresholds == models[1].thresholds).all()
    assert (np.diff(models[0].thresholds) > 0).all()
    score = [models[0].weights[r].sum() for r in rows]
    share = np.cumsum(np.bincount(grades))[:2] / 600
    plain = log_likelihood(np.zeros(600), grades, np.log(share / (1 - share)))
    assert log_likelihood(score, grades, models[0].thresholds) > plain / 4


def test_ordinal_tails_are_a_plain_sum_of_weights(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ratings = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    model = ordinal_quality.train(docs, ratings, 3)
    model.weights[:] = np.random.default_rng(1).normal(0, 0.05, len(model.weights))
    got = {r[0]: r for r in rows(ordinal_quality.score(docs, model))}
    for d, text in rows(docs.limit(25)):
        (part,) = textkernel.slices(pa.array([text]))
        found, _ = ordinal_quality.features(part)
        total = sum(float(model.weights[k]) for k in set(found.tolist()))
        tails = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert got[d][2] == pytest.approx(tails) and got[d][1] == pytest.approx(sum(tails))

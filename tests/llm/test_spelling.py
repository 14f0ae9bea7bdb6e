"""Spelling variants against a comparison of all pairs."""

import itertools
import random
import re
import zlib
from collections import Counter

from ledgerline.llm import spelling
from tests.llm.conftest import ODD, SCHEMA


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def rows(df):
    return {r["word"]: tuple(r[c] for c in ("n", "n_near", "form", "form_n", "root")) for r in df.collect()}


def test_equals_all_pairs(spark):
    """Few letters, so that bigrams repeat within a word and words are dense; edits at every place, chains of forms, ties."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(250)}
    for w in sorted(words)[:120]:
        i = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:i] + "ü" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 :] if len(w) > 7 and i < len(w) else w]))
    counts = {w: rng.choice([2, 2, 3, 20, 30, 300, 3_000, 30_000]) for w in words if len(w) >= 7}
    counts |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 2_000, "x" * 40: 5, "x" * 41: 50}
    assert rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_words_of_odd_documents(spark):
    docs = [*ODD, (40, "Kennenlernen KENNENLERNEN ÉCOLES×ÉCOLES abcdefg1hijklmnop", "x", "y", 1, "k", 1), (41, "kennenlernen a-kennenlernen", "x", "y", 1, "k", 1), (None, "kennenlernen kennenlernen", "x", "y", 1, "k", 1)] * 2
    counts = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            low = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    words = spelling.words(spark.createDataFrame([(*r, *(3,) * 10) for r in docs], SCHEMA))
    assert {r["word"]: r["n"] for r in words.collect()} == counts and len(counts) > 3
    assert rows(spelling.variants(words)) == plain(counts)


def test_empty_tables(spark):
    assert spelling.variants(spelling.words(spark.createDataFrame([], SCHEMA))).count() == 0
    assert spelling.variants(spelling.words(spark.createDataFrame([(1, *(None,) * 16)], SCHEMA))).count() == 0

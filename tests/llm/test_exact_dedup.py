"""Exact dedup against a plain dictionary, with whole and with weak hashes."""

import hashlib

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup
from tests.llm.conftest import LONG, ODD, SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMILE = "".join("a😀é"[i % 3] for i in range(9_000))
ROWS = [*ODD, (20, LONG.upper().lower() + " ", "x", "y", 1, "k", 1), (21, LONG.upper(), "x", "y", 1, "k", 1), (22, "ÉTÉ", "x", "y", 1, "k", 1), (23, "été", "x", "y", 1, "k", 1), (24, "ÉtÉ", "x", "y", 1, "k", 1), (25, SMILE, "x", "y", 1, "k", 1), (26, SMILE.replace("a", "A"), "x", "y", 1, "k", 1)]


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("bits", [64, 2])
def test_equals_a_dictionary(spark, bits):
    docs = spark.createDataFrame([(*r, *(3,) * 10) for r in [*ROWS, *ROWS[:4]]], SCHEMA)
    got = exact_dedup.dedup(docs, bits=bits).collect()
    want, groups = plain([*ROWS, *ROWS[:4]])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_weak_hashes_have_twins_and_strong_ones_none(spark):
    texts = spark.createDataFrame([(r[1],) for r in ROWS if r[1]], "text string")
    assert exact_dedup.twins(texts, 2).count() > 5 and exact_dedup.twins(texts).isEmpty()


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40_000))
    texts = [body, "an inserted beginning " + body, SMILE, "x" * 5_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(exact_dedup.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in got] == texts and all(len(x) <= exact_dedup.LONGEST for c in got for x in c)
    assert len(set(got[0]) & set(got[1])) > 0.9 * len(got[0])

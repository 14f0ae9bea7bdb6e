"""Turn repair against a search over all edit sequences, and its segments against each other."""

import heapq
import itertools
import random
import re
import zlib

import pytest

from ledgerline.llm import turn_repair

COLUMNS = "conv_id long, turn long, role string, text string, gone boolean"


def plain(rows):
    """Best first by (cost, audit) over (rows read, roles so far); what is not a beginning of a right order is left."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        roles = "".join(r[:1] or "?" for r, _ in out)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            break
        last = (i, "0" if not out else roles if roles == "s" else roles[-1])
        if last in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add(last)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] else 0
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, (*out, rows[i])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, (*out, (role, rows[i][1]))))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, [f"{r}:{t}" for r, t in out])


def conversations():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", "usher"], ["A b.", "C d!", "cut", " \n", "", "é?", "x\x85", "A b. \t"]
    return {c: [(rng.choice(roles[: 3 + c % 4]), rng.choice(texts)) for _ in range(rng.randrange(1, 12))] for c in range(150)}


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_equals_a_search_over_all_edits(spark, segment):
    convs = conversations()
    rows = spark.createDataFrame([(c, i, role, text, False) for c, turns in convs.items() for i, (role, text) in enumerate(turns)], COLUMNS)
    got = {r["conv_id"]: tuple(r[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")) for r in turn_repair.repair(rows, segment).collect()}
    assert got == {c: plain(turns) for c, turns in convs.items()}


def test_long_conversations_cost_the_same_in_segments(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(1, i, rng.choice(["user", "assistant", "system"]), f"text {i}{rng.choice('.!,')}", False) for i in range(700)], COLUMNS)
    a, b = (turn_repair.repair(rows, s).collect() for s in (64, 256))
    assert a == b and a[0]["cost"] > 100 and sum(c != "I" for c in a[0]["audit"]) == 700


def test_nulls_ties_gaps_and_conversations_without_rows(spark):
    rows = [(None, None, None, None, False), (None, None, "user", "Hi.", False), (1, 5, "user", "Hi.", False), (1, None, "system", "Be.", False), (1, 9, "assistant", "Yes.", False), (1, 9, "assistant", "Yes.", False), (2, 1, "user", "Hi.", True), (3, None, "user", "Hi.", False)]
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {
        None: (0, 1, 0, 0, 1, 7, "DKI", ["user:Hi.", "assistant:"]),
        1: (3, 0, 1, 0, 1, 4, "KKKD", ["system:Be.", "user:Hi.", "assistant:Yes."]),
        2: (0, 0, 0, 0, 0, 0, "", []),
        3: (0, 0, 0, 0, 0, 3, "KI", ["user:Hi.", "assistant:"]),
    }
    assert turn_repair.repair(spark.createDataFrame([], COLUMNS)).count() == 0


def test_damage_follows_the_crc(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, *range(60)) for t in (None, 1, 2)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if h == 4 else role, "" if h == 1 else "One Two Three" if h == 2 else text, h == 0)
        want += [row] * (2 if h == 3 else 1)
    assert sorted(map(str, map(tuple, turn_repair.damage(given).collect()))) == sorted(map(str, want))

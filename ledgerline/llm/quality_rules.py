"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for every document and stores the
measurements and one bit for each rule that fails. A policy is a versioned set
of rules; applying one, and asking what each rule alone costs, is bit arithmetic
over the ledger and never reads text again.

Edge cases: null or empty text has no words and fails ``few_words``; null ids are
passed through; repeated rows are judged each for itself; an empty table gives an
empty ledger; extra columns of the input are left alone (``ledger`` reads the id
and text columns only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.textkernel import SPACE, slices, windows, within_docs

#: Rule names; the place of a name is its bit.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "shouting")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Versions stay as they were published; a new choice of rules is a new version.
POLICIES: dict[int, int] = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["long_words"],
    3: BASE | BIT["symbols"] | BIT["long_words"] | BIT["repeated_lines"] | BIT["shouting"],
}
LATEST = 3
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold a key found elsewhere too, and which of them an earlier place holds."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order], later[order] = same[1:] | same[:-1], same[:-1]
    return shared, later


def measure(part) -> dict[str, np.ndarray]:
    """The measurements of each document of a slice."""
    data, n = part.data, part.n
    solid = ~SPACE[data]
    starts, ends = part.words()
    docs = part.doc_of(starts)
    out = {
        "n_words": np.bincount(docs, minlength=n),
        "word_chars": part.per_doc(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": part.per_doc(_SYMBOL[data]),
        "n_letters": part.per_doc(_LETTER[data]),
        "n_upper": part.per_doc(_UPPER[data]),
    }
    line_starts, line_ends, line_docs = part.lines()
    solid_before = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = solid_before[line_ends] > solid_before[line_starts]
    keys = within_docs(part.hashes(line_starts[full], line_ends[full], lower=False), line_docs[full])
    _, later = _repeats(keys)
    out["n_lines"] = np.bincount(line_docs, minlength=n)
    out["n_dup_lines"] = np.bincount(line_docs[full][later], minlength=n)
    found, at = windows(part.hashes(starts, ends, lower=False), docs, WINDOW)
    shared, _ = _repeats(within_docs(found, docs[at]))
    size = len(docs) + WINDOW + 1
    covered = np.cumsum(np.bincount(at[shared], minlength=size) - np.bincount(at[shared] + WINDOW, minlength=size))[: len(docs)] > 0
    out["n_repeat_words"] = np.bincount(docs[covered], minlength=n)
    return out


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """The bit of every rule that fails."""
    words = m["n_words"]
    failed = {
        "few_words": words < 20,
        "repeated_words": 100 * m["n_repeat_words"] > 30 * words,
        "symbols": 10 * m["n_symbols"] > 3 * words,
        "repeated_lines": (m["n_dup_lines"] >= 4) & (100 * m["n_dup_lines"] > 40 * m["n_lines"]),
        "long_words": m["word_chars"] > 40 * words,
        "shouting": (10 * m["n_upper"] > 7 * m["n_letters"]) & (m["n_letters"] >= 50),
    }
    return sum(np.where(failed[r], BIT[r], 0) for r in RULES).astype(np.int64)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the measurements and ``fail_bits``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                m = measure(part)
                ids = batch.column(0).slice(part.first, part.n)
                cols = [ids, *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(failures(m))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *MEASURES, "fail_bits"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in MEASURES)}, fail_bits long")


def verdicts(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """The ledger with ``base_failed``, ``policy`` and ``kept`` under a policy version."""
    bits = F.col("fail_bits")
    return rows.withColumns({
        "base_failed": bits.bitwiseAND(F.lit(BASE)) != 0,
        "policy": F.lit(version),
        "kept": bits.bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0,
    })


def ablations(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """For each rule of a policy: documents that it fails, and that it alone rejects.

    One aggregation by the mask (at most 2^rules groups), then bit tests on the groups.
    """
    mask = POLICIES[version] | BASE
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in RULES if BIT[r] & mask))
    each = groups.select("bits", "count", F.explode(rules).alias("r")).select("bits", "count", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count"))), F.lit(0)).alias("rejected_alone"),
        F.coalesce(F.sum(F.when(F.col("bits") != 0, F.col("count"))), F.lit(0)).alias("rejected_in_all"),
    )

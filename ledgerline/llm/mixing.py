"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed in the cells of the margins' categories. The cells are
bounded by the targets, not by the data: a value without a target of its own
falls under ``"*"``; a margin without ``"*"`` leaves such values the share they
have of all tokens, and its targets divide the rest. Raking scales the cells until each margin has its target
shares of the sample, whose size is a share of all tokens. No cell gives more
tokens than it has: a category too scarce for its target gives all it has, and
the others of its margin share what is missing in proportion. A cell's calibrated
probability is its raked weight over its tokens. A document's draw depends on its
id and a digest of its text, so rows that share an id, or have none, are each drawn
for themselves.

Where the margins contradict each other once cells are full, the sample comes as
near to them as ``ROUNDS`` rounds bring it, the last margin nearest.

Edge cases: null category values fall under ``"*"``; null or empty text weighs 0 tokens, and a cell
without tokens has probability 0; rows of equal id and text are drawn alike, a null id is
one more id; without a text column the id alone decides; an empty table stays empty;
other columns are carried along, but columns of the input named ``probability`` or
``sampled`` give way to the results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OTHER = "*"
ROUNDS = 50
#: Tokens of the sample over all tokens.
SIZE = 0.5
Targets = dict[str, dict[str, float]]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse subject from the text: markup, figures or prose."""
    t = F.coalesce(text, F.lit(""))
    words = word_count(text)
    symbols, digits = F.regexp_count(t, F.lit("[#*$%&|<>]")), F.regexp_count(t, F.lit("[0-9]"))
    return F.when(symbols * 10 > words, "markup").when(digits * 10 > words, "figures").otherwise("prose")


def category(value: Column, shares: dict[str, float]) -> Column:
    named = [k for k in shares if k != OTHER]
    return F.when(value.isin(named), value).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def draw(id_: Column, seed: int, text: Column) -> Column:
    """A uniform number in [0, 1) from the id and the text's MD5: the first 52 bits of an MD5."""
    key = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def attainable(shares: np.ndarray, tokens: np.ndarray, size: float) -> np.ndarray:
    """Tokens that each category of a margin gives: ``size`` in the ratio of ``shares``, none more than it has.

    With the scarcest first, the level that the others share follows from each
    count of categories which give all they have; the highest of these is right.
    """
    open_ = (shares > 0) & (tokens > 0)
    if not open_.any():
        return np.zeros(len(shares))
    s, t = shares[open_], tokens[open_]
    order = np.argsort(t / s, kind="stable")
    s, t = s[order], t[order]
    left, room = size - (np.cumsum(t) - t), np.cumsum(s[::-1])[::-1]
    return np.where(open_, np.minimum(tokens, shares * (left / room).max()), 0.0)


def rake(cells: np.ndarray, shares: list[np.ndarray], rounds: int = ROUNDS, size: float = SIZE) -> np.ndarray:
    """The tokens that each cell gives to a sample of ``size`` of all, margin by margin at its shares."""
    cells = cells.astype(float)
    out, total = cells * size, size * cells.sum()
    rest = [tuple(a for a in range(cells.ndim) if a != axis) for axis in range(cells.ndim)]
    wants = [attainable(want, cells.sum(axis=others), total) for want, others in zip(shares, rest, strict=True)]
    for _ in range(rounds):
        for axis, (want, others) in enumerate(zip(wants, rest, strict=True)):
            have = out.sum(axis=others)
            factor = np.divide(want, have, out=np.zeros_like(have), where=have > 0)
            out = np.minimum(cells, out * factor.reshape([-1 if a == axis else 1 for a in range(out.ndim)]))
    return out


def with_unnamed(shares: dict[str, float], keys: list[str], tokens: np.ndarray) -> np.ndarray:
    """The shares of ``keys``, which have ``tokens``; values without a target keep their part of all tokens if there is no ``"*"``."""
    out = np.array([shares.get(k, 0.0) for k in keys])
    if OTHER not in shares:
        at = keys.index(OTHER)
        named = tokens.sum() - tokens[at]
        if named > 0 and out.any():
            out[at] = out.sum() * tokens[at] / named
        else:
            out[at] = 1.0
    return out


def probabilities(docs: DataFrame, targets: Targets, tokens: str, rounds: int = ROUNDS, size: float = SIZE) -> DataFrame:
    """A row for each cell: its categories and ``probability``. At most the product of the targets' lengths."""
    names = list(targets)
    keys = [list(targets[m]) + ([] if OTHER in targets[m] else [OTHER]) for m in names]
    sums = docs.groupBy(*(category(F.col(m), targets[m]).alias(m) for m in names)).agg(F.sum(tokens).alias("tokens")).collect()
    cells = np.zeros([len(k) for k in keys])
    for r in sums:
        cells[tuple(k.index(r[m]) for m, k in zip(names, keys, strict=True))] = r["tokens"] or 0
    shares = [with_unnamed(targets[m], ks, cells.sum(axis=tuple(a for a in range(cells.ndim) if a != axis))) for axis, (m, ks) in enumerate(zip(names, keys, strict=True))]
    raked = rake(cells, shares, rounds, size)
    p = np.divide(raked, cells, out=np.zeros_like(raked), where=cells > 0)
    rows = [(*(k[i] for k, i in zip(keys, at, strict=True)), float(p[at])) for at in np.ndindex(*p.shape)]
    return docs.sparkSession.createDataFrame(rows, T.StructType([*(T.StructField(m, T.StringType()) for m in names), T.StructField("probability", T.DoubleType())]))


def mix(docs: DataFrame, targets: Targets, tokens: str, seed: int = 1, id_col: str = "doc_id", rounds: int = ROUNDS, size: float = SIZE, text_col: str = "text") -> DataFrame:
    """``docs`` with ``probability`` and ``sampled``; margins are columns named by ``targets``."""
    names = list(targets)
    text = F.col(text_col) if text_col in docs.columns else F.lit(None).cast("string")
    table = F.broadcast(probabilities(docs, targets, tokens, rounds, size).toDF(*(f"t{i}" for i in range(len(names))), "p"))  # its size is that of the targets
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), draw(F.col(f"`{id_col}`"), seed, text).alias("u"), *(category(F.col(m), targets[m]).alias(f"g{i}") for i, m in enumerate(names)))
    joined = keyed.join(table, [keyed[f"g{i}"] == table[f"t{i}"] for i in range(len(names))], "left")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("probability", "sampled")]
    return joined.select(*own, F.col("p").alias("probability"), (F.col("u") < F.col("p")).alias("sampled"))

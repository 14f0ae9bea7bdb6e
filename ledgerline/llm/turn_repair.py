"""Repair of a conversation's structure at the least cost, by native higher-order functions.

Windows over a conversation's turns flag each row's first fault (blank, a copy of an
earlier row, cut off before its sentence ends) and count illegal neighbours. The
turns are collected as sorted structs, and a fold carries the cheapest (cost, audit)
for each of four states of what stands so far: nothing, a system turn alone, a user
turn last, an assistant turn last. A row may be kept, given another role or
deleted, and empty turns may be inserted anywhere; the result reads
``(system? (user assistant)+)?`` by initials. Costs tie by the audit that comes first.

The fold works on segments of ``SEGMENT`` turns: each is folded once for every state
that can be reached before it, and the segments' results are put together by the
same least expressions. Audits stay short while they grow by a letter at a time, so
a long conversation costs in proportion to its turns. A conversation is one row
where it is folded and read out, since its repaired text is one value of the result.

Edge cases: a null role or text counts as one space, and an empty role cannot be kept; null ids are one conversation,
null turns come first and rows of equal turn go by role and text; a conversation
of which no row is left has zeros, an empty audit and an empty text; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Turns that are folded letter by letter before their results are put together.
SEGMENT = 256
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_STATE = "struct<cost:bigint,audit:string,roles:string>"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone) after faults planted by the CRC of ``conv_id:turn``; a dropped row stays as ``gone``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(fault == 4, "user").otherwise(blank(role_col)).alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def flags(rows: DataFrame) -> DataFrame:
    """``rows`` with their place, first fault and what their neighbour makes of them, from windows."""
    alike = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    in_turn = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    blank = bare == ""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")} | {"gone": F.coalesce("gone", F.lit(False))}
    seen = rows.withColumns(spaced).repartition("conv_id").withColumn("copy", ~blank & (F.row_number().over(alike) > 1))
    cut_off = ~blank & ~F.col("copy") & ~F.substring(bare, -1, 1).isin(".", "!", "?")
    return seen.select(
        "conv_id", "turn", "role", "text", "gone", blank.alias("blank"), "copy", cut_off.alias("cut_off"), F.row_number().over(in_turn).alias("place"),
        F.coalesce(~F.concat(F.lag(initial).over(in_turn), initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(in_turn))).alias("new_turn"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plus(state: Column, cost: Column | int, edit: str, role: str) -> Column:
    """The state after one more edit; null stays null. ``role`` is the initial that the edit lets stand, - for none."""
    more = F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], F.lit(edit)).alias("audit"), F.concat(state["roles"], F.lit(role)).alias("roles"))
    return F.when(state.isNotNull(), more)


def _inserted(at: Column) -> Column:
    """The four states with the best of up to two insertions before the next row; more never pay."""
    user = F.least(at[USER], *(_plus(at[s], INSERT, "I", "u") for s in (NOTHING, SYSTEM, ASSISTANT)))
    return _let(user, lambda u: F.array(at[NOTHING], at[SYSTEM], u, F.least(at[ASSISTANT], _plus(u, INSERT, "I", "a"))))


def _after_row(at: Column, row: Column) -> Column:
    """The four states after a row is kept, given a role or deleted."""
    late = F.when(row["cut_off"], CUT_OFF).otherwise(0)
    stays = ~row["lost"]

    def kept(state: int, role: str) -> Column:
        return F.when(stays & (row["initial"] == role), _plus(at[state], late, "K", role))

    def given(state: int, role: str) -> Column:
        return F.when(stays, _plus(at[state], late + REROLE, "R", role))

    gone = [_plus(at[s], DELETE, "D", "-") for s in range(4)]
    to_user = [edit(s, "u") for s in (NOTHING, SYSTEM, ASSISTANT) for edit in (kept, given)]
    return F.array(gone[NOTHING], F.least(gone[SYSTEM], kept(NOTHING, "s")), F.least(gone[USER], *to_user), F.least(gone[ASSISTANT], kept(USER, "a"), given(USER, "a")))


def _start(state: Column | int) -> Column:
    zero = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("roles"))
    return F.array(*(F.when(F.lit(state) == s, zero) for s in range(4))).cast(f"array<{_STATE}>")


def _folded(rows: Column, state: Column) -> Column:
    """The four states after ``rows``, from one state before them."""
    return F.aggregate(rows, _start(state), lambda at, row: _let(_inserted(at), lambda ready: _after_row(ready, row)))


def _joined(at: Column, parts: Column) -> Column:
    """The four states after a segment: ``parts[b]`` is what it makes of state b, null where b cannot be."""

    def through(before: int, after: int) -> Column:
        a, b = at[before], parts[before][after]
        both = F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["roles"], b["roles"]).alias("roles"))
        return F.when(a.isNotNull() & b.isNotNull(), both)

    return F.array(*(F.least(*(through(b, c) for b in range(4))) for c in range(4)))


def cheapest(rows: Column, segment: int = SEGMENT) -> Column:
    """(cost, audit, roles) of the cheapest repair of a conversation's sorted rows."""
    count = F.greatest(F.ceil(F.size(rows) / segment) - 1, F.lit(0)).cast("int")
    segments = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(rows, i * segment + 1, segment))
    four = F.array(*(F.lit(s) for s in range(4)))
    end = F.aggregate(segments, _start(NOTHING), lambda at, part: _let(F.transform(four, lambda s: F.when(F.get(at, s).isNotNull(), _folded(part, s))), lambda parts: _joined(at, parts)))
    return _let(end, lambda e: _let(_inserted(e), lambda done: F.least(done[NOTHING], done[ASSISTANT])))


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def read_out(rows: Column, edits: Column, roles: Column) -> Column:
    """``role:text`` of every turn that stands after the repair, in order; ``edits`` and ``roles`` are arrays of letters."""
    name = lambda r: F.when(r == "u", "user").otherwise("assistant")
    empty = lambda r: F.concat(name(r), F.lit(":"))
    on_rows = F.filter(F.transform(edits, lambda e, k: F.when(e != "I", k)), lambda k: k.isNotNull())

    def turns(places: Column) -> Column:
        def of_row(row: Column, i: Column) -> Column:
            here, before = F.get(places, i), F.coalesce(F.get(places, i - 1), F.lit(-1))
            own = F.when(F.get(edits, here) == "K", F.array(F.concat(row["role"], F.lit(":"), row["text"]))).when(F.get(edits, here) == "R", F.array(F.concat(empty(F.get(roles, here)), row["text"]))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.transform(F.slice(roles, before + 2, here - before - 1), empty), own)

        last = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(-1))
        return F.concat(F.flatten(F.transform(rows, of_row)), F.transform(F.slice(roles, last + 2, F.size(roles) - last - 1), empty))

    return _let(on_rows, turns)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text, gone): its faults, the cost and audit of the cheapest repair, and the repaired turns."""
    turn = F.struct("place", "role", "text", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("copy")).alias("lost"), "cut_off")
    here = ~F.col("gone")
    count = lambda c: F.count_if(here & F.col(c)).alias(c)
    convs = flags(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(here, F.col("turn"))) - F.min(F.when(here, F.col("turn"))) + 1 - F.count_if(here & F.col("new_turn")), F.lit(0)).cast("bigint").alias("gaps"),
        count("blank"), count("copy"), count("cut_off"), count("illegal"), F.sort_array(F.collect_list(F.when(here, turn))).alias("turns"),
    )
    best = convs.withColumn("best", cheapest(F.col("turns"), segment))
    repaired = read_out(F.col("turns"), _letters(F.col("best.audit")), _letters(F.col("best.roles")))
    return best.select("conv_id", "gaps", "blank", F.col("copy").alias("duplicate"), F.col("cut_off").alias("truncated"), "illegal", "best.cost", "best.audit", repaired.alias("repaired"))

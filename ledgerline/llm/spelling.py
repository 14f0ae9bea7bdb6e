"""Spelling variants: words within one edit, by a rare-first prefix filter over bigrams.

The bigrams of all words are put in one order, rarest first (ties by the bigram,
then by its position in the word). One edit touches at most two bigrams of either
word, and those that it leaves keep their order among themselves; the first that
it leaves is hence among the three rarest of both words. So only the three rarest
of each word are joined.

The position limits are strict. An edit that leaves a bigram lies wholly to its
right, then all that is left of the bigram and itself is the same in both words, or
wholly to its left, then all from it on is. The part with the edit is ``r`` or
r + 1 code points long, where r is its length in the shorter word: the edit
lies in its first r // 2 code points, then the last r - r // 2 are the same, or it
does not, then the first r // 2 are. A key is the hash of all this, so a bucket
holds words that agree in all but a few code points, and no word or bigram makes
a large one. Pairs of a bucket are verified by their edit distance.

Edge cases: null and empty texts have no words; a null id counts as empty text in the
damage; words that occur once or are too short are not looked at; words without near
words have a null form, themselves as root and no near words; repeated rows count
as often as they stand; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.columns import lower_ascii
from ledgerline.llm.store import written

#: Least code points of a word (seven have six bigrams, of which one edit leaves four) and least occurrences.
SHORTEST, LEAST = 7, 2
#: How much more frequent a form is than its variant.
TIMES = 10
#: Bigrams that are rarest and joined: two that an edit can touch and one more.
RAREST = 3
#: A table of bigrams up to this size is broadcast; the letters of ``words`` have 90 x 90 at most.
MAX_BIGRAMS = 1 << 16


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, every 31st by the CRC of ``id:run`` without one letter, counted.

    Runs that are too short before a letter goes are too short after it, so they are not matched at all.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    low = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= SHORTEST) & (F.col("n") >= LEAST))


def rarest_bigrams(counts: DataFrame) -> DataFrame:
    """(word, n, rarest): the positions of each word's three rarest bigrams."""
    grams = counts.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word") - 2)).alias("at")).withColumn("gram", F.substring("word", F.col("at") + 1, F.lit(2)))
    often = written(grams.groupBy("gram").agg(F.count("*").alias("often")), "bigrams")
    side = F.broadcast(often) if often.count() <= MAX_BIGRAMS else often
    ordered = F.sort_array(F.collect_list(F.struct("often", "gram", "at")))
    return grams.join(side, "gram").groupBy("word", "n").agg(F.slice(ordered, 1, RAREST)["at"].alias("rarest"))


def _keys(word: Column, at: Column) -> Column:
    """The hashes under which a word is joined for its bigram at ``at``."""
    size = F.char_length(word)
    sides = [
        (0, F.substring(word, F.lit(1), at + 2), F.substring(word, at + 3, size), size - at - 2),
        (1, F.substring(word, at + 1, size), F.substring(word, F.lit(1), at), at),
    ]
    out = []
    for side, same, rest, length in sides:
        for shorter in (0, 1):
            r = length - shorter
            half = F.floor(r / 2).cast("int")
            for last, part in ((0, F.substring(rest, F.lit(1), half)), (1, F.substring(rest, half + 1 + shorter, r - half))):
                out.append(F.when(r >= 0, F.xxhash64(F.lit(2 * side + last), same, r, part)))
    return F.array(*out)


def near_pairs(counts: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of words that one edit tells apart, each once, a before b."""
    keys = F.array_distinct(F.flatten(F.transform("rarest", lambda at: _keys(F.col("word"), at))))
    keyed = written(rarest_bigrams(counts).select(F.explode(keys).alias("key"), "word", "n").where("key is not null"), "spelling-keys")
    a, b = (keyed.select("key", F.col("word").alias(side), F.col("n").alias(f"n_{side}")) for side in "ab")
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) without circles: the last word that the forms lead to.

    Each round doubles the steps taken; a form is ``TIMES`` as frequent as its variant, so a path has no more links than a count has digits.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``counts`` (word, n)."""
    counts = written(counts, "words")
    pairs = near_pairs(counts)
    one_way = F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("best"))
    other = F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("best"))
    both = pairs.select(F.explode(F.array(one_way, other)).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    found = written(
        counts.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")),
        "variants",
    )
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

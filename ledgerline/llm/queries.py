"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, kneser_ney, language_id, line_dedup, media, mixing, ngram_join, oracles, ordinal_quality, packing, quality_rules, spelling, turn_repair, url_filter
from ledgerline.llm.store import written

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that packing counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


#: Target shares of tokens; "*" stands for all values that are not named.
TARGETS: mixing.Targets = {
    "source": {"src0": 0.25, "*": 0.75},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13},
    "topic": {"prose": 0.9, "figures": 0.05, "markup": 0.05},
}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", mixing.word_count(F.col("text")).alias("n_tokens"), mixing.topic(F.col("text")).alias("topic"))
    mixed = mixing.mix(docs, TARGETS, "n_tokens")
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 clean but poor, 2 clean and good. ``kept``: more likely clean than toxic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    ratings = _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    rows = ordinal_quality.score(docs, ordinal_quality.train(docs, ratings, 3))
    clean, good = F.col("p_above")[0], F.col("p_above")[1]
    return rows.select("doc_id", "expected_grade", clean.alias("p_clean"), good.alias("p_good"), (clean < 0.5).alias("toxic"), (clean >= 0.5).alias("kept"), (good >= 0.5).alias("selected"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encode(_table(spark, sf_dir, "documents")), "media")
    return media.features(stored)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_crc_mod(7) == 2, F.lit(False))
    model = kneser_ney.train(docs, ~held)
    rows = kneser_ney.score(docs, model)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_crc_mod(5) == 0, F.lit(False))
    coder = language_id.train(docs, ~held)
    return language_id.predict(docs, coder).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _number(text: Column, digits: int = 8) -> Column:
    """A whole number from the first hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: entries that add, remove and add again, by a rule on the host's MD5."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("k", _number(F.col("host")))
    day = F.lit("2020-01-01").cast("date")

    def entry(pattern: Column, after: Column, seq: int, active: bool) -> Column:
        category = F.element_at(F.array(F.lit("malware"), F.lit("spam"), F.lit("adult"), F.lit("parked")), (F.col("k") % 4 + 1).cast("int"))
        return F.struct(pattern.alias("pattern"), category.alias("category"), F.date_add(day, after.cast("int")).alias("day"), F.lit(seq).alias("seq"), F.lit(active).alias("active"))

    k, host = F.col("k"), F.col("host")
    first = F.array(entry(host, k % 400, 1, True), entry(host, k % 400 + 100 + k % 97, 2, False))
    again = F.array(entry(host, k % 400 + 500, 3, True))
    path = F.array(entry(F.concat(host, F.lit("/en")), k % 300, 1, True))
    none = F.array().cast(first_type := "array<struct<pattern:string,category:string,day:date,seq:int,active:boolean>>")
    rows = F.concat(F.when(k % 3 == 0, first.cast(first_type)).otherwise(none), F.when(k % 6 == 0, again.cast(first_type)).otherwise(none), F.when(k % 5 == 0, path.cast(first_type)).otherwise(none))
    return hosts.select(F.explode(rows).alias("e")).select("e.*")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), (_number(F.col("page_id").cast("string")) % 1000).cast("int")))
    return url_filter.filter_urls(captures, url_list(pages)).withColumnRenamed("id", "page_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = turn_repair.repair(turn_repair.damage(_table(spark, sf_dir, "conversations")))
    return convs.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n").cast("binary"), 256).alias("repaired_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_media_columns": op6_media_columns,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_url_filters": op10_url_filters,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"



def _rake_sql(rounds: int) -> str:
    """DuckDB SQL that rakes the cells as often as the operator does."""
    names = list(TARGETS)
    groups = [f"CASE WHEN {m} IN ({', '.join(repr(k) for k in t if k != '*')}) THEN {m} ELSE '*' END AS g_{m}" for m, t in TARGETS.items()]
    unnamed = {m: f"coalesce({sum(t.values())} * sum(cell) FILTER (g_{m} = '*') OVER () / sum(cell) FILTER (g_{m} <> '*') OVER (), 1)" for m, t in TARGETS.items() if "*" not in t}
    shares = [f"CASE g_{m} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" ELSE {unnamed.get(m, 0)} END" for m, t in TARGETS.items()]
    keys = ", ".join(f"g_{m}" for m in names)
    own = ", ".join(f"({share})::DOUBLE AS s_{m}" for m, share in zip(names, shares, strict=True))
    kept = f"{keys}, cell, " + ", ".join(f"t_{m}" for m in names)
    out = [f"""WITH t AS (SELECT doc_id, source, lang, coalesce(md5(text), '') AS digest, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS n_digits FROM documents),
d AS (SELECT doc_id, source, lang, digest, n_tokens, CASE WHEN n_symbols * 10 > n_tokens THEN 'markup' WHEN n_digits * 10 > n_tokens THEN 'figures' ELSE 'prose' END AS topic FROM t),
g AS (SELECT *, {", ".join(groups)} FROM d),
c AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS cell FROM g GROUP BY ALL),
s AS (SELECT *, {own} FROM c WHERE cell > 0),
z AS (SELECT {mixing.SIZE} * sum(cell) AS size FROM c)"""]
    for m in names:
        out.append(f"""k_{m} AS (SELECT g_{m}, s_{m} AS share, sum(cell) AS tokens FROM s GROUP BY ALL),
l_{m} AS (SELECT max((size - coalesce(before, 0)) / room) AS level FROM (SELECT size, sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  sum(share) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS room FROM k_{m}, z WHERE share > 0 WINDOW o AS (ORDER BY tokens / share, g_{m}))),
t_{m} AS (SELECT g_{m}, coalesce(least(tokens, share * level), 0.0) AS t_{m} FROM k_{m}, l_{m})""")
    out.append(f"r0 AS MATERIALIZED (SELECT s.*, {', '.join(f't_{m}' for m in names)}, cell * {mixing.SIZE} AS w FROM s " + " ".join(f"JOIN t_{m} USING (g_{m})" for m in names) + ")")
    step = 0
    for _ in range(rounds):
        for m in names:
            total = f"sum(w) OVER (PARTITION BY g_{m})"
            out.append(f"r{step + 1} AS MATERIALIZED (SELECT {kept}, CASE WHEN {total} > 0 THEN least(cell, w * t_{m} / {total}) ELSE 0.0 END AS w FROM r{step})")
            step += 1
    on = " AND ".join(f"g.g_{m} = f.g_{m}" for m in names)
    return ",\n".join(out) + f""",
f AS (SELECT {keys}, w / cell AS p FROM r{step})
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 0.0), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1:' || digest), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(p, 0.0) AS sampled
FROM g LEFT JOIN f ON {on}"""


ORACLES: dict[str, str] = {
    "op11_exact_dedup": oracles.EXACT_DEDUP,
    "op12_conversation_repair": oracles.TURN_REPAIR,
    "op13_spelling_variants": oracles.SPELLING,
    "op3_mixing": _rake_sql(mixing.ROUNDS),
    "op10_url_filters": r"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, url, (DATE '2020-01-01' + (('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 1000)::INTEGER)::DATE AS day,
  nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/'), lambda x: x <> '') AS steps FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS k FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
e AS (
  SELECT host AS pattern, k, k % 400 AS n, 1 AS seq, true AS active FROM h WHERE k % 3 = 0
  UNION ALL SELECT host, k, k % 400 + 100 + k % 97, 2, false FROM h WHERE k % 3 = 0
  UNION ALL SELECT host, k, k % 400 + 500, 3, true FROM h WHERE k % 6 = 0
  UNION ALL SELECT host || '/en', k, k % 300, 1, true FROM h WHERE k % 5 = 0),
i AS (SELECT pattern, ['malware', 'spam', 'adult', 'parked'][(k % 4 + 1)::INTEGER] AS category, active,
  (DATE '2020-01-01' + n::INTEGER)::DATE AS first_day, lead((DATE '2020-01-01' + n::INTEGER)::DATE) OVER (PARTITION BY pattern, k % 4 ORDER BY n, seq) AS end_day FROM e),
labels_ AS (SELECT n, page_id, url, day, host, steps, string_split(host, '.') AS l FROM p),
k AS (
  SELECT n, page_id, url, day, host AS key FROM labels_
  UNION SELECT n, page_id, url, day, array_to_string(l[j:], '.') FROM (SELECT *, unnest(range(2, len(l))) AS j FROM labels_)
  UNION SELECT n, page_id, url, day, host || '/' || array_to_string(steps[1:j], '/') FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS j FROM labels_ WHERE host IS NOT NULL)),
m AS (SELECT k.page_id, k.url, k.day, i.pattern, i.category, row_number() OVER (PARTITION BY k.n ORDER BY length(i.pattern) DESC NULLS LAST, i.pattern DESC) AS r,
  count(i.pattern) OVER (PARTITION BY k.n) AS n_active
  FROM k LEFT JOIN i ON k.key = i.pattern AND i.active AND k.day >= i.first_day AND (i.end_day IS NULL OR k.day < i.end_day))
SELECT page_id, url, day, n_active, category, pattern, n_active = 0 AS kept FROM m WHERE r = 1""",
    "op2_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_WORD}')) AS w, unnest(range(len(regexp_extract_all(t, '{_WORD}')))) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN lead(i, 7) OVER o IS NOT NULL THEN
        concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) END AS win
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g WHERE win IS NOT NULL) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lg AS (SELECT doc_id, line, count(*) AS c FROM l GROUP BY ALL),
ld AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, coalesce(sum(c - 1) FILTER (regexp_matches(line, '{_WORD}')), 0)::BIGINT AS n_dup_lines FROM lg GROUP BY doc_id),
wd AS (SELECT doc_id, count(*)::BIGINT AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines,
         len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(t, '[A-Z]')) AS n_upper
  FROM d JOIN ld USING (doc_id) LEFT JOIN wd USING (doc_id) LEFT JOIN v USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_upper > 7 * n_letters AND n_letters >= 50 THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
}

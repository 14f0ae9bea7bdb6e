"""DuckDB SQL of the queries on exact copies, turn repair and spelling variants."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The 256 remainders of a CRC-32, from its polynomial.
_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc32(column: str) -> str:
    """CRC-32 of a string of code points below U+0800; the remainders are column t."""
    point = f"list_transform(string_split({column}, ''), lambda x: ord(x))"
    octets = f"flatten(list_transform({point}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS k FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
  row_number() OVER (PARTITION BY k ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(k) AS text_sha256 FROM d"""

#: Every row is one step: up to two insertions, then keep, rerole or delete; the best of each state is taken on.
TURN_REPAIR = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, {_TABLE}),
r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS nth FROM d WHERE h <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM r),
p AS (SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER w AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
f AS (SELECT *, blank OR again AS lost, NOT blank AND NOT again AND ending NOT IN ('.', '!', '?') AS cut FROM p),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id),
i(a, b, edits, cost, said) AS (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (3, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']),
  (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])),
m(b, e, edit, x, cost) AS (VALUES (0, 0, 'D', NULL, 4), (1, 1, 'D', NULL, 4), (2, 2, 'D', NULL, 4), (3, 3, 'D', NULL, 4), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
  (0, 2, 'R', NULL, 3), (1, 2, 'R', NULL, 3), (3, 2, 'R', NULL, 3), (2, 3, 'R', NULL, 3)),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
  UNION ALL
  SELECT s.conv_id, f.pos, m.e, s.cost + i.cost + m.cost + CASE WHEN f.cut AND m.edit <> 'D' THEN 3 ELSE 0 END AS cost_, s.audit || i.edits || m.edit AS audit_,
    s.said || i.said || CASE m.edit WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE m.e WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text] ELSE [] END
  FROM s JOIN f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = s.pos + 1 JOIN i ON i.a = s.state JOIN m ON m.b = i.b AND (m.x IS NULL OR m.x = f.x) AND (m.edit = 'D' OR NOT f.lost)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id, m.e ORDER BY cost_, audit_) = 1),
e AS (SELECT s.conv_id, s.cost + i.cost AS cost_, s.audit || i.edits AS audit_, array_to_string(s.said || i.said, chr(10)) AS repaired, c.*
  FROM s LEFT JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id JOIN i ON i.a = s.state
  WHERE s.pos = coalesce(c.n, 0) AND i.b IN (0, 3) QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost_, audit_) = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost_ AS cost, audit_ AS audit, sha256(repaired) AS repaired_sha256 FROM e"""

#: Near words by every deletion of one letter, not by bigrams.
SPELLING = rf"""
WITH RECURSIVE l AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
h AS (SELECT run, c, {_crc32("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS c FROM l WHERE length(run) >= 7 GROUP BY ALL), {_TABLE}),
o AS (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.key = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.key = w.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM p GROUP BY word),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root, form AS onward FROM v UNION ALL SELECT t.word, v.word, v.form FROM t JOIN v ON t.onward = v.word)
SELECT v.word, v.n, v.n_near, v.form, v.form_n, t.root FROM v JOIN t ON t.word = v.word AND t.onward IS NULL"""

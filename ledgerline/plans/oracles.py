"""DuckDB SQL that each query of the catalog must equal, over the same warehouse tables."""

from __future__ import annotations

from html.entities import html5

from ledgerline.functions.names import KEY_FIELDS, NAME_STOP, SIC_RANGES, SUFFIXES
from ledgerline.functions.references import BARE, PIECES
from ledgerline.functions.words import BLOCKS, STOPWORDS

#: Views that the queries share: name -> SQL over the tables and other views.
VIEWS: dict[str, str] = {
    "daily": """SELECT 'T' || l_suppkey AS ticker, (date_trunc('month', l_shipdate)::DATE + 10 * least(2, (day(l_shipdate) - 1) // 10)::INTEGER)::DATE AS date, round(50 + 10 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS close, sum(l_quantity) AS volume,
      round(50 + 10 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS adj_close FROM lineitem GROUP BY 1, 2""",
    "second": """SELECT 'T' || l_suppkey AS ticker, (date_trunc('month', l_shipdate)::DATE + 10 * least(2, (day(l_shipdate) - 1) // 10)::INTEGER)::DATE AS date, round(50 + 10 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS close, sum(l_quantity) AS volume,
      round(50 + 10 * ln(sum(l_extendedprice) / sum(l_quantity)), 6) AS adj_close FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2""",
    "members": """SELECT 'T' || s_suppkey AS ticker, s_suppkey AS k, s_name AS security, (DATE '1995-01-01' + (37 * s_suppkey % 1200)::INTEGER)::DATE AS "start",
      CASE WHEN s_suppkey % 3 <> 0 THEN (DATE '1995-01-01' + (37 * s_suppkey % 1200 + 900)::INTEGER)::DATE END AS "end" FROM supplier""",
    "spans": """SELECT ticker, min("start") AS m_start, CASE WHEN bool_or("end" IS NULL) THEN NULL ELSE max("end") END AS m_end FROM members GROUP BY 1""",
    "months": "SELECT last_day(d::DATE) AS month FROM generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) AS g(d)",
    "panel": """SELECT DISTINCT month, ticker FROM members JOIN months ON month >= "start" AND (month <= "end" OR "end" IS NULL)""",
    "sectors": "SELECT 'T' || s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ciks": """SELECT 'T' || s_suppkey AS ticker, s_suppkey AS cik, NULL::DATE AS "start", CASE WHEN s_suppkey % 4 = 0 THEN DATE '1998-06-30' END AS "end" FROM supplier
      UNION ALL SELECT 'T' || s_suppkey, s_suppkey + 1, DATE '1998-07-01', NULL FROM supplier WHERE s_suppkey % 4 = 0""",
    "eras": """SELECT month, ticker, cik FROM (SELECT month, ticker, cik, row_number() OVER (PARTITION BY month, ticker ORDER BY ("start" IS NOT NULL OR "end" IS NOT NULL) DESC, cik) AS r
      FROM ciks JOIN months ON (month >= "start" OR "start" IS NULL) AND (month <= "end" OR "end" IS NULL)) WHERE r = 1""",
    "filings": """SELECT o_custkey AS cik, o_orderkey::VARCHAR AS adsh, 'c' || substr(o_orderpriority, 1, 1) AS concept, 'Tag' || (o_orderkey % 3) AS tag, last_day(o_orderdate::DATE) AS ddate, (o_orderkey % 5)::INTEGER AS qtrs,
      o_totalprice AS value, (last_day(o_orderdate::DATE) + (o_orderkey % 90)::INTEGER)::DATE AS filed, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '10-K/A' END AS form, year(o_orderdate)::INTEGER AS fy FROM orders""",
    "ff": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cik, concept, ddate, qtrs ORDER BY filed, adsh, tag, value DESC) AS r FROM filings) WHERE r = 1",
    "splits": "SELECT 'T' || s_suppkey AS ticker, (DATE '1997-01-01' + (s_suppkey * 11 % 700)::INTEGER)::DATE AS date, 2.0::DOUBLE + s_suppkey % 2 AS ratio FROM supplier WHERE s_suppkey % 5 = 0",
    "floats": "SELECT cik, adsh, ddate, filed, form, round(value * (1 + adsh::BIGINT % 7), 2) AS value, fy FROM filings WHERE form <> '10-Q'",
    "covers": "SELECT cik, adsh, (ddate - 20)::DATE AS ddate, filed, form, 10.0::DOUBLE + adsh::BIGINT % 90 AS value, fy FROM filings",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date) OVER (ORDER BY date) AS next, lead(date, 3) OVER (ORDER BY date) AS third FROM (SELECT DISTINCT date FROM daily)",
    "mends": "SELECT last_day(date) AS month, max(date) AS t FROM daily WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY 1",
    "reb": "SELECT month, t, next AS t_exec FROM mends JOIN cal ON t = date",
    "mpx": """SELECT month, ticker, t, t_exec, px_me, px_exec FROM (SELECT month, ticker, adj_close AS px_me FROM daily JOIN reb ON date = t) a
      FULL JOIN (SELECT month, ticker, adj_close AS px_exec FROM daily JOIN reb ON date = t_exec) b USING (month, ticker) JOIN reb USING (month)""",
    "monthly": """SELECT month, ticker, t, t_exec, px_me, px_exec, me1 / nullif(px_me, 0) - 1 AS ret_cal,
        CASE WHEN ex1 IS NOT NULL AND px_exec IS NOT NULL THEN ex1 / nullif(px_exec, 0) - 1 WHEN ex1 IS NULL AND d.date > t_exec THEN d.adj_close / nullif(px_exec, 0) - 1 END AS ret_fwd,
        NOT (ex1 IS NOT NULL AND px_exec IS NOT NULL) AND coalesce(ex1 IS NULL AND d.date > t_exec AND px_exec IS NOT NULL, false) AS partial
      FROM (SELECT g.month, g.ticker, r.t, r.t_exec, r.t_next, px_me, px_exec, lead(px_me) OVER w AS me1, lead(px_exec) OVER w AS ex1
        FROM (SELECT * FROM (SELECT DISTINCT month FROM mpx), (SELECT DISTINCT ticker FROM mpx)) g LEFT JOIN mpx USING (month, ticker)
        JOIN (SELECT *, lead(t_exec) OVER (ORDER BY month) AS t_next FROM reb) r ON r.month = g.month WINDOW w AS (PARTITION BY g.ticker ORDER BY g.month)) x
      ASOF LEFT JOIN daily d ON x.ticker = d.ticker AND x.t_next >= d.date WHERE px_me IS NOT NULL""".replace("SELECT month, ticker, t,", "SELECT x.month, x.ticker, x.t,"),
    "grid": "SELECT * FROM (SELECT DISTINCT month FROM monthly), (SELECT DISTINCT ticker FROM monthly)",
    "dense": "SELECT month, ticker, px_me FROM grid LEFT JOIN (SELECT month, ticker, px_me FROM monthly) USING (month, ticker)",
    "mom": """SELECT month, ticker, value FROM (SELECT month, ticker, px_me, lag(px_me, 1) OVER w / nullif(lag(px_me, 12) OVER w, 0) - 1 AS value FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY month))
      WHERE value IS NOT NULL AND px_me IS NOT NULL""",
    "rev": """SELECT month, ticker, value FROM (SELECT month, ticker, px_me, px_me / nullif(lag(px_me, 1) OVER w, 0) - 1 AS value FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY month))
      WHERE value IS NOT NULL AND px_me IS NOT NULL""",
    "mom9": "SELECT month, ticker, round(value, 9) AS value FROM mom",
    "rev9": "SELECT month, ticker, round(value, 9) AS value FROM rev",
    "momw": "SELECT m.month, m.ticker, greatest(lo, least(hi, value)) AS value FROM mom9 m JOIN (SELECT month, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM mom9 GROUP BY 1) q USING (month)",
    "revw": "SELECT m.month, m.ticker, greatest(lo, least(hi, value)) AS value FROM rev9 m JOIN (SELECT month, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM rev9 GROUP BY 1) q USING (month)",
    "z": """SELECT month, ticker, round((value - mu) / sd, 9) AS z FROM (SELECT month, ticker, value, CASE WHEN sector IS NULL OR n < 5 THEN am ELSE gm END AS mu, CASE WHEN sector IS NULL OR n < 5 THEN asd ELSE gsd END AS sd
      FROM (SELECT m.month, m.ticker, value, sector, count(*) OVER g AS n, avg(value) OVER a AS am, stddev_samp(value) OVER a AS asd, avg(value) OVER g AS gm, stddev_samp(value) OVER g AS gsd
        FROM momw m LEFT JOIN sectors s ON m.ticker = s.ticker WINDOW a AS (PARTITION BY m.month), g AS (PARTITION BY m.month, sector))) WHERE sd > 0""",
    "rz": """SELECT month, ticker, round((value - mu) / sd, 9) AS z FROM (SELECT month, ticker, value, avg(value) OVER a AS mu, stddev_samp(value) OVER a AS sd FROM revw WINDOW a AS (PARTITION BY month)) WHERE sd > 0""",
    "scored_months": "SELECT z.* FROM z WHERE month IN (SELECT month FROM monthly WHERE ret_fwd IS NOT NULL) AND month IN (SELECT month FROM z GROUP BY 1 HAVING count(*) >= 5)",
    "dec": "SELECT month, ticker, z, (floor((row_number() OVER (PARTITION BY month ORDER BY z, ticker) - 1) * 5 / count(*) OVER (PARTITION BY month)))::INTEGER + 1 AS decile FROM {z}",
    "deciles_all": "SELECT month, ticker, z, ((row_number() OVER (PARTITION BY month ORDER BY z, ticker) - 1) * 5 // count(*) OVER (PARTITION BY month))::INTEGER + 1 AS decile FROM z",
    "deciles_used": "SELECT month, ticker, z, ((row_number() OVER (PARTITION BY month ORDER BY z, ticker) - 1) * 5 // count(*) OVER (PARTITION BY month))::INTEGER + 1 AS decile FROM scored_months",
    "caps": "SELECT m.month, m.ticker, round(px_me * v, 6) AS cap FROM monthly m JOIN (SELECT ticker, last_day(date) AS month, sum(volume) AS v FROM daily GROUP BY 1, 2) USING (month, ticker)",
    "ew": "SELECT month, ticker, decile, 1.0::DOUBLE / count(*) OVER (PARTITION BY month, decile) AS w FROM deciles_used",
    "cw": "SELECT d.month, d.ticker, decile, cap / sum(cap) OVER (PARTITION BY d.month, decile) AS w FROM deciles_used d JOIN caps USING (month, ticker) WHERE cap > 0",
    "factors": """SELECT last_day(o_orderdate::DATE) AS month, round(avg(o_totalprice) / 1e6 - 0.15, 9) AS mkt_rf,
      round(coalesce(avg(o_totalprice) FILTER (c_mktsegment = 'BUILDING'), 0) / 1e6 - coalesce(avg(o_totalprice) FILTER (c_mktsegment = 'MACHINERY'), 0) / 1e6, 9) AS smb,
      round(coalesce(avg(o_totalprice) FILTER (c_mktsegment = 'AUTOMOBILE'), 0) / 1e6 - coalesce(avg(o_totalprice) FILTER (c_mktsegment = 'FURNITURE'), 0) / 1e6, 9) AS hml
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "eligible": """SELECT cik, concept, ddate, filed, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, concept, ddate, filed ORDER BY qtrs, value DESC) AS r FROM ff
      WHERE CASE concept WHEN 'c1' THEN qtrs = 4 AND form LIKE '10-K%' WHEN 'c2' THEN qtrs = 0 AND form LIKE '10-K%' WHEN 'c3' THEN qtrs IN (1, 4) ELSE qtrs = 0 END) WHERE r = 1""",
    "ready": """SELECT cik, concept, value, ddate AS period_end, (filed + 1)::DATE AS available_from FROM (SELECT *, max(ddate) OVER (PARTITION BY cik, concept ORDER BY filed, ddate ROWS UNBOUNDED PRECEDING) AS newest FROM eligible) WHERE ddate >= newest""",
    "ready1": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cik, concept, available_from ORDER BY period_end DESC, value DESC) AS r FROM ready) WHERE r = 1",
    "cikm": "SELECT month, ticker, cik FROM panel JOIN eras USING (month, ticker)",
    "longp": """SELECT p.month, p.ticker, p.cik, p.concept, CASE WHEN period_end >= (p.month - INTERVAL 18 MONTH)::DATE THEN value END AS value, period_end, available_from
      FROM (SELECT c.*, concept FROM cikm c JOIN (SELECT DISTINCT cik, concept FROM eligible) USING (cik)) p ASOF JOIN ready1 v ON p.cik = v.cik AND p.concept = v.concept AND p.month >= v.available_from""",
    "wide": "SELECT month, ticker, cik, " + ", ".join(f"{c}, {c}_period_end" for c in ("c1", "c2", "c3", "c4", "c5")) + " FROM cikm LEFT JOIN (SELECT month, ticker, "
    + ", ".join(f"max(value) FILTER (concept = '{c}') AS {c}, max(period_end) FILTER (concept = '{c}' AND value IS NOT NULL) AS {c}_period_end" for c in ("c1", "c2", "c3", "c4", "c5")) + " FROM longp GROUP BY 1, 2) USING (month, ticker)",
    "fund": """SELECT w.month, w.ticker, c1 AS revenue, c2 AS equity, c3 AS net_income, c4 AS assets, c5 AS cogs, cap, CASE WHEN sector = 'ASIA' THEN 'Financials' ELSE sector END AS sector
      FROM wide w LEFT JOIN caps USING (month, ticker) LEFT JOIN sectors s ON w.ticker = s.ticker""",
    "bank": """SELECT month, ticker, sector, CASE WHEN revenue IS NOT NULL THEN 'tag' WHEN sector = 'Financials' AND net_income + assets IS NOT NULL THEN 'derived_bank' END AS revenue_source,
      coalesce(revenue, CASE WHEN sector = 'Financials' THEN net_income + assets END) AS revenue, coalesce(revenue, CASE WHEN sector = 'Financials' THEN net_income + cogs END) AS revenue_ttm FROM fund""",
    "sharep": """SELECT month, ticker, base, k, mo, CASE WHEN (k + mo) % 11 = 0 THEN base / 1000 WHEN (k + mo) % 7 = 0 THEN NULL ELSE base END AS c0, CASE WHEN k % 9 = 0 THEN base / 1000 ELSE base * 1.1::DOUBLE END AS c1,
      CASE WHEN k % 9 = 0 THEN base / 1000 ELSE base * 1.2::DOUBLE END AS c2 FROM (SELECT month, ticker, substr(ticker, 2)::BIGINT AS k, month(month) AS mo, (1000.0::DOUBLE + 37 * substr(ticker, 2)::BIGINT) * 1000 AS base FROM panel)""",
    "sharel": """SELECT month, ticker, 'cover' AS shares_source, 0 AS rank, c0 AS n_shares, (month - INTERVAL 2 MONTH)::DATE AS shares_filed FROM sharep WHERE c0 > 0
      UNION ALL SELECT month, ticker, 'balance_sheet', 1, c1, (month - INTERVAL 2 MONTH)::DATE FROM sharep WHERE c1 > 0
      UNION ALL SELECT month, ticker, 'weighted_average', 2, c2, (month - INTERVAL 3 MONTH)::DATE FROM sharep WHERE c2 > 0""",
    "docidx": """SELECT doc_id AS adsh, concat_ws('-', source, lang) AS cik, last_day(((DATE '1995-03-31' + (doc_id % 2400)::INTEGER)::DATE - INTERVAL 3 MONTH)::DATE) AS period, (DATE '1995-03-31' + (doc_id % 2400)::INTEGER)::DATE AS filed FROM documents""",
    "pairs": """SELECT cik, adsh, period, filed, prev_adsh, prev_period FROM (SELECT *, lag(adsh) OVER w AS prev_adsh, lag(period) OVER w AS prev_period FROM
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, period ORDER BY filed, adsh) AS r FROM docidx) WHERE r = 1) WINDOW w AS (PARTITION BY cik ORDER BY period))
      WHERE prev_adsh IS NOT NULL AND prev_period >= (period - INTERVAL 18 MONTH)::DATE""",
    "specs": """SELECT strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(o_orderkey::VARCHAR, 12, '0') AS "timestamp", 'f' || (o_custkey % 5) AS factor, 's' || (o_custkey % 2) AS signal, 'ew' AS weighting, '1' AS holding_months, '10' AS n_deciles,
      CASE o_orderkey % 3 WHEN 0 THEN 'sensitivity terminal' WHEN 1 THEN 'base no-sector' ELSE 'base' END AS note, o_totalprice AS sharpe FROM orders""",
    "speclog": f"""SELECT *, substr(sha256(array_to_string([{", ".join({"factor": "factor", "signal": "signal", "weighting": "weighting", "holding_months": "holding_months", "n_deciles": "n_deciles", "sector_neutral": "sector_neutral", "variant": "variant"}.get(k, "''") for k in KEY_FIELDS)}], chr(31))), 1, 12) AS spec_key
      FROM (SELECT *, CASE WHEN note LIKE 'sensitivity%' THEN 'diagnostic' ELSE 'candidate' END AS kind, CASE WHEN note LIKE '%no-sector%' THEN '0' ELSE '1' END AS sector_neutral, CASE WHEN note LIKE 'sensitivity terminal%' THEN 'terminal' ELSE '' END AS variant FROM specs)""",
    "coverage": """SELECT month, count(*) AS members, count(priced) AS priced, count(fwd) AS fwd, round(100.0::DOUBLE * (count(*) - count(priced)) / count(*), 2) AS gap_pct
      FROM panel LEFT JOIN (SELECT month, ticker, 1 AS priced, CASE WHEN ret_fwd IS NOT NULL THEN 1 END AS fwd FROM monthly) USING (month, ticker) WHERE month <= (SELECT max(month) FROM monthly WHERE ret_fwd IS NOT NULL) GROUP BY 1""",
    "other": "SELECT DISTINCT month, CASE WHEN substr(ticker, 2)::BIGINT % 10 = 1 THEN 'X' || substr(ticker, 2) ELSE ticker END AS ticker FROM panel WHERE substr(ticker, 2)::BIGINT % 8 <> 0",
    "alone": """SELECT side, ticker, count(*) AS months, min(month) AS first, max(month) AS last FROM (SELECT 'ours' AS side, * FROM (SELECT * FROM panel EXCEPT SELECT * FROM other)
      UNION ALL SELECT 'theirs', * FROM (SELECT * FROM other EXCEPT SELECT * FROM panel)) GROUP BY 1, 2""",
    "aliases": """SELECT t.ticker AS theirs, o.ticker AS ours FROM (SELECT months, first, last, min(ticker) AS ticker FROM alone WHERE side = 'ours' AND months >= 3 GROUP BY 1, 2, 3 HAVING count(*) = 1) o
      JOIN (SELECT months, first, last, min(ticker) AS ticker FROM alone WHERE side = 'theirs' AND months >= 3 GROUP BY 1, 2, 3 HAVING count(*) = 1) t USING (months, first, last)""",
    "excluded": """SELECT DISTINCT month, ticker FROM members JOIN months ON month BETWEEN "start" + 100 AND "start" + 400 WHERE k % 6 = 0""",
    "cut": """SELECT d.* FROM daily d JOIN members m USING (ticker) WHERE m."end" IS NULL OR d.date <= m."end" """,
    "delist": """SELECT ticker, ("end" + 3)::DATE AS delisting_date FROM members WHERE "end" IS NOT NULL AND k % 4 <> 1""",
    "removed": """SELECT m.ticker, "end", last_px, delisting_date, last_close, prior_me_close, CASE WHEN delisting_date IS NULL THEN 'unknown' WHEN coalesce(abs(last_close / nullif(prior_me_close, 0) - 1) <= 0.2, false) THEN 'acquired' ELSE 'failed' END AS class
      FROM (SELECT * FROM members WHERE "end" IS NOT NULL) m JOIN (SELECT ticker, max(date) AS last_px, arg_max(close, date) AS last_close FROM cut GROUP BY 1) l USING (ticker)
      LEFT JOIN (SELECT ticker, last_day(date) AS month, arg_max(close, date) AS prior_me_close FROM cut GROUP BY 1, 2) p ON p.ticker = m.ticker AND p.month = last_day((last_px - INTERVAL 1 MONTH)::DATE)
      LEFT JOIN delist d ON d.ticker = m.ticker WHERE last_px <= "end" + 45""",
    "clean1": """SELECT d.* FROM daily d WHERE ticker NOT IN (SELECT f.ticker FROM (SELECT ticker, min(date) AS fp FROM daily GROUP BY 1) f JOIN spans USING (ticker) WHERE m_end IS NOT NULL AND fp > m_end)""",
    "clean2": """SELECT *, coalesce(x >= 1.4 AND x1 >= 1.4 AND up <> up1, false) AS spike FROM (SELECT *, lead(x) OVER w AS x1, lead(up) OVER w AS up1 FROM
      (SELECT *, greatest(adj_close / nullif(lag(adj_close) OVER w, 0), lag(adj_close) OVER w / nullif(adj_close, 0)) AS x, sign(adj_close - lag(adj_close) OVER w) AS up FROM clean1 WINDOW w AS (PARTITION BY ticker ORDER BY date)) WINDOW w AS (PARTITION BY ticker ORDER BY date))""",
    "clean3": "SELECT ticker, date, close, volume, adj_close FROM clean2 WHERE NOT spike",
    "corrupt": """SELECT DISTINCT j.ticker FROM (SELECT ticker, date, greatest(adj_close / nullif(lag(adj_close) OVER w, 0), lag(adj_close) OVER w / nullif(adj_close, 0)) AS x FROM clean3 WINDOW w AS (PARTITION BY ticker ORDER BY date)) j
      JOIN spans USING (ticker) WHERE x >= 1.8 AND date >= m_start AND (m_end IS NULL OR date <= m_end)""",
    "dret": "SELECT date, ticker, adj_close / nullif(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM daily",
    "dret9": "SELECT date, ticker, round(ret, 9) AS ret FROM dret WHERE ret IS NOT NULL",
    "mret": "SELECT ticker, month, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY month), 0) - 1 AS ret FROM (SELECT ticker, last_day(date) AS month, arg_max(adj_close, date) AS px FROM daily GROUP BY 1, 2)",
    "words": "SELECT doc_id AS doc, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower({text}), '([a-z][a-z''-]*[a-z]|[a-z])')) AS word FROM documents) WHERE word NOT IN ({stop}) GROUP BY 1, 2",
    "sims": """SELECT p.*, round(coalesce(dot / sqrt(sa.sq::DOUBLE * sb.sq), 0), 9) AS cosine, round(coalesce(common::DOUBLE / (sa.words + sb.words - common), 0), 9) AS jaccard, sa.length AS length_a, sb.length AS length_b
      FROM pairs p JOIN (SELECT doc, sum(n * n)::BIGINT AS sq, count(*) AS words, sum(n)::BIGINT AS length FROM words GROUP BY 1) sa ON sa.doc = p.adsh JOIN (SELECT doc, sum(n * n)::BIGINT AS sq, count(*) AS words, sum(n)::BIGINT AS length FROM words GROUP BY 1) sb ON sb.doc = p.prev_adsh
      LEFT JOIN (SELECT p.adsh AS a, p.prev_adsh AS b, sum(x.n * y.n)::BIGINT AS dot, count(*) AS common FROM pairs p JOIN words x ON x.doc = p.adsh JOIN words y ON y.doc = p.prev_adsh AND y.word = x.word GROUP BY 1, 2) d ON d.a = p.adsh AND d.b = p.prev_adsh
      WHERE sa.length >= 20 AND sb.length >= 20""",
    "fc_first": "SELECT cik, ddate AS float_date, fy, value AS public_float FROM (SELECT *, row_number() OVER (PARTITION BY cik, ddate ORDER BY filed, adsh, value DESC) AS r FROM floats) WHERE r = 1",
    "cv_first": "SELECT cik, ddate AS cd, filed AS cfiled, value AS n FROM (SELECT *, row_number() OVER (PARTITION BY cik, ddate ORDER BY filed, adsh, value DESC) AS r FROM covers) WHERE r = 1",
    "fc0": """SELECT f.*, ticker, px_me AS close, cap, cap / nullif(public_float, 0) AS ratio, CASE WHEN cap / nullif(public_float, 0) < 0.02 THEN 'low' WHEN cap / nullif(public_float, 0) > 0.5 THEN 'high' ELSE '' END AS flag
      FROM (SELECT *, CASE WHEN float_date = last_day(float_date) THEN float_date ELSE last_day((float_date - INTERVAL 1 MONTH)::DATE) END AS month FROM fc_first) f JOIN eras e USING (month, cik) LEFT JOIN (SELECT month, ticker, px_me FROM monthly) p USING (month, ticker) LEFT JOIN caps c USING (month, ticker)""",
    "fc1": "SELECT *, CASE WHEN flag = 'low' THEN 1 / nullif(ratio, 0) ELSE ratio END AS size FROM fc0",
    "fc_scale": """SELECT a.cik, a.float_date, bool_or(a.cap / nullif(b.public_float, 0) BETWEEN 0.02 AND 0.5) AS scale FROM (SELECT * FROM fc1 WHERE flag <> '') a JOIN fc0 b ON a.cik = b.cik AND a.fy <> b.fy AND abs(a.fy - b.fy) <= 2 GROUP BY 1, 2""",
    "fc_split": """SELECT ticker, float_date, bool_or(coalesce(one OR abs(size / after - 1) <= 0.15, false)) AS split FROM (SELECT f.ticker, f.float_date, size, bool_or(abs(size / s.ratio - 1) <= 0.15) AS one, coalesce(product(s.ratio) FILTER (s.date > f.float_date), 1) AS after
      FROM fc1 f JOIN splits s USING (ticker) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "fc_end": """SELECT f.ticker, f.float_date, min(cfiled) AS e FROM (SELECT * FROM fc1 WHERE flag <> '') f JOIN cv_first c USING (cik) JOIN monthly p ON p.ticker = f.ticker AND p.month = CASE WHEN cd = last_day(cd) THEN cd ELSE last_day((cd - INTERVAL 1 MONTH)::DATE) END
      WHERE cd > f.float_date AND cfiled <= (f.float_date + INTERVAL 12 MONTH)::DATE AND p.px_me * n * coalesce((SELECT product(s.ratio) FROM splits s WHERE s.ticker = f.ticker AND s.date > cfiled), 1) / public_float BETWEEN 0.02 AND 0.5 GROUP BY 1, 2""",
    "fc": """SELECT fc1.*, CASE WHEN flag = '' THEN '' WHEN coalesce(scale, false) AND size >= 100 THEN 'float_scale' WHEN coalesce(split, false) THEN 'near_split' WHEN abs(size / 1000 - 1) <= 0.15 THEN 'near_1000' WHEN size > 100 THEN 'over_100x' ELSE 'other' END AS reason,
      CASE WHEN flag <> '' THEN least((fc1.float_date + INTERVAL 12 MONTH)::DATE, e) END AS window_end FROM fc1 LEFT JOIN fc_scale USING (cik, float_date) LEFT JOIN fc_split USING (ticker, float_date) LEFT JOIN fc_end USING (ticker, float_date)""",
    "events_": """SELECT 'T' || k AS ticker, NULL::DATE AS date, NULL::BIGINT AS row, 'current' AS kind, security, "start" AS date_added FROM members WHERE "end" IS NULL
      UNION ALL SELECT CASE WHEN k % 15 = 0 THEN 'OLD' || k ELSE ticker END, "start", 2 * k, 'added', security, NULL FROM members WHERE k % 7 <> 0
      UNION ALL SELECT ticker, ("end" + 1)::DATE, 2 * k + 1, 'removed', security, NULL FROM members WHERE "end" IS NOT NULL
      UNION ALL SELECT ticker, (("end" + 1)::DATE - INTERVAL 6 MONTH)::DATE, 2 * k + 1 + 1000000, 'removed', security, NULL FROM members WHERE "end" IS NOT NULL AND (2 * k + 1) % 13 = 0""",
    "walk": """SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS nk, lead(date) OVER w AS nd, lead(row) OVER w AS nr FROM events_ WINDOW w AS (PARTITION BY ticker ORDER BY date DESC NULLS FIRST, kind = 'removed', row)""",
    "unmatched": "SELECT * FROM walk WHERE kind = 'added' AND coalesce(before, '') NOT IN ('removed', 'current')",
    "leftover": "SELECT *, CASE WHEN kind = 'removed' THEN (date - 1)::DATE END AS e FROM walk WHERE kind IN ('removed', 'current') AND nk IS NULL",
    "rename_pairs": "SELECT u.ticker AS old_ticker, l.ticker AS new_ticker, u.date, u.row, count(*) OVER (PARTITION BY u.ticker, u.row) AS c FROM unmatched u JOIN (SELECT * FROM leftover WHERE e IS NULL AND date_added IS NOT NULL) l ON abs(date_diff('day', u.date, l.date_added)) <= 7 WHERE u.date >= DATE '1995-01-01'",
    "renames": "SELECT old_ticker, new_ticker, date, row FROM rename_pairs WHERE c = 1",
    "intervals": """SELECT ticker, nd AS "start", CASE WHEN kind = 'removed' THEN (date - 1)::DATE END AS "end", 'changes:' || nr || CASE WHEN nk = 'removed' THEN ':inferred' ELSE '' END AS start_source, CASE WHEN kind = 'removed' THEN 'changes:' || row ELSE 'constituents' END AS end_source
      FROM walk WHERE kind IN ('removed', 'current') AND nk IS NOT NULL
      UNION ALL SELECT l.ticker, CASE WHEN old_ticker IS NOT NULL THEN r.date WHEN e IS NULL AND date_added IS NOT NULL THEN date_added ELSE DATE '1900-01-01' END, e,
        CASE WHEN old_ticker IS NOT NULL THEN 'changes:' || r.row || ':renamed_from:' || old_ticker WHEN e IS NOT NULL OR date_added IS NULL THEN 'unknown' WHEN date_added < DATE '1995-01-01' THEN 'constituents:date_added' ELSE 'unverified:date_added' END,
        CASE WHEN kind = 'removed' THEN 'changes:' || l.row ELSE 'constituents' END FROM leftover l LEFT JOIN renames r ON l.ticker = r.new_ticker AND l.e IS NULL""",
    "ls": "SELECT month, round(sum(CASE decile WHEN 5 THEN ret_gross ELSE -ret_gross END), 9) AS ret_gross, round(sum(turnover), 9) AS turnover, round(sum(CASE decile WHEN 5 THEN ret_gross ELSE -ret_gross END) - 0.002 * sum(turnover), 9) AS ret_net FROM bt WHERE decile IN (1, 5) GROUP BY 1",
    "rets": "SELECT month, ticker, ret_fwd AS ret FROM monthly",
    "zr": "SELECT z.month, z.ticker, z, ret_fwd AS r FROM z JOIN monthly USING (month, ticker) WHERE ret_fwd IS NOT NULL",
    "zrank": """SELECT month, ticker, rank() OVER (PARTITION BY month ORDER BY z) + (count(*) OVER (PARTITION BY month, z) - 1) / 2 AS a, rank() OVER (PARTITION BY month ORDER BY r) + (count(*) OVER (PARTITION BY month, r) - 1) / 2 AS b FROM zr""",
    "ic": "SELECT month, corr(a, b) AS ic, count(*) AS n FROM zrank GROUP BY 1 HAVING count(*) >= 10",
    "fwd": "SELECT month, ticker, horizon, ret FROM (" + " UNION ALL ".join(
        f"SELECT month, ticker, {h} AS horizon, lead(px_me, {h}) OVER (PARTITION BY ticker ORDER BY month) / nullif({'px_me' if h == 1 else f'lead(px_me, {h - 1}) OVER (PARTITION BY ticker ORDER BY month)'}, 0) - 1 AS ret FROM dense" for h in (1, 2, 3, 6, 12)
    ) + ") WHERE ret IS NOT NULL",
    "slope": "SELECT month, regr_slope(r, z) AS slope, count(*) AS n FROM zr GROUP BY 1 HAVING count(*) >= 10",
}


def _backtest(weights: str, k: int) -> str:
    """(month, decile, n, ret_gross, turnover, ret_net): a block of k months by its own running products."""
    return f"""SELECT month, decile, coalesce(n, 0) AS n, coalesce(ret_gross, 0) AS ret_gross, coalesce(turnover, 0) AS turnover, coalesce(ret_gross, 0) - 0.002 * coalesce(turnover, 0) AS ret_net FROM
      (SELECT month, decile, count(*) AS n, coalesce(sum(w_in * ret) / nullif(sum(w_in) FILTER (ret IS NOT NULL), 0), 0) AS ret_gross FROM bh_{weights}{k} GROUP BY 1, 2)
      FULL JOIN (SELECT f.month, decile, turnover FROM (SELECT coalesce(a.block, b.block) AS block, coalesce(a.decile, b.decile) AS decile, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover
          FROM (SELECT j // {k} AS block, decile, ticker, w FROM {weights} JOIN bm_{weights} USING (month) WHERE j % {k} = 0) a FULL JOIN (SELECT j // {k} + 1 AS block, decile, ticker, w_out AS w FROM bh_{weights}{k} WHERE j % {k} = {k - 1}) b
          ON a.block = b.block AND a.decile = b.decile AND a.ticker = b.ticker GROUP BY 1, 2) t JOIN (SELECT j // {k} AS block, month FROM bm_{weights} WHERE j % {k} = 0) f USING (block)) USING (month, decile)"""


def _simulation(w: str, k: int, rets: str = "rets") -> None:
    """Views of the portfolios with weights ``w`` held for k months."""
    VIEWS[f"bm_{w}"] = f"SELECT month, row_number() OVER (ORDER BY month) - 1 AS j FROM (SELECT DISTINCT month FROM {w})"
    VIEWS[f"bh_{w}{k}"] = f"""SELECT *, CASE WHEN u > 0 THEN h / u ELSE w_in END AS w_out FROM (SELECT *, sum(h) OVER (PARTITION BY j, decile) AS u FROM (SELECT *, w_in * (1 + coalesce(ret, 0)) AS h FROM (SELECT *, CASE WHEN t > 0 THEN g / t ELSE w END AS w_in FROM (
      SELECT *, sum(g) OVER (PARTITION BY j, decile) AS t FROM (SELECT m.month, m.j, f.decile, f.ticker, f.w, ret, f.w * coalesce(product(1 + coalesce(ret, 0)) OVER (PARTITION BY f.decile, f.ticker, m.j // {k} ORDER BY m.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g
      FROM bm_{w} m JOIN (SELECT j // {k} AS block, ticker, decile, w FROM {w} JOIN bm_{w} USING (month) WHERE j % {k} = 0) f ON f.block = m.j // {k} LEFT JOIN {rets} r ON r.month = m.month AND r.ticker = f.ticker)))))"""
    VIEWS[f"bt_{w}{k}"] = _backtest(w, k)


for _w, _k in (("ew", 1), ("ew", 3), ("cw", 1)):
    _simulation(_w, _k)
VIEWS["bt"] = "SELECT * FROM bt_ew1"
del VIEWS["dec"]


def unescape(text: str) -> str:
    """Named character references by one map of all names, numbers by a case of their own; not for the odd numbers that stand for no character."""
    table = ", ".join(f"'&{name}': '{plain.replace(chr(39), chr(39) * 2)}'" for name, plain in html5.items())
    number = "CASE WHEN p[3] IN ('x', 'X') THEN ('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1))::INTEGER ELSE regexp_extract(p, '^&#([0-9]+)', 1)::INTEGER END"
    begun = ", ".join(f"names[substr(p, 1, {k + 1})] || substr(p, {k + 2})" for k in BARE)
    one = f"CASE WHEN p[1] <> '&' OR p = '&' THEN p WHEN p[2] = '#' THEN chr({number}) ELSE coalesce(names[p], {begun}, p) END".replace("names", f"MAP {{{table}}}")
    return f"array_to_string(list_transform(regexp_extract_all({text}, '{PIECES}'), lambda p: {one}), '')"


def _markup(text: str) -> str:
    """Markup off, as the word functions do it; without back-references each block has its own pattern."""
    out = f"coalesce({text}, '')"
    bare = out
    blocks = "|".join(f"<{b}\\b.*?</{b}\\s*>" for b in BLOCKS)
    bare = f"regexp_replace(regexp_replace({bare}, '(?is)({blocks})', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    looks = f"(regexp_matches(substr({out}, 1, 20000), '(?i)<\\s*(html|body|div|p|table|font)\\b') OR contains(substr({out}, 1, 2000), '<'))"
    out = f"CASE WHEN {looks} THEN {bare} ELSE {out} END"
    return f"replace({unescape(out)}, chr(160), ' ')"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
VIEWS["words"] = VIEWS["words"].format(text=_markup("text"), stop=_STOP)


def least_squares(rows: str, keys: list[str], names: list[str], lags: int = 0) -> str:
    """Least squares with robust errors by what is left of each regressor after the others (rows: keys, month, y and the regressors)."""
    x = ["one", *names]
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    sql = f"SELECT *, 1.0::DOUBLE AS one FROM ({rows}) WHERE y IS NOT NULL AND " + " AND ".join(f"{n} IS NOT NULL" for n in names)

    def left(a: str, j: int, steps: int) -> str:
        return a + "".join(f" - sum({a} * v{j}_{i}) OVER ({by}) / sum(v{j}_{i} * v{j}_{i}) OVER ({by}) * v{j}_{i}" for i in range(steps))

    for s in range(len(names)):
        sql = f"SELECT *, {', '.join(f'{left([o for o in x if o != a][s], j, s)} AS v{j}_{s}' for j, a in enumerate(x))} FROM ({sql})"
    sql = f"SELECT *, {', '.join(f'{left(a, j, len(names))} AS r{j}' for j, a in enumerate(x))} FROM ({sql})"
    sql = f"SELECT *, {', '.join(f'sum(r{j} * y) OVER ({by}) / sum(r{j} * r{j}) OVER ({by}) AS b{j}' for j in range(len(x)))} FROM ({sql})"
    sql = f"SELECT *, y - {' - '.join(f'b{j} * {a}' for j, a in enumerate(x))} AS e FROM ({sql})"
    lagged = "".join(f", lag(r{j} * e, {m}) OVER ({by} ORDER BY month) AS w{j}_{m}" for j in range(len(x)) for m in range(1, lags + 1))
    spread = [" + ".join([f"sum(r{j} * e * r{j} * e)", *(f"2 * {1 - m / (lags + 1)} * sum(r{j} * e * w{j}_{m})" for m in range(1, lags + 1))]) for j in range(len(x))]
    out = "".join(f", any_value(b{j}) AS beta_{a}, any_value(b{j}) / (sqrt({spread[j]}) / sum(r{j} * r{j})) AS t_{a}" for j, a in enumerate(x))
    return f"SELECT {''.join(k + ', ' for k in keys)}count(*) AS n{out}, 1 - var_samp(e) / var_samp(y) AS r2 FROM (SELECT *{lagged} FROM ({sql})){' GROUP BY ' + ', '.join(keys) if keys else ''}"


def normal_cdf(x: str) -> str:
    """The distribution function as one series, its terms by the logarithm of the gamma function."""
    terms = f"list_sum(list_transform(range(200), lambda k: exp(k * ln({x} * {x}) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 WHEN {x} = 0 THEN 0.5 ELSE 0.5 + {x} * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms} END"


def quantiles(ps: str) -> str:
    """(p, q) of the normal quantiles of a query of distinct p, by halving an interval."""
    return f"""(WITH RECURSIVE h AS (SELECT p, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS step FROM ({ps})
      UNION ALL SELECT p, CASE WHEN f < p THEN mid ELSE lo END, CASE WHEN f < p THEN hi ELSE mid END, step + 1 FROM (SELECT *, {normal_cdf('mid')} AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM h)) WHERE step < 46)
      SELECT p, (lo + hi) / 2 AS q FROM h WHERE step = 46)"""


def _sql(body: str) -> str:
    """``body`` with the views it needs, each before its first use."""
    import re

    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*(\w+)|,\s*(\w+)\s+(?=WHERE|\w+\s+WHERE)", sql):
            own = name[0] or name[1]
            if own in VIEWS and own not in order:
                need(VIEWS[own])
                if own not in order:
                    order.append(own)

    need(body)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not views:
        return body
    return f"WITH {views},\n{body[4:].lstrip()}" if body.startswith("WITH") else f"WITH {views}\n{body}"


def _round(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols.split())


_SIC = "CASE " + " ".join(f"WHEN sic BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in SIC_RANGES) + " ELSE 'Other' END"


def _normal(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(upper(coalesce({name}, '')), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), '\\b({'|'.join(SUFFIXES)})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(name: str) -> str:
    stop = ", ".join(f"'{w}'" for w in NAME_STOP)
    return f"list_filter(list_distinct(regexp_extract_all(replace(lower(coalesce({name}, '')), '&', ' and '), '[a-z0-9]+')), lambda w: NOT list_contains([{stop}], w))"


def _resolve(pins: bool) -> str:
    """The count to use, step by step."""
    pin = """ LEFT JOIN (SELECT ticker, CASE WHEN k % 2 = 1 THEN 'balance_sheet' ELSE 'unresolved' END AS pin FROM members WHERE k % 5 = 1) p USING (ticker) WHERE pin IS NULL OR pin = shares_source""" if pins else ""
    prior = "coalesce(n_basis * px_me BETWEEN 1e9 AND 5e9, true)" if pins else "true"
    return f"""SELECT month, ticker, n_shares, shares_source, shares_filed, split_factor, n_basis, NOT in_band AS implausible FROM (SELECT *, row_number() OVER (PARTITION BY month, ticker ORDER BY in_band DESC, rank) AS r FROM (
      SELECT l.*, coalesce((n_basis BETWEEN reference / 5 AND reference * 5 OR (EXISTS (SELECT 1 FROM lb o WHERE o.month = l.month AND o.ticker = l.ticker AND o.shares_source <> l.shares_source AND o.n_basis BETWEEN l.n_basis / 1.25 AND l.n_basis * 1.25)
        AND n_basis BETWEEN reference / 50 AND reference * 50)) AND n_basis >= 1e5, false) AS in_band FROM lb l JOIN
        (SELECT month, ticker, median(n_mid) OVER (PARTITION BY ticker ORDER BY month ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS reference FROM panel LEFT JOIN (SELECT month, ticker, median(n_basis) AS n_mid FROM lb WHERE prior_ok GROUP BY 1, 2) USING (month, ticker)) f
        ON f.month = l.month AND f.ticker = l.ticker)) WHERE r = 1""", f"""SELECT s.*, {prior} AS prior_ok FROM (SELECT l.*, sf.split_factor, n_shares * sf.split_factor AS n_basis FROM (SELECT sharel.* FROM sharel{pin}) l
      JOIN (SELECT k.ticker, k.shares_filed, coalesce(product(ratio), 1) AS split_factor FROM (SELECT DISTINCT ticker, shares_filed FROM sharel) k LEFT JOIN splits s ON s.ticker = k.ticker AND s.date > k.shares_filed GROUP BY 1, 2) sf ON sf.ticker = l.ticker AND sf.shares_filed = l.shares_filed) s
      LEFT JOIN (SELECT month, ticker, px_me FROM monthly) p ON p.month = s.month AND p.ticker = s.ticker"""


def _resolved(pins: bool, outer: str) -> str:
    body, base = _resolve(pins)
    inner = _sql(f"SELECT 1 FROM sharel JOIN splits ON true JOIN monthly ON true JOIN panel ON true JOIN members ON true")
    views = inner[: inner.rindex("\n")]
    return f"{views},\nlb AS ({base}),\nresolved AS ({body})\n{outer}"


_PX = "SELECT month, ticker, px_me FROM monthly"
_CONDITIONS = {
    "book_to_price": "equity / nullif(cap, 0)", "earnings_yield": "net_income / nullif(cap, 0)", "operating_profitability": "CASE WHEN equity > 0 THEN net_income / nullif(equity, 0) END",
    "gross_profitability": "CASE WHEN coalesce(sector <> 'Financials', true) THEN (revenue - cogs) / nullif(assets, 0) END", "accruals": "-(net_income - cogs) / nullif(assets, 0)",
}

_BODIES: dict[str, str] = {
    "month_end_days": "SELECT * FROM mends",
    "rebalance": "SELECT month, t, third AS t_exec FROM mends JOIN cal ON t = date",
    "calendar_shift": """SELECT s."start", b.date AS later FROM (SELECT DISTINCT "start" FROM members) s LEFT JOIN LATERAL (SELECT min(i) AS i FROM cal c WHERE c.date >= s."start") a ON true LEFT JOIN cal b ON b.i = a.i + 5""",
    "month_on_or_before_dates": "SELECT d, CASE WHEN d = last_day(d) THEN d ELSE last_day((d - INTERVAL 1 MONTH)::DATE) END AS month, last_day((d + INTERVAL 3 MONTH)::DATE) AS later FROM (SELECT DISTINCT ts::DATE AS d FROM events)",
    "members_on_day": """SELECT DISTINCT ticker FROM members WHERE "start" <= DATE '1997-06-30' AND ("end" IS NULL OR "end" >= DATE '1997-06-30')""",
    "member_months": "SELECT * FROM panel",
    "member_counts": "SELECT month, count(DISTINCT ticker) AS n FROM months LEFT JOIN panel USING (month) GROUP BY 1",
    "cross_section": "SELECT * FROM panel EXCEPT SELECT * FROM excluded",
    "exclusion_log": "SELECT month, count(*) AS n, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM (SELECT * FROM panel INTERSECT SELECT * FROM excluded) GROUP BY 1",
    "cik_eras": "SELECT * FROM eras",
    "compare_months": """SELECT month, count(*) FILTER (a) AS ours, count(*) FILTER (b) AS theirs, count(*) FILTER (a AND b) AS both FROM (SELECT month, ticker, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT *, 1 AS s FROM panel UNION ALL SELECT *, 2 FROM other) GROUP BY 1, 2) GROUP BY 1""",
    "compare_alone": "SELECT * FROM alone",
    "reconcile_aliases": "SELECT * FROM aliases",
    "reconcile_months": """SELECT month, count(*) FILTER (a) AS ours, count(*) FILTER (b) AS theirs, count(*) FILTER (a AND b) AS both FROM (SELECT month, ticker, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM
      (SELECT *, 1 AS s FROM panel UNION ALL SELECT DISTINCT month, coalesce(ours, ticker), 2 FROM other LEFT JOIN aliases ON ticker = theirs) GROUP BY 1, 2) GROUP BY 1""",
    "override_starts": """SELECT ticker, CASE WHEN k % 4 = 0 AND "end" IS NOT NULL THEN ("start" - 30)::DATE ELSE "start" END AS "start", "end" FROM members UNION ALL SELECT ticker, ("start" - 30)::DATE, "end" FROM members WHERE k % 4 = 0 AND "end" IS NULL
      UNION ALL SELECT 'N' || ticker, "start", "end" FROM members WHERE k % 9 = 0""",
    "snapshot_asof": """SELECT d.date, s.taken, s.tickers FROM (SELECT DISTINCT "start" AS date FROM members) d ASOF LEFT JOIN (SELECT month AS taken, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM panel WHERE month(month) = 12 GROUP BY 1) s ON d.date >= s.taken""",
    "adjudicated_starts": """SELECT m.ticker, CASE decision WHEN 'moved' THEN first_seen WHEN 'unknown' THEN DATE '1900-01-01' ELSE m."start" END AS "start", m."end", decision FROM members m LEFT JOIN
      (SELECT p.ticker, first_seen, CASE WHEN s.ticker IS NULL THEN 'kept' WHEN first_seen = (SELECT min(date) FROM (SELECT month AS date FROM panel WHERE month(month) % 6 = 0 UNION SELECT last_day(("start" - INTERVAL 2 MONTH)::DATE) FROM members WHERE k % 2 = 0)) THEN 'unknown' ELSE 'moved' END AS decision
        FROM (SELECT x.ticker, x."start", d.taken FROM (SELECT ticker, "start", ("start" - 1)::DATE AS b FROM members WHERE "end" IS NULL) x ASOF LEFT JOIN (SELECT DISTINCT month AS taken FROM (SELECT month FROM panel WHERE month(month) % 6 = 0 UNION SELECT last_day(("start" - INTERVAL 2 MONTH)::DATE) FROM members WHERE k % 2 = 0)) d ON x.b >= d.taken) p
        LEFT JOIN (SELECT month AS date, ticker FROM panel WHERE month(month) % 6 = 0 UNION SELECT last_day(("start" - INTERVAL 2 MONTH)::DATE), ticker FROM members WHERE k % 2 = 0) s ON s.date = p.taken AND s.ticker = p.ticker
        LEFT JOIN (SELECT ticker, min(date) AS first_seen FROM (SELECT month AS date, ticker FROM panel WHERE month(month) % 6 = 0 UNION SELECT last_day(("start" - INTERVAL 2 MONTH)::DATE), ticker FROM members WHERE k % 2 = 0) GROUP BY 1) f ON f.ticker = p.ticker) d USING (ticker)""",
    "membership_walk": "SELECT * FROM intervals",
    "membership_problems": """SELECT row, date, ticker, 'removed' AS event FROM walk WHERE kind = 'removed' AND before IN ('removed', 'current') UNION ALL SELECT u.row, u.date, u.ticker, 'added' FROM unmatched u WHERE u.row NOT IN (SELECT row FROM renames)""",
    "membership_renames": "SELECT * FROM renames",
    "membership_summary": """SELECT 'start ' || CASE WHEN start_source LIKE '%:inferred' THEN 'inferred' WHEN start_source LIKE '%:renamed_from:%' THEN 'renamed' ELSE regexp_extract(start_source, '^([a-z]+)', 1) END AS metric, count(*)::VARCHAR AS value FROM intervals GROUP BY 1
      UNION ALL SELECT 'intervals', count(*)::VARCHAR FROM intervals UNION ALL SELECT 'tickers', count(DISTINCT ticker)::VARCHAR FROM intervals UNION ALL SELECT 'open', (count(*) FILTER ("end" IS NULL))::VARCHAR FROM intervals UNION ALL SELECT 'first start', min("start")::VARCHAR FROM intervals""",
    "daily_vwap": "SELECT * FROM daily",
    "clean_prices": "SELECT * FROM clean3 WHERE ticker NOT IN (SELECT ticker FROM corrupt)",
    "clean_log": """SELECT ticker, 'reused' AS rule, count(*) AS days_dropped FROM daily WHERE ticker NOT IN (SELECT ticker FROM clean1) GROUP BY 1 UNION ALL SELECT ticker, 'glitch', count(*) FROM clean2 WHERE spike GROUP BY 1
      UNION ALL SELECT ticker, 'corrupt', count(*) FROM clean3 WHERE ticker IN (SELECT ticker FROM corrupt) GROUP BY 1""",
    "monthly_prices": "SELECT * FROM mpx",
    "monthly_returns": f"SELECT month, ticker, t, t_exec, px_me, px_exec, {_round('ret_cal ret_fwd')}, partial FROM monthly",
    "daily_returns": f"SELECT date, ticker, {_round('ret')} FROM dret",
    "price_coverage": "SELECT * FROM coverage",
    "price_gaps": """SELECT ticker, count(*) AS months_missing, min(month) AS first, max(month) AS last FROM panel LEFT JOIN (SELECT month, ticker, 1 AS p FROM monthly) USING (month, ticker) WHERE p IS NULL AND month <= (SELECT max(month) FROM monthly WHERE ret_fwd IS NOT NULL) GROUP BY 1""",
    "month_end_returns": f"SELECT ticker, month, {_round('ret')} FROM mret",
    "source_conflicts": """SELECT ticker, month, round(a.ret, 6) AS ret_a, round(b.ret, 6) AS ret_b, round(abs(a.ret - b.ret), 6) AS diff, abs(a.ret - b.ret) > 0.2 AS conflict FROM mret a JOIN
      (SELECT ticker, month, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY month), 0) - 1 AS ret FROM (SELECT ticker, last_day(date) AS month, arg_max(adj_close, date) AS px FROM second GROUP BY 1, 2)) b USING (ticker, month) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL""",
    "merged_sources": """SELECT *, 'ours' AS source FROM daily WHERE substr(ticker, 2)::BIGINT % 6 <> 0 AND ticker NOT IN (SELECT ticker FROM conflicts) UNION ALL SELECT *, 'theirs' FROM second WHERE ticker IN (SELECT ticker FROM conflicts) OR substr(ticker, 2)::BIGINT % 6 = 0""",
    "removed_names": "SELECT * FROM removed",
    "price_levels": """SELECT ticker, round(median(level), 9) AS level, round(min(level), 9) AS level_min, round(max(level), 9) AS level_max, count(*) AS n_levels FROM (
      SELECT q.ticker, px.close * n * coalesce((SELECT product(s.ratio) FROM splits s WHERE s.ticker = q.ticker AND s.date > q.cfiled), 1) / public_float AS level FROM (
        SELECT x.*, e.ticker FROM (SELECT f.cik, f.float_date, f.public_float, cd, cfiled, n, row_number() OVER (PARTITION BY f.cik, f.float_date ORDER BY abs(date_diff('day', f.float_date, cd)), cd) AS r FROM fc_first f JOIN cv_first c USING (cik) WHERE abs(date_diff('day', f.float_date, cd)) <= 200) x
        JOIN eras e ON e.cik = x.cik AND e.month = last_day(x.float_date) JOIN (SELECT * FROM members WHERE "end" IS NOT NULL) m ON m.ticker = e.ticker AND x.float_date BETWEEN m."start" AND m."end" WHERE r = 1) q
      JOIN LATERAL (SELECT arg_max(d.close, d.date) AS close FROM daily d WHERE d.ticker = q.ticker AND d.date BETWEEN q.float_date - 40 AND q.float_date) px ON px.close IS NOT NULL) GROUP BY 1""",
    "first_filings": "SELECT * FROM ff",
    "preferred_tags": """SELECT concept, tag, cik, adsh, ddate, qtrs, value, filed, form, fy FROM (SELECT f.*, row_number() OVER (PARTITION BY adsh, f.concept, ddate, qtrs ORDER BY p, value DESC) AS r FROM filings f JOIN
      (VALUES ('c1', 'Tag0', 0), ('c1', 'Tag1', 1), ('c2', 'Tag1', 0), ('c2', 'Tag2', 1), ('c3', 'Tag2', 0), ('c3', 'Tag0', 1)) v(concept, tag, p) ON f.concept = v.concept AND f.tag = v.tag) WHERE r = 1""",
    "facts_known": """SELECT p.month, p.ticker, p.cik, v.value, v.period_end, v.available_from FROM cikm p ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, available_from ORDER BY period_end DESC, value DESC) AS r FROM
      (SELECT cik, value, ddate AS period_end, (filed + 1)::DATE AS available_from FROM (SELECT *, max(ddate) OVER (PARTITION BY cik ORDER BY filed, ddate ROWS UNBOUNDED PRECEDING) AS newest FROM ff WHERE concept = 'c1') WHERE ddate >= newest)) WHERE r = 1) v ON p.cik = v.cik AND p.month >= v.available_from""",
    "trailing_year": """SELECT p.cik, p.concept, p.ddate, greatest(p.filed, y.filed, a.filed) AS filed, round(p.value + y.value - a.value, 2) AS value, 'rolled' AS source FROM tq p JOIN tq y ON y.cik = p.cik AND y.qtrs = 4 AND y.ddate = last_day((p.ddate - to_months(3 * p.qtrs))::DATE)
      JOIN tq a ON a.cik = p.cik AND a.qtrs = p.qtrs AND a.ddate = last_day((p.ddate - INTERVAL 12 MONTH)::DATE) WHERE p.qtrs < 4 UNION ALL SELECT cik, concept, ddate, filed, round(value, 2), 'annual' FROM tq WHERE qtrs = 4""",
    "panel_long": "SELECT * FROM longp",
    "panel_wide": "SELECT * FROM wide",
    "fundamental_signals": " UNION ALL ".join(f"SELECT '{n}' AS signal, month, ticker, round({c}, 9) AS value FROM fund WHERE {c} IS NOT NULL" for n, c in _CONDITIONS.items())
    + " UNION ALL SELECT 'asset_growth', f.month, f.ticker, round(-(f.assets / nullif(a.assets, 0) - 1), 9) FROM fund f JOIN fund a ON a.ticker = f.ticker AND f.month = last_day((a.month + INTERVAL 12 MONTH)::DATE) WHERE f.assets / nullif(a.assets, 0) IS NOT NULL",
    "split_factors": """SELECT m.ticker, m."start", coalesce(product(ratio), 1)::DOUBLE AS split_factor FROM members m LEFT JOIN splits s ON s.ticker = m.ticker AND s.date > m."start" GROUP BY 1, 2""",
    "share_crosscheck": """SELECT ticker, shares, cap, their_shares, their_cap, round(shares / their_shares, 6) AS ratio, round(cap / their_cap, 6) AS cap_ratio, coalesce(NOT (shares / their_shares BETWEEN 0.5 AND 2.0), true) AS flag FROM
      (SELECT ticker, 100.0::DOUBLE + k AS shares, 1000.0::DOUBLE + k AS cap, CASE WHEN k % 7 <> 0 THEN 100.0::DOUBLE + 2 * k END AS their_shares, CASE WHEN k % 7 <> 0 THEN 900.0::DOUBLE + k END AS their_cap FROM members)""",
    "float_checks": f"SELECT ticker, cik, fy, float_date, public_float, month, close, {_round('cap ratio')}, flag, reason, window_end FROM fc",
    "float_summary": "SELECT fy, count(*) AS rows, count(ratio) AS with_ratio, count(*) FILTER (flag = 'low') AS low, count(*) FILTER (flag = 'high') AS high, " + ", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in ("float_scale", "near_split", "near_1000", "over_100x", "other")) + " FROM fc GROUP BY 1",
    "float_exclusions": """SELECT ticker, float_date AS "start", coalesce(window_end, (float_date + INTERVAL 12 MONTH)::DATE) AS "end" FROM fc WHERE flag <> '' AND reason <> 'float_scale'""",
    "bank_revenue": """SELECT b.month, b.ticker, b.sector, b.revenue_source, round(b.revenue, 2) AS revenue, round(b.revenue_ttm, 2) AS revenue_ttm, f.net_income AS net_interest_income, f.assets AS noninterest_income, f.net_income AS net_interest_income_ttm, f.cogs AS noninterest_income_ttm FROM bank b JOIN fund f USING (month, ticker)""",
    "revenue_sources": """SELECT month, count(*) AS members, count(*) FILTER (revenue_source = 'tag') AS tag, count(*) FILTER (revenue_source = 'derived_bank') AS derived, count(*) FILTER (revenue_source IS NULL) AS missing FROM panel LEFT JOIN bank USING (month, ticker) WHERE month(month) = 12 GROUP BY 1""",
    "tag_coverage": """SELECT concept, fy, n_ciks, modal_tag, round(100.0::DOUBLE * n_ciks / 1000, 2) AS pct FROM (SELECT concept, fy, count(DISTINCT cik) AS n_ciks FROM filings GROUP BY 1, 2) JOIN
      (SELECT concept, fy, tag AS modal_tag FROM (SELECT concept, fy, tag, row_number() OVER (PARTITION BY concept, fy ORDER BY count(*) DESC, tag) AS r FROM filings GROUP BY 1, 2, 3) WHERE r = 1) USING (concept, fy)""",
    "concept_coverage": "SELECT month, count(*) AS members, count(c1) AS c1, count(c2) AS c2, count(c3) AS c3, count(c4) AS c4, count(c5) AS c5 FROM panel LEFT JOIN wide USING (month, ticker) GROUP BY 1",
    "amendments": "SELECT year(filed)::INTEGER AS year, count(*) AS filings, count(*) FILTER (form LIKE '%/A') AS amended, round(100.0::DOUBLE * count(*) FILTER (form LIKE '%/A') / count(*), 2) AS pct FROM filings GROUP BY 1",
    "candidate_tags": "SELECT tag, count(DISTINCT cik) AS n_ciks, min(adsh) AS example FROM filings WHERE fy = 1997 AND cik NOT IN (SELECT cik FROM filings WHERE fy = 1997 AND concept = 'c1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    "missing_filers": "SELECT DISTINCT cik FROM filings WHERE fy = 1998 AND cik NOT IN (SELECT cik FROM filings WHERE fy = 1998 AND concept = 'c2') AND cik IN (SELECT cik FROM ciks)",
    "sic_sectors": f"SELECT *, {_SIC} AS sector FROM (SELECT p_partkey, p_partkey % 9000 + 100 AS sic FROM part)",
    "sector_agreement": """SELECT coalesce(sector, 'ALL') AS sector, count(*) AS n, count(*) FILTER (ours = theirs) AS same, round(100.0::DOUBLE * count(*) FILTER (ours = theirs) / count(*), 2) AS pct FROM
      (SELECT sector AS theirs, sector, CASE WHEN substr(ticker, 2)::BIGINT % 6 = 0 THEN 'ASIA' ELSE sector END AS ours FROM sectors) GROUP BY ROLLUP (sector)""",
    "clean_names": f"""SELECT p_partkey, {_normal('name')} AS normalised, nullif(regexp_extract(upper(brand), '^([A-Z][A-Z0-9.\\-]{{0,9}})', 1), '') AS token, replace(brand || '.B', '.', '-') AS dashed,
      CASE WHEN len({_tokens('name')}) > 0 AND len({_tokens('brand')}) > 0 THEN round(len(list_intersect({_tokens('name')}, {_tokens('brand')}))::DOUBLE / least(len({_tokens('name')}), len({_tokens('brand')})), 6) END AS overlap, regexp_matches(brand, '[A-Za-z]') AS real
      FROM (SELECT p_partkey, p_name || ' Holdings & Co. Inc' AS name, p_brand AS brand FROM part)""",
    "parsed_dates": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN ts::DATE END AS d FROM events",
    "json_numbers": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
    "page_words": f"SELECT page_id, word, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower({_markup('html')}), '([a-z][a-z''-]*[a-z]|[a-z])')) AS word FROM pages) WHERE word NOT IN ({_STOP}) GROUP BY 1, 2",
    "normal_values": f"""SELECT o_orderkey, round({normal_cdf('x')}, 9) AS below, round(q, 9) + 0.0 AS quantile FROM (SELECT o_orderkey, (o_totalprice - 150000) / 20000 AS x, (o_orderkey % 999 + 1) / 1000.0::DOUBLE AS p FROM orders)
      JOIN {quantiles('SELECT unnest(range(1, 1000)) / 1000.0::DOUBLE AS p')} USING (p)""",
    "factor_attribution": f"""SELECT unnest(['alpha', 'mkt_rf', 'smb', 'hml']) AS name, round(unnest([beta_one * 12, beta_mkt_rf, beta_smb, beta_hml]), 5) AS value, round(unnest([t_one, t_mkt_rf, t_smb, t_hml]), 5) AS t, n
      FROM ({least_squares("SELECT f.*, l.ret_gross AS y FROM ls l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)", [], ["mkt_rf", "smb", "hml"])})""",
    "unescaped_pages": f"""SELECT page_id, i, {unescape('t')} AS plain, CASE WHEN i = 0 THEN md5({unescape('html')}) END AS digest FROM
      (SELECT *, 'a&' || names[k % len(names) + 1] || 'b&' || rtrim(names[k % len(names) + 1], ';') || 'cd &#' || (k % 50000 + 161) || ';' AS t FROM (SELECT *, page_id * 10 + i AS k FROM (SELECT page_id, html, unnest(range(10)) AS i FROM pages)), (SELECT [{", ".join(f"'{n}'" for n in sorted(html5))}] AS names))""",
    "document_words": "SELECT * FROM words",
    "filing_pairs": "SELECT * FROM pairs",
    "filing_similarity": "SELECT cik, adsh, period, filed, prev_adsh, prev_period, cosine, jaccard, length_a, length_b FROM sims",
    "text_signal": """SELECT p.month, p.ticker, v.value FROM (SELECT month, cik, cik AS ticker FROM months, (SELECT DISTINCT cik FROM docidx)) p ASOF JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, available_from ORDER BY period_end DESC, value DESC) AS r FROM
      (SELECT cik, cosine AS value, period AS period_end, (filed + 1)::DATE AS available_from FROM (SELECT *, max(period) OVER (PARTITION BY cik ORDER BY filed, period ROWS UNBOUNDED PRECEDING) AS newest FROM sims) WHERE period >= newest)) WHERE r = 1) v
      ON p.cik = v.cik AND p.month >= v.available_from WHERE v.period_end >= (p.month - INTERVAL 18 MONTH)::DATE""",
    "text_coverage": """SELECT year(d.filed)::INTEGER AS year, count(*) AS filings, count(length) AS fetched, count(*) FILTER (length >= 20) AS long_enough, median(length)::DOUBLE AS median_words, count(s.adsh) AS paired
      FROM docidx d LEFT JOIN (SELECT doc, sum(n)::BIGINT AS length FROM words GROUP BY 1) w ON w.doc = d.adsh LEFT JOIN sims s ON s.adsh = d.adsh GROUP BY 1""",
    "momentum": f"SELECT month, ticker, {_round('value')} FROM mom",
    "volatility": """SELECT month, ticker, round(-sqrt(252) * sd, 6) AS value FROM (SELECT ticker, date, stddev_samp(ret) OVER w AS sd, count(ret) OVER w AS n FROM dret WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)) JOIN mends ON date = t WHERE n >= 48""",
    "market_beta": """SELECT month, ticker, round(-c / nullif(v, 0), 6) AS value FROM (SELECT r.ticker, r.date, covar_samp(ret, mkt) OVER w AS c, var_samp(mkt) OVER w AS v, count(*) OVER w AS n FROM dret9 r JOIN (SELECT date, round(avg(ret), 9) AS mkt FROM dret9 GROUP BY 1) m USING (date)
      WINDOW w AS (PARTITION BY r.ticker ORDER BY r.date ROWS 59 PRECEDING)) JOIN mends ON date = t WHERE n >= 48 AND c / nullif(v, 0) IS NOT NULL""",
    "winsorised": "SELECT m.month, m.ticker, round(greatest(lo, least(hi, value)), 6) AS value FROM mom m JOIN (SELECT month, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM mom GROUP BY 1) q USING (month)",
    "sector_scores": f"SELECT month, ticker, {_round('z')} FROM z",
    "composite_scores": """SELECT month, ticker, round((v - mu) / sd, 6) AS z FROM (SELECT month, ticker, v, avg(v) OVER a AS mu, stddev_samp(v) OVER a AS sd FROM (SELECT z.month, z.ticker, (z.z + rz.z) / 2 AS v FROM z JOIN rz USING (month, ticker)) WINDOW a AS (PARTITION BY month)) WHERE sd > 0""",
    "forward_returns": f"SELECT month, ticker, horizon, {_round('ret')} FROM fwd",
    "deciles": "SELECT month, ticker, decile FROM deciles_all",
    "equal_weights": "SELECT month, ticker, decile, round(1.0::DOUBLE / count(*) OVER (PARTITION BY month, decile), 6) AS w FROM deciles_all",
    "cap_weights": "SELECT d.month, d.ticker, decile, round(cap / sum(cap) OVER (PARTITION BY d.month, decile), 6) AS w FROM deciles_all d JOIN caps USING (month, ticker) WHERE cap > 0",
    "backtest_monthly": f"SELECT month, decile, n, {_round('ret_gross turnover ret_net')} FROM bt_ew1",
    "backtest_held": f"SELECT month, decile, n, {_round('ret_gross turnover ret_net')} FROM bt_ew3",
    "backtest_cap_weighted": f"SELECT month, decile, n, {_round('ret_gross turnover ret_net')} FROM bt_cw1",
    "long_short": f"SELECT month, {_round('ret_gross turnover ret_net')} FROM ls",
    "hedged_spread": """SELECT month, round(ret_gross, 6) AS ret_gross, round(b, 6) AS beta, round(ret_gross - b * mkt_rf, 6) AS hedged FROM (SELECT *, CASE WHEN count(mkt_rf) OVER w >= 24 THEN regr_slope(ret_gross, mkt_rf) OVER w END AS b FROM
      (SELECT l.month, ret_gross, f.mkt_rf FROM ls l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)) WINDOW w AS (ORDER BY month ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)) WHERE b IS NOT NULL""",
    "benchmark_fit": "SELECT count(*) AS n, round(corr(ret_gross, mkt_rf), 6) AS corr FROM ls l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)",
    "odd_months": """SELECT decile, month, round(x, 6) AS ret_gross, round(z, 6) AS z FROM (SELECT *, (x - s / n) / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0) AS z FROM (SELECT decile, month, x, count(*) OVER w - 1 AS n, sum(x) OVER w - x AS s, sum(x * x) OVER w - x * x AS q FROM
      (SELECT decile, month, round(ret_gross, 9) AS x FROM bt_ew1) WINDOW w AS (PARTITION BY decile)) WHERE n >= 3) WHERE abs(z) > 2""",
    "rank_ic": f"SELECT month, {_round('ic')}, n FROM ic",
    "rank_ic_summary": "SELECT count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, round(avg(x) / stddev_samp(x) * sqrt(12), 6) AS ir FROM (SELECT round(ic, 9) AS x FROM ic)",
    "rank_ic_decay": """SELECT horizon, round(avg(ic), 6) AS ic, count(ic) AS months FROM (SELECT horizon, month, corr(a, b) AS ic FROM (SELECT month, horizon, rank() OVER (PARTITION BY month, horizon ORDER BY z) + (count(*) OVER (PARTITION BY month, horizon, z) - 1) / 2 AS a,
      rank() OVER (PARTITION BY month, horizon ORDER BY ret) + (count(*) OVER (PARTITION BY month, horizon, ret) - 1) / 2 AS b FROM (SELECT z.month, z.ticker, z, horizon, ret FROM z JOIN fwd USING (month, ticker))) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1""",
    "average_ranks": "SELECT month, ticker, v, rank() OVER (PARTITION BY month ORDER BY v) + (count(*) OVER (PARTITION BY month, v) - 1) / 2 AS rank FROM (SELECT month, ticker, round(px_me, 0) AS v FROM monthly)",
    "premium_slopes": f"SELECT month, {_round('slope')}, n FROM slope",
    "premium": """SELECT n, round(m, 6) AS premium, round(sqrt(v), 6) AS se, round(m / sqrt(v), 6) AS t FROM (SELECT count(*) AS n, any_value(m) AS m, (sum(x * x) + 2 * (0.8 * sum(x * l1) + 0.6 * sum(x * l2) + 0.4 * sum(x * l3) + 0.2 * sum(x * l4))) / count(*) / count(*) AS v FROM
      (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3, lag(x, 4) OVER w AS l4 FROM (SELECT month, slope - avg(slope) OVER () AS x, avg(slope) OVER () AS m FROM slope) WINDOW w AS (ORDER BY month)))""",
    "robust_variance": """SELECT decile, count(*) AS n, round(any_value(m), 9) AS mean, round((sum(x * x) + 2 * (0.8 * sum(x * l1) + 0.6 * sum(x * l2) + 0.4 * sum(x * l3) + 0.2 * sum(x * l4))) / count(*) / count(*), 9) AS variance FROM
      (SELECT *, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3, lag(x, 4) OVER w AS l4 FROM (SELECT decile, month, round(ret_gross, 9) - avg(round(ret_gross, 9)) OVER (PARTITION BY decile) AS x, avg(round(ret_gross, 9)) OVER (PARTITION BY decile) AS m FROM bt_ew1) WINDOW w AS (PARTITION BY decile ORDER BY month)) GROUP BY 1""",
    "decile_performance": """SELECT decile, count(*) AS n, round(avg(x) * 12, 6) AS mean, round(stddev_samp(x) * sqrt(12), 6) AS sd, round(avg(x) / stddev_samp(x) * sqrt(12), 6) AS sharpe, round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 6) AS skew, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2), 6) AS kurtosis, round(min(w / top - 1), 6) AS max_drawdown FROM
      (SELECT *, max(w) OVER (PARTITION BY decile ORDER BY month) AS top FROM (SELECT decile, month, x, avg(x) OVER (PARTITION BY decile) AS m, product(1 + x) OVER (PARTITION BY decile ORDER BY month ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT decile, month, round(ret_net, 9) AS x FROM bt_ew1))) GROUP BY 1""",
    "cost_grid": "SELECT c::DOUBLE AS cost_bps, round(avg(ret_gross - 2 * c / 1e4 * turnover) / stddev_samp(ret_gross - 2 * c / 1e4 * turnover) * sqrt(12), 6) AS sharpe FROM ls, (SELECT unnest([0, 5, 10, 20, 50]) AS c) GROUP BY 1",
    "breakeven": "SELECT round(avg(ret_gross) / (2 * avg(turnover)), 6) AS cost FROM ls",
    "recessions": """SELECT min(month) AS first, max(month) AS last FROM (SELECT month, f, sum(turn) OVER (ORDER BY month) AS run FROM (SELECT month, f, (f <> coalesce(lag(f) OVER (ORDER BY month), -1))::INTEGER AS turn FROM (SELECT month, (mkt_rf > 0)::INTEGER AS f FROM factors))) WHERE f = 1 GROUP BY run""",
    "rank_terciles": "SELECT month, ticker, least(floor((rank() OVER (PARTITION BY month ORDER BY z) + (count(*) OVER (PARTITION BY month, z) - 1) / 2 - 0.5::DOUBLE) / count(*) OVER (PARTITION BY month) * 3)::INTEGER + 1, 3)::INTEGER AS tercile FROM z",
    "score_coverage": "SELECT round(median(s), 6) AS coverage FROM (SELECT month, count(z)::DOUBLE / count(*) AS s FROM panel LEFT JOIN z USING (month, ticker) GROUP BY 1)",
    "fit_by_years": """SELECT block, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(ret_gross, mkt_rf), 6) END AS corr FROM ls l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)
      JOIN (VALUES ('all', 0, 9999), ('1995-1996', 1995, 1996), ('1997-1998', 1997, 1998), ('1999-2001', 1999, 2001)) b(block, a, z) ON year(f.month) BETWEEN a AND z WHERE ret_gross IS NOT NULL AND mkt_rf IS NOT NULL GROUP BY 1""",
    "sharpe_by_coverage": """SELECT months, count(ret_net) AS n, round(CASE WHEN stddev_samp(ret_net) > 0 THEN avg(ret_net) / stddev_samp(ret_net) * sqrt(12) END, 6) AS sharpe FROM
      (SELECT 'all' AS months, ret_net FROM ls UNION ALL SELECT 'covered', ret_net FROM ls SEMI JOIN (SELECT month FROM coverage WHERE gap_pct <= 15) USING (month)) GROUP BY 1""",
    "near_values": "SELECT o_orderkey, abs(o_totalprice / 1000 / 200 - 1) <= 0.15 AS near, NOT (o_totalprice / 1000 BETWEEN 50 AND 300) AS outside FROM orders",
    "spec_rows": """SELECT "timestamp", factor, kind, sector_neutral, variant, spec_key, note FROM speclog""",
    "spec_counts": "SELECT coalesce(kind, 'all') AS kind, count(*) AS rows, count(DISTINCT spec_key) AS trials FROM speclog GROUP BY ROLLUP (kind)",
    "spec_latest": """SELECT spec_key, max("timestamp") AS "timestamp", min("timestamp") AS first_seen FROM speclog GROUP BY 1""",
    "spec_variance": """SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(var_samp(sharpe / sqrt(12)), 2) AS variance FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec_key ORDER BY "timestamp" DESC) AS r FROM speclog) WHERE r = 1) GROUP BY ROLLUP (kind)""",
    "spec_status": """SELECT "timestamp", factor, CASE WHEN factor NOT IN ('f0', 'f1', 'f2') THEN 'abandoned' WHEN "timestamp" < max("timestamp") OVER (PARTITION BY factor, signal, note LIKE '%no-sector%') THEN 'superseded' ELSE 'current' END AS status FROM speclog""",
    "next_change": """SELECT m.ticker, m."end" AS at, (SELECT min(s."start") FROM members s WHERE s."start" > m."end") AS "when" FROM members m WHERE m."end" IS NOT NULL""",
    "last_print": """SELECT m.ticker, m."end", d.date, d.close FROM (SELECT * FROM members WHERE "end" IS NOT NULL) m ASOF LEFT JOIN daily d ON m.ticker = d.ticker AND m."end" >= d.date""",
    "build_differences": "SELECT 'rows only in a' AS what, count(*) AS n FROM daily WHERE substr(ticker, 2)::BIGINT % 5 = 0 UNION ALL SELECT 'values of close', count(*) FROM daily WHERE substr(ticker, 2)::BIGINT % 7 = 0 AND substr(ticker, 2)::BIGINT % 5 <> 0",
    "quality_checks": """SELECT 'universe_count_in_range' AS "check", bool_and(n BETWEEN 1 AND 10000) AS passed, min(n)::DOUBLE AS value FROM (SELECT month, count(DISTINCT ticker) AS n FROM months LEFT JOIN panel USING (month) WHERE month BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1)
      UNION ALL SELECT 'recent_price_gap_is_small', max(gap_pct) <= 15, max(gap_pct) FROM (SELECT gap_pct FROM coverage ORDER BY month DESC LIMIT 12)""",
    "missing_classes": """SELECT m.month, count(c) FILTER (c = 'no_xbrl') AS no_xbrl, count(c) FILTER (c = 'map_wrong') AS map_wrong, count(c) FILTER (c = 'foreign_filer') AS foreign_filer, count(c) FILTER (c = 'other') AS other FROM (SELECT DISTINCT month FROM panel WHERE month(month) = 12) m LEFT JOIN
      (SELECT p.month, ['no_xbrl', 'map_wrong', 'foreign_filer', 'other'][(substr(p.ticker, 2)::BIGINT % 4 + 1)::INTEGER] AS c FROM panel p LEFT JOIN wide w USING (month, ticker) WHERE w.c1 IS NULL) x USING (month) GROUP BY 1""",
    "coverage_figures": """SELECT round(100.0::DOUBLE * (sum(members) - sum(priced)) / sum(members), 2) AS gap_pct, round(100 - round(100.0::DOUBLE * (sum(members) - sum(priced)) / sum(members), 2), 2) AS covered_pct, count(*) FILTER (gap_pct <= 15) AS good_months, min(month) FILTER (gap_pct <= 15) AS first_good FROM coverage""",
    "gap_by_year": "SELECT year(month)::INTEGER AS year, max(month) AS month, arg_max(gap_pct, month) AS gap_pct FROM coverage GROUP BY 1",
}

VIEWS["mpxc"] = VIEWS["mpx"].replace("FROM daily", "FROM cut").replace("JOIN reb", "JOIN rebc")
VIEWS["mendsc"] = VIEWS["mends"].replace("daily", "cut")
VIEWS["calc"] = VIEWS["cal"].replace("daily", "cut")
VIEWS["rebc"] = VIEWS["reb"].replace("FROM mends JOIN cal", "FROM mendsc JOIN calc")
VIEWS["monthlyc"] = VIEWS["monthly"].replace("mpx", "mpxc").replace("FROM reb)", "FROM rebc)").replace("JOIN daily d", "JOIN cut d")
_BODIES["terminal_returns"] = """SELECT m.month, m.ticker, t, t_exec, px_me, px_exec, round(ret_cal, 6) AS ret_cal, round(CASE WHEN hit THEN CASE class WHEN 'acquired' THEN 0.0 ELSE -0.3 END ELSE ret_fwd END, 6) AS ret_fwd, partial, hit AS terminal FROM
  (SELECT m.*, class, ret_fwd IS NULL AND m.month = max(m.month) OVER (PARTITION BY m.ticker) AND class IS NOT NULL AS hit FROM monthlyc m LEFT JOIN removed r ON r.ticker = m.ticker) m"""
_BODIES["identity_flags"] = f"""WITH q AS (SELECT ticker, k, security, "start", "end", k % 5 <> 0 AS quoted, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 4 = 1 THEN 'Another Company Inc' ELSE security || ' Corp' END END AS qn, CASE WHEN k % 3 = 1 THEN 'PNK' ELSE 'NYQ' END AS ex, CASE WHEN k % 7 = 2 THEN 'EUR' ELSE 'USD' END AS cur,
    CASE WHEN k % 11 = 0 THEN 'ETF' ELSE 'EQUITY' END AS qt, CASE WHEN k % 2 = 0 THEN (k % 30)::DOUBLE END AS level, CASE WHEN k % 2 = 0 THEN 1::BIGINT END AS n_levels, coalesce(k % 2 = 0 AND k % 30 BETWEEN 0.5 AND 20, false) AS in_band FROM members WHERE "end" IS NOT NULL),
  n AS (SELECT ticker, unnest(list_distinct([security] || coalesce((SELECT list(c_name) FROM customer JOIN ciks ON c_custkey = cik WHERE ciks.ticker = q.ticker), []))) AS name FROM q),
  o AS (SELECT q.ticker, max(CASE WHEN len({_tokens('name')}) > 0 AND len({_tokens('qn')}) > 0 THEN len(list_intersect({_tokens('name')}, {_tokens('qn')}))::DOUBLE / least(len({_tokens('name')}), len({_tokens('qn')})) END) AS overlap FROM q JOIN n USING (ticker) GROUP BY 1),
  f AS (SELECT ticker, min(date) AS first_price FROM daily GROUP BY 1),
  x AS (SELECT q.*, overlap, first_price, coalesce(overlap >= 0.5, false) AS ok FROM q LEFT JOIN o USING (ticker) LEFT JOIN f USING (ticker)),
  y AS (SELECT *, list_filter([CASE WHEN NOT quoted THEN 'no_info' END, CASE WHEN quoted AND overlap IS NOT NULL AND NOT ok THEN printf('name overlap %.2f', overlap) END, CASE WHEN quoted AND cur <> 'USD' THEN 'currency ' || cur END, CASE WHEN quoted AND ex = 'PNK' AND NOT ok THEN 'exchange ' || ex END,
    CASE WHEN quoted AND qt <> 'EQUITY' THEN 'quote type ' || qt END, CASE WHEN level IS NOT NULL AND NOT in_band THEN 'price level outside [0.5, 20]' END,
    CASE WHEN first_price > (greatest("start", DATE '1996-01-01') + INTERVAL 24 MONTH)::DATE AND first_price <= "end" AND NOT in_band THEN 'first price ' || first_price || ' is late' END], lambda r: r IS NOT NULL) AS reasons FROM x)
  SELECT ticker, security AS own_name, round(overlap, 6) AS overlap, first_price, "start" AS member_start, "end" AS member_end, level, len(list_filter(reasons, lambda r: r <> 'no_info')) > 0 AS flag, array_to_string(reasons, '; ') AS reason FROM y"""
VIEWS["conflicts"] = """SELECT DISTINCT ticker FROM (SELECT ticker, month, a.ret AS x, b.ret AS y FROM (SELECT * FROM mret WHERE substr(ticker, 2)::BIGINT % 6 <> 0) a JOIN
  (SELECT ticker, month, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY month), 0) - 1 AS ret FROM (SELECT ticker, last_day(date) AS month, arg_max(adj_close, date) AS px FROM second GROUP BY 1, 2)) b USING (ticker, month)) WHERE abs(x - y) > 0.5"""
VIEWS["tq"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, ddate, qtrs ORDER BY filed, adsh, tag, value DESC) AS r FROM (SELECT * REPLACE (cik % 20 AS cik, 'c' AS concept) FROM filings WHERE qtrs > 0)) WHERE r = 1"

ORACLES: dict[str, str] = {name: _sql(body) for name, body in _BODIES.items()}
ORACLES["share_counts"] = _resolved(False, f"SELECT month, ticker, {_round('n_shares n_basis')}, shares_source, shares_filed, split_factor, implausible FROM resolved")
ORACLES["share_counts_pinned"] = _resolved(True, f"SELECT month, ticker, {_round('n_shares n_basis')}, shares_source, shares_filed, split_factor, implausible FROM resolved")
ORACLES["market_caps"] = _resolved(False, f"SELECT month, ticker, round(n_basis * px_me, 4) AS cap, shares_source, split_factor FROM resolved JOIN ({_PX}) USING (month, ticker) WHERE NOT implausible AND n_basis > 0 AND px_me > 0")

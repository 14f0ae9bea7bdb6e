"""Operators against numbers worked out by hand."""

import math
import random
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.config import Config, load
from ledgerline.functions import names, normal, references, words
from ledgerline.functions.dates import month_on_or_before, parse_date
from ledgerline.operators import audit, facts, intervals, portfolio, prices, shares, signals, speclog, stats, textsim, universe
from ledgerline.operators.asof import asof_backward, asof_forward, assert_point_in_time, first_filed, known_by
from ledgerline.plans import sqlview
from ledgerline.sources import files

D = date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_config(tmp_path):
    assert Config().hash == Config().hash != Config(lag_days=2).hash
    for bad in ({"weighting": "x"}, {"winsor": (0.9, 0.1)}, {"lag_days": 0}, {"start": D(2010, 1, 1)}, {"cost_bps": -1}, {"text_measure": "bm25"}):
        with pytest.raises(ValueError):
            Config(**bad)
    (tmp_path / "c.toml").write_text("lag_days = 3\nwinsor = [0.05, 0.95]\n")
    assert load(tmp_path / "c.toml").lag_days == 3
    (tmp_path / "c.toml").write_text("lag = 3\n")
    with pytest.raises(ValueError):
        load(tmp_path / "c.toml")


def test_values_are_known_only_after_filing(spark):
    values = spark.createDataFrame([(1, D(2019, 12, 31), D(2020, 1, 31), 10.0), (1, D(2020, 3, 31), D(2020, 3, 20), 20.0), (1, D(2019, 12, 31), D(2020, 4, 10), 99.0)], "cik long, ddate date, filed date, value double")
    months = spark.createDataFrame([(D(2020, m, d), 1) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))], "month date, cik long")
    got = {r["month"]: r["value"] for r in known_by(months, values, 1).collect()}
    assert got == {D(2020, 1, 31): None, D(2020, 2, 29): 10.0, D(2020, 3, 31): 20.0, D(2020, 4, 30): 20.0}
    with pytest.raises(Exception, match="not known yet"):
        assert_point_in_time(spark.createDataFrame([(D(2020, 1, 31), D(2020, 2, 1))], "month date, available_from date")).collect()


def test_first_filed_and_asof(spark):
    f = spark.createDataFrame([(1, "c", D(2020, 1, 1), 0, "b", D(2020, 2, 1), 5.0), (1, "c", D(2020, 1, 1), 0, "a", D(2020, 2, 1), 4.0), (1, "c", D(2020, 1, 1), 0, "0", D(2020, 3, 1), 9.0)], "cik long, concept string, ddate date, qtrs int, adsh string, filed date, value double")
    assert [r["value"] for r in first_filed(f).collect()] == [4.0]
    left = spark.createDataFrame([("k", 1), ("k", 2), ("k", 9), ("m", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "k string, u int, v string")
    assert {tuple(r) for r in asof_backward(left, right, ["k"], "t", "u", ["v"]).collect()} == {("k", 1, None), ("k", 2, "x"), ("k", 9, "y"), ("m", 5, None)}
    assert {tuple(r) for r in asof_forward(left, right, ["k"], "t", "u", ["v"]).collect()} == {("k", 1, "x"), ("k", 2, "y"), ("k", 9, None), ("m", 5, None)}


def test_trailing_year(spark):
    f = [(1, "c", D(2020, 3, 31), 1, "a", D(2020, 4, 20), 30.0), (1, "c", D(2019, 12, 31), 4, "b", D(2020, 2, 1), 100.0), (1, "c", D(2019, 3, 31), 1, "c", D(2019, 4, 20), 20.0), (1, "c", D(2020, 6, 30), 2, "d", D(2020, 7, 20), 70.0)]
    df = spark.createDataFrame(f, "cik long, concept string, ddate date, qtrs int, adsh string, filed date, value double")
    assert rows(facts.trailing_year(df).select("ddate", "filed", "value", "source")) == [(D(2019, 12, 31), D(2020, 2, 1), 100.0, "annual"), (D(2020, 3, 31), D(2020, 4, 20), 110.0, "rolled")]


def slow_backtest(z, rets, n, k, cost):
    """Month by month, holding weights in dictionaries."""
    months = sorted({m for m, _, _ in z})
    held, out, j = {}, {}, 0
    for m in months:
        names_ = sorted((x, t) for mm, t, x in z if mm == m)
        r = {t: v for mm, t, v in rets if mm == m}
        turned = dict.fromkeys(range(1, n + 1), 0.0)
        if j % k == 0:
            new = {d: {} for d in range(1, n + 1)}
            for i, (_, t) in enumerate(names_):
                new[i * n // len(names_) + 1][t] = 0
            for d, w in new.items():
                w.update({t: 1 / len(w) for t in w})
                old = held.get(d, {})
                turned[d] = sum(abs(w.get(t, 0) - old.get(t, 0)) for t in {*w, *old}) / 2
            held = new
        for d, w in held.items():
            priced = {t: x for t, x in w.items() if r.get(t) is not None}
            gross = sum(x * r[t] for t, x in priced.items()) / sum(priced.values()) if priced else 0.0
            out[m, d] = (gross, turned[d], gross - 2 * cost * turned[d])
            grown = {t: x * (1 + (r.get(t) or 0)) for t, x in w.items()}
            held[d] = {t: x / sum(grown.values()) for t, x in grown.items()} if sum(grown.values()) > 0 else w
        j += 1
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_backtest_equals_a_walk(spark, k):
    dice = random.Random(k)
    months = [D(2020, m, 28) for m in range(1, 11)]
    z = [(m, f"t{i}", dice.gauss(0, 1)) for m in months for i in range(9) if dice.random() < 0.9]
    rets = [(m, f"t{i}", None if dice.random() < 0.15 else dice.gauss(0, 0.1)) for m in months for i in range(9)]
    got = portfolio.backtest(spark.createDataFrame(z, "month date, ticker string, z double"), spark.createDataFrame(rets, "month date, ticker string, ret_fwd double"), 3, 0.001, k)
    want = slow_backtest(z, rets, 3, k, 0.001)
    have = {(r["month"], r["decile"]): (r["ret_gross"], r["turnover"], r["ret_net"]) for r in got.collect()}
    assert set(have) == set(want)
    for key in want:
        assert have[key] == pytest.approx(want[key])


def test_deciles_weights_drift(spark):
    z = spark.createDataFrame([(D(2020, 1, 31), f"t{i:02}", float(i)) for i in range(13)], "month date, ticker string, z double")
    assert [r["decile"] for r in portfolio.assign_deciles(z, 10).orderBy("z").collect()] == [1, 1, 2, 3, 4, 4, 5, 6, 7, 7, 8, 9, 10]
    dec = spark.createDataFrame([(D(2020, 1, 31), t, d) for t, d in (("a", 1), ("b", 1), ("c", 2), ("d", 2))], "month date, ticker string, decile int")
    caps = spark.createDataFrame([(D(2020, 1, 31), t, c) for t, c in (("a", 1.0), ("b", 3.0), ("c", 1.0), ("d", 3.0))], "month date, ticker string, cap double")
    assert [r["w"] for r in portfolio.weights(dec, caps).orderBy("ticker").collect()] == [0.25, 0.75, 0.25, 0.75]
    held = portfolio.weights(dec).join(spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", None), ("d", 0.0)], "ticker string, ret double"), "ticker")
    assert [round(r["w"], 6) for r in portfolio.drift(held).orderBy("ticker").collect()] == [0.666667, 0.333333, 0.5, 0.5]


def test_planted_slope_and_ic(spark):
    rng = np.random.default_rng(7)
    data = [(D(2000 + m // 12, m % 12 + 1, 28), f"t{i}", float(x), float(0.01 * x + 0.001 * e)) for m in range(12) for i, (x, e) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(data, "month date, ticker string, z double, ret_fwd double")
    z, r = df.select("month", "ticker", "z"), df.select("month", "ticker", "ret_fwd")
    fm = stats.fama_macbeth(z, r, 2).first()
    assert fm["n"] == 12 and fm["premium"] == pytest.approx(0.01, abs=2e-4) and fm["t"] > 50
    assert stats.mean_t(stats.ic_series(z, r), "ic").first()["mean"] > 0.95


def test_average_ranks_make_spearman(spark):
    df = spark.createDataFrame([(D(2020, 1, 31), f"t{i}", float(x), float(y)) for i, (x, y) in enumerate([(1, 2), (1, 1), (2, 2), (3, 5), (4, 4), (5, 9), (6, 7), (7, 7), (8, 8), (9, 1)])], "month date, ticker string, z double, ret_fwd double")
    a, b = np.array([1.5, 1.5, 3, 4, 5, 6, 7, 8, 9, 10]), np.array([3.5, 1.5, 3.5, 6, 5, 10, 7.5, 7.5, 9, 1.5])
    assert stats.ic_series(df.select("month", "ticker", "z"), df.select("month", "ticker", "ret_fwd")).first()["ic"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_attribution_and_robust_errors(spark):
    rng = np.random.default_rng(3)
    n = 120
    x, e = rng.normal(size=(n, 2)), rng.normal(size=n) * 0.1
    y = 0.002 + 0.5 * x[:, 0] - 0.3 * x[:, 1] + e
    months = [D(2000 + i // 12, i % 12 + 1, 1) for i in range(n + 1)]
    last = spark.createDataFrame([(m, i) for i, m in enumerate(months)], "d date, i int").select(F.last_day("d").alias("month"), "i")
    ls = last.where("i < 120").join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, ret_gross double"), "i").drop("i")
    fac = last.where("i > 0").join(spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, mkt_rf double, hml double"), "i").drop("i")
    flat = ls.withColumn("name", F.lit(None).cast("string"))
    several = flat.unionByName(ls.selectExpr("month", "2 * ret_gross AS ret_gross", "'twice' AS name")).unionByName(flat.limit(3).withColumn("name", F.lit("short"))).unionByName(ls.selectExpr("month", "CASE WHEN month < '2005-01-01' THEN ret_gross END AS ret_gross", "'half' AS name"))
    fits = {r["name"]: r for r in stats.attribution(several, fac, ["mkt_rf", "hml"], ["name"], lags=2).collect()}
    got = fits[None]
    assert fits["short"]["n"] == 3 and fits["short"]["alpha"] is None and fits["half"]["n"] == 60
    assert fits["twice"]["beta_hml"] == pytest.approx(2 * got["beta_hml"]) and fits["twice"]["t_hml"] == pytest.approx(got["t_hml"])
    dependent = stats.attribution(ls, fac.withColumn("smb", 2 * F.col("hml")), ["hml", "smb"]).first()
    assert dependent["beta_hml"] is None and dependent["n"] == n
    X = np.column_stack([np.ones(n), x])
    b = np.linalg.solve(X.T @ X, X.T @ y)
    s = X * (y - X @ b)[:, None]
    meat = s.T @ s
    for m in (1, 2):
        meat += (1 - m / 3) * (s[m:].T @ s[:-m] + s[:-m].T @ s[m:])
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X) @ meat @ np.linalg.inv(X.T @ X)))
    assert got["n"] == n and got["beta_mkt_rf"] == pytest.approx(b[1]) and got["t_hml"] == pytest.approx(b[2] / se[2]) and got["alpha"] == pytest.approx(12 * b[0]) and got["t_alpha"] == pytest.approx(b[0] / se[0])
    assert got["r2"] == pytest.approx(1 - (y - X @ b).var() / y.var())
    assert stats.attribution(ls, fac, ["mkt_rf", "hml"], lags=2).first()["t_hml"] == pytest.approx(got["t_hml"])
    nw = stats.newey_west(spark.createDataFrame([(m, float(v)) for m, v in zip(months, y)], "month date, v double"), "v", 3).first()
    c = y - y.mean()
    want = (c @ c + 2 * sum((1 - k / 4) * (c[k:] @ c[:-k]) for k in (1, 2, 3))) / n / n
    assert nw["variance"] == pytest.approx(want)


def test_scalar_statistics():
    assert stats.half_life([(h, 0.05 * math.exp(-h / 4)) for h in (1, 2, 3, 6, 12)]) == pytest.approx(4 * math.log(2), rel=1e-3)
    assert math.isnan(stats.half_life([(h, 0.01 * h) for h in (1, 2, 3, 6, 12)]))


def test_normal_distribution_and_deflated_sharpe(spark):
    exact = NormalDist()
    xs = [0.0, 1e-9, -0.5, 1.0, 2.999, 3.0, 3.001, -3.001, 5.0, -5.0, -8.0, 8.0, -12.0, -30.0]
    ps = [1e-12, 1e-6, 0.001, 0.1, 0.4999, 0.5, 0.5001, 0.9, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(normal.cdf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(-x / math.sqrt(2)) / 2 for x in xs], rel=1e-12, abs=0)
    inv = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(normal.inverse_cdf(F.col("p"))).collect()]
    assert inv == pytest.approx([exact.inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (None,), (1.5,)], "p double").select(normal.inverse_cdf(F.col("p"))).collect()] == [-math.inf, math.inf, None, None]
    cases = [(0.2, 0.01, 1, 120, 0.0, 3.0), (0.2, 0.01, 50, 120, 0.0, 3.0), (0.2, 0.01, 10, 120, -0.3, 4.0), (0.2, 0.0, 10, 120, 0.0, 3.0), (3.0, 0.01, 10, 120, 3.0, 3.0)]
    top, p = stats.deflated_sharpe(*map(F.col, "abcdef"))
    out = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, b double, c long, d long, e double, f double").orderBy("i").select(top, p).collect()
    g = 0.5772156649015329
    want = 0.1 * ((1 - g) * exact.inv_cdf(0.9) + g * exact.inv_cdf(1 - 1 / (10 * math.e)))
    assert out[0][0] == 0 and out[0][1] == pytest.approx(0.985, abs=2e-3) and out[1][1] < out[0][1] and out[3][0] == 0
    assert out[2][0] == pytest.approx(want) and out[2][1] == pytest.approx(exact.cdf((0.2 - want) * 119**0.5 / (1 + 0.3 * 0.2 + 0.75 * 0.04) ** 0.5))
    assert out[4][1] == 1.0  # moments that no series has: the spread is held above 0


def test_hedge_uses_only_the_past(spark):
    months = [D(2010 + i // 12, i % 12 + 1, 28) for i in range(41)]
    last = spark.createDataFrame([(m, i) for i, m in enumerate(months)], "d date, i int").select(F.last_day("d").alias("month"), "i")
    mkt = last.select("month", F.sin("i").alias("mkt_rf"))
    ls = last.where("i < 40").select("month", (-0.5 * F.sin(F.col("i") + 1)).alias("ret_gross"))
    got = portfolio.beta_hedge(ls, mkt).collect()
    assert len(got) == 16 and all(abs(r["hedged"]) < 1e-9 and r["beta"] == pytest.approx(-0.5) for r in got)


def test_returns_partial_and_gaps(spark):
    days = [D(2020, m, d) for m in (1, 2, 3, 4) for d in (10, 28, 29)]
    data = [("A", d, 100.0 + i) for i, d in enumerate(days)] + [("B", d, 50.0 + i) for i, d in enumerate(days[:8])]
    daily = spark.createDataFrame([(t, d, p, p, 1.0) for t, d, p in data], "ticker string, date date, close double, adj_close double, volume double")
    got = {(r["ticker"], r["month"].month): r for r in prices.monthly_returns(daily, 1, D(2020, 1, 1), D(2020, 4, 30)).collect()}
    a = got["A", 1]
    assert (a["t"], a["t_exec"], a["px_exec"]) == (D(2020, 1, 29), D(2020, 2, 10), 103.0) and a["ret_fwd"] == pytest.approx(106 / 103 - 1) and not a["partial"]
    assert got["B", 2]["ret_fwd"] == pytest.approx(57 / 56 - 1) if ("B", 2) in got and got["B", 2]["partial"] else True
    assert got["A", 4]["ret_fwd"] is None


def test_cleaning(spark):
    days = [D(2020, 1, d) for d in range(1, 11)]
    good = [("GOOD", d, 100.0) for d in days]
    spike = [("SPIKE", d, 300.0 if i == 4 else 100.0) for i, d in enumerate(days)]
    bad = [("BAD", d, 100.0 if i < 5 else 400.0) for i, d in enumerate(days)]
    late = [("REUSED", d, 1.0) for d in days]
    daily = spark.createDataFrame([(t, d, p, p, 1.0) for t, d, p in good + spike + bad + late], "ticker string, date date, close double, adj_close double, volume double")
    m = spark.createDataFrame([("GOOD", D(2000, 1, 1), None), ("SPIKE", D(2000, 1, 1), None), ("BAD", D(2000, 1, 1), None), ("REUSED", D(2000, 1, 1), D(2010, 1, 1))], "ticker string, start date, end date")
    kept, log = prices.clean_daily(daily, m)
    assert {r["ticker"]: r["n"] for r in kept.groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {"GOOD": 10, "SPIKE": 9}
    assert rows(log) == [("BAD", "corrupt", 10), ("REUSED", "reused", 10), ("SPIKE", "glitch", 1)]


def test_universe_walk(spark):
    cons = spark.createDataFrame([("A", "Alpha", D(2015, 1, 1)), ("META", "Meta", D(2013, 12, 23)), ("FOX", "Fox Corp", D(2019, 3, 19)), ("OLD", "Old Co", D(1990, 1, 1))], "ticker string, security string, date_added date")
    ch = spark.createDataFrame([
        (1, D(2013, 12, 23), "FB", "Facebook", "TER", "Teradyne"), (2, D(2019, 3, 19), "FOX", "Fox Corp", "FOX", "21st Century"), (3, D(2010, 6, 1), "FOX", "21st Century", None, None),
        (4, D(2016, 5, 1), None, None, "A", "Alpha"), (5, D(2012, 1, 1), "TER", "Teradyne", None, None), (6, D(2018, 1, 1), "LOST", "Lost", None, None),
    ], "row long, date date, added string, added_security string, removed string, removed_security string")
    got, problems, renames = universe.build_membership(cons, ch, D(2010, 1, 1))
    have = {(r["ticker"], r["start"], r["end"], r["start_source"]) for r in got.collect()}
    assert have == {
        ("META", D(2013, 12, 23), None, "changes:1:renamed_from:FB"), ("TER", D(2012, 1, 1), D(2013, 12, 22), "changes:5"), ("FOX", D(2019, 3, 19), None, "changes:2"), ("FOX", D(2010, 6, 1), D(2019, 3, 18), "changes:3"),
        ("A", D(2016, 5, 1), None, "changes:4:inferred"), ("A", D(1900, 1, 1), D(2016, 4, 30), "unknown"), ("OLD", D(1990, 1, 1), None, "constituents:date_added"),
    }
    assert {(r["row"], r["event"]) for r in problems.collect()} == {(4, "removed"), (6, "added")}
    assert rows(renames) == [("FB", "META", D(2013, 12, 23), 1)]


def test_intervals(spark):
    m = spark.createDataFrame([("A", D(2020, 1, 15), D(2020, 3, 31)), ("A", D(2020, 5, 1), None), ("B", D(2020, 2, 29), D(2020, 2, 29))], "ticker string, start date, end date")
    assert rows(intervals.members_at(m, D(2020, 2, 29))) == [("A",), ("B",)]
    assert [(r["month"].month, r["n"]) for r in intervals.monthly_counts(spark, m, D(2020, 1, 1), D(2020, 5, 31)).orderBy("month").collect()] == [(1, 1), (2, 2), (3, 1), (4, 0), (5, 1)]
    eras = spark.createDataFrame([("A", 1, None, None), ("A", 2, D(2020, 2, 1), D(2020, 3, 31))], "ticker string, cik long, start date, end date")
    assert [r["cik"] for r in intervals.era_at(eras, D(2020, 1, 1), D(2020, 4, 30)).orderBy("month").collect()] == [1, 2, 2, 1]
    twice = eras.unionByName(spark.createDataFrame([("A", 3, D(2020, 3, 1), None)], "ticker string, cik long, start date, end date"))
    with pytest.raises(Exception, match="overlapping"):
        intervals.era_at(twice, D(2020, 1, 1), D(2020, 4, 30)).collect()


def test_share_resolution(spark):
    data = [("T", D(2020, m, 28), 1e8, 1.05e8, None) for m in range(1, 6)] + [("T", D(2020, 6, 28), 1e5, 1.1e8, 1.2e8), ("T", D(2020, 7, 28), 1e5, None, None)]
    panel = spark.createDataFrame([(t, m, a, m, b, m, c, m) for t, m, a, b, c in data], "ticker string, month date, shares_cover double, shares_cover_filed date, shares double, shares_filed date, shares_wavg double, shares_wavg_filed date")
    none = spark.createDataFrame([], "ticker string, date date, ratio double")
    got = {r["month"].month: (r["shares_source"], r["implausible"]) for r in shares.resolve(panel, none).collect()}
    assert got[1] == ("cover", False) and got[6] == ("balance_sheet", False) and got[7] == ("cover", True)
    split = spark.createDataFrame([("T", D(2020, 6, 30), 2.0)], "ticker string, date date, ratio double")
    assert {r["split_factor"] for r in shares.split_factor(panel.select("ticker", "month"), split, "month").collect()} == {1.0, 2.0}


def test_names_and_words(spark):
    df = spark.createDataFrame([("The Walt Disney & Co. Holdings, Inc.", "Walt Disney"), (None, "906601")], "a string, b string")
    got = df.select(names.normalise_name("a"), names.name_overlap("a", "b"), names.is_real_name("b"), names.clean_ticker(F.lit("BRK.B (class B)"))).collect()
    assert tuple(got[0]) == ("WALT DISNEY AND", 1.0, True, "BRK.B") and tuple(got[1])[:3] == ("", None, False)
    html = "<html><head><title>x y</title></head><body><script>var a</script><ix:header>tag</ix:header><p>Net &amp; revenue was $1.2 million&nbsp;cash</p></body></html>"
    assert spark.createDataFrame([(html,)], "t string").select(words.to_words("t")).first()[0] == ["net", "revenue", "million", "cash"]
    d = spark.createDataFrame([("seen 2013-12-23 x",), ("December 3, 2013",), ("none",)], "t string").select(parse_date("t")).collect()
    assert [r[0] for r in d] == [D(2013, 12, 23), D(2013, 12, 3), None]
    m = spark.createDataFrame([(D(2020, 2, 29),), (D(2020, 3, 5),)], "d date").select(month_on_or_before("d")).collect()
    assert [r[0] for r in m] == [D(2020, 2, 29), D(2020, 2, 29)]
    assert [r[0] for r in spark.createDataFrame([(3571,), (2834,), (1,)], "s int").select(names.sic_to_sector("s")).collect()] == ["Information Technology", "Health Care", "Other"]


def test_similarity(spark):
    docs = spark.createDataFrame([("a", "apple Bank apple"), ("b", "bank, the bank; apple"), ("c", ""), ("d", None), ("e", "pear"), ("unpaired", "apple")], "doc string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "none"), ("b", "c"), ("d", "a"), ("a", "e"), ("b", "b")], "a string, b string")
    vectors = textsim.term_vectors(docs, pairs)
    assert {r["doc"]: (r["sq"], r["words"], r["length"]) for r in vectors.collect()} == {"a": (5, 2, 3), "b": (5, 2, 3), "c": (0, 0, 0), "d": (0, 0, 0), "e": (1, 1, 1)}
    got = {(r["a"], r["b"]): (round(r["cosine"], 6), round(r["jaccard"], 6)) for r in textsim.similarities(pairs, vectors).collect()}
    assert got == {("a", "b"): (0.8, 1.0), ("a", "none"): (0.0, 0.0), ("b", "c"): (0.0, 0.0), ("d", "a"): (0.0, 0.0), ("a", "e"): (0.0, 0.0), ("b", "b"): (1.0, 1.0)}


def test_character_references_equal_the_standard_library(spark):
    import html
    from html.entities import html5

    rng = random.Random(4)
    texts = [f"a &{n} b&{n}c &{n[:-1]}d" for n in html5] + [f"&#{n};&#{n}x&#x{n:x};&#X{n:X}g" for n in [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**12, 16**20]]
    texts += ["", "no references", "&", "&&", "& amp;", "&#;", "&#x;", "&#xg;", "&amp;lt;", "&notit;", "&notin;", "&NotEqualTilde;", "&unknownname;", "&" + "a" * 40 + ";", "&#0000065;", "&#x" + "0" * 30 + "41;", "é&eacute;\n&\tamp;"]
    texts += ["".join(rng.choice(["&", "#", ";", "x", "amp", "lt", "1", "3", "9", "not", "in", " ", "é"]) for _ in range(30)) for _ in range(500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", references.unescape(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [html.unescape(t) for t in texts]


def test_normalise_small_sector(spark):
    raw = spark.createDataFrame([(D(2020, 1, 31), f"t{i}", float(i)) for i in range(8)], "month date, ticker string, value double")
    sectors = spark.createDataFrame([(f"t{i}", "BIG" if i < 6 else "TINY") for i in range(8)], "ticker string, sector string")
    z = {r["ticker"]: r["z"] for r in signals.normalise(raw, sectors, None).collect()}
    v = np.arange(8.0)
    assert z["t0"] == pytest.approx((0 - v[:6].mean()) / v[:6].std(ddof=1)) and z["t7"] == pytest.approx((7 - v.mean()) / v.std(ddof=1))


def test_one_spelling_of_numbers(spark):
    texts = ["10", "10.0", " 0.010 ", "-3.50", "0", "-0", "1e3", "123456", "1234567", "0.0001", "0.00001234567", "999999.7", "9.9999995", "1e-300", "abc", "", None, "12.3456789", "0.1", "100000", "1000000", "nan", "5%"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(names.one_spelling_column(F.col("t"))).collect()]
    assert got == [names.one_spelling(t) for t in texts]
    row = {k: t for k, t in zip(names.KEY_FIELDS, texts, strict=False)}
    frame = spark.createDataFrame([tuple(row.get(k) for k in names.KEY_FIELDS)], ", ".join(f"`{k}` string" for k in names.KEY_FIELDS))
    assert frame.select(names.spec_key_of_columns()).first()[0] == names.spec_key(row)


def test_two_writers_of_one_log(spark, tmp_path):
    """Writers that start together do not double a run, and a run that is there is not added."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/log"
    run = {"timestamp": "2020-01-01T00:00:00", "factor": "f", "note": "base", "git_commit": "a"}
    some = [{**run, "factor": f"f{i}"} for i in range(20)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda shift: speclog.append(spark, path, [{**x, "timestamp": f"2020-01-0{shift}"} for x in some[shift * 5 :]]), (0, 1)))
    log = speclog.read(spark, path)
    assert sorted(r["factor"] for r in log.collect()) == sorted(x["factor"] for x in some)
    assert speclog.append(spark, path, spark.createDataFrame(some).union(spark.createDataFrame(some))) == 0
    assert speclog.append(spark, path, [{**run, "git_commit": None}, {**run, "git_commit": None}]) == 1 and speclog.append(spark, path, [{**run, "git_commit": None}]) == 0


def test_drift_compares_only_what_changed(spark, monkeypatch):
    rows_ = [(i, None if i % 7 == 0 else i / 3, f"s{i % 5}") for i in range(500)]
    a = spark.createDataFrame(rows_, "k int, x double, s string")
    b = spark.createDataFrame([(k, x if x is None or k % 2 else x + 1e-12, s) for k, x, s in reversed(rows_)], "k int, x double, s string")
    full, seen = audit.differences, []
    monkeypatch.setattr(audit, "differences", lambda l, r, *rest: seen.append((l.count(), r.count())) or full(l, r, *rest))
    assert rows(audit.drifted(a, b, ["k"])) == []
    c = b.where("k <> 10").withColumn("x", F.when(F.col("k") == 20, F.col("x") + 1e-6).when(F.col("k") == 7, 0.0).otherwise(F.col("x"))).withColumn("s", F.when(F.col("k") != 33, F.col("s"))).unionByName(b.where("k = 40"))
    assert rows(audit.drifted(a, c, ["k"])) == rows(full(a, c, ["k"])) == [("rows only in a", 1), ("rows only in b", 1), ("values of s", 1), ("values of x", 2)]
    assert all(n < 60 for pair in seen for n in pair)
    assert rows(audit.drifted(a, a.drop("s"), ["k"]))[0][1] == 1 and rows(audit.drifted(a.limit(0), a.limit(0), ["k"])) == []


def test_rename_chains_without_a_global_window(spark):
    """Days in chains by the gaps between them, over years; no exchange to a single partition."""
    days = [D(2015, 1, 5), D(2015, 1, 20), D(2015, 3, 1), D(2016, 12, 20), D(2017, 1, 10), D(2017, 2, 5), D(2017, 8, 1)]
    unmatched = spark.createDataFrame([(f"O{i}", d, i, "x") for i, d in enumerate(days)], "ticker string, date date, row long, security string")
    current = spark.createDataFrame([(f"N{i}", d + timedelta(days=i % 3)) for i, d in enumerate(days)], "ticker string, date_added date")
    out = universe._renames(unmatched, current, D(2010, 1, 1), 7)
    assert rows(out.select("old_ticker", "new_ticker")) == [(f"O{i}", f"N{i}") for i in range(7)]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_speclog(spark, tmp_path):
    path = str(tmp_path / "log")
    run = {"timestamp": "2024-01-01", "factor": "value", "cost_bps": 10, "note": "base", "git_commit": "abc", "n_deciles": "10.0"}
    assert speclog.append(spark, path, [run, run]) == 1
    assert speclog.append(spark, path, [{**run, "n_deciles": 10, "cost_bps": "10.0"}]) == 0
    assert speclog.append(spark, path, [{**run, "note": "sensitivity terminal no-sector"}]) == 1
    log = speclog.read(spark, path)
    assert {(r["kind"], r["sector_neutral"], r["variant"]) for r in log.collect()} == {("candidate", "1", ""), ("diagnostic", "0", "terminal")}
    assert names.spec_key({"factor": "a", "n_deciles": 10}) == names.spec_key({"factor": "a", "n_deciles": "10.0"})


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x", "s1"), (2, None, "y", "s1"), (3, 3.0, "z", "s1")], "k int, x double, s string, as_of string")
    b = spark.createDataFrame([(3, 3.0 + 1e-12, "z", "s2"), (2, None, "y", "s2"), (1, 1.0, "x", "s2")], "k int, x double, s string, as_of string")
    assert audit.differences(a, b, ["k"]).count() == 0
    assert rows(audit.differences(a, b.withColumn("x", F.col("x") + 1e-6), ["k"])) == [("values of x", 2)]
    assert "only in b" in audit.differences(a, b.withColumn("q", F.lit(1)), ["k"]).first()["what"]


def test_sql_view(spark):
    sqlview.register(spark, {"numbers": spark.range(10).toDF("n")})
    got = sqlview.query(spark, "select n from numbers order by n;", limit=3)
    assert got.columns == ["n"] and got.rows == [(0,), (1,), (2,)] and got.truncated
    for bad in ("drop table numbers", "with x as (select 1) insert into numbers select 1", "delete from numbers"):
        with pytest.raises(ValueError):
            sqlview.query(spark, bad)


def test_files(spark, tmp_path):
    files.store_raw(tmp_path, "a/x.csv", b"1", "u")
    with pytest.raises(FileExistsError):
        files.store_raw(tmp_path, "a/x.csv", b"2", "u")
    grid = files.table_rows('<table id="t"><tr><th rowspan=2>A<sup>1</sup></th><th colspan=2>B</th></tr><tr><td>c</td><td>d</td></tr></table>', "t")
    assert grid == [["A", "B", "B"], ["A", "c", "d"]]
    pages = spark.createDataFrame([(1, '{"units":{"USD":[{"accn":"a","end":"2020-06-30","filed":"2020-08-01","form":"10-K","val":5,"fy":2020},{"accn":"b","end":"2020-06-30","filed":"2020-08-01","form":"10-Q","val":5,"fy":2020}],"shares":[{"accn":"c","start":"2020-01-01","end":"2020-06-30","filed":"2020-08-01","form":"10-K","val":7,"fy":2020}]}}'), (2, "broken")], "cik long, json string")
    assert rows(files.facts_float(pages).select("cik", "adsh", "value")) == [(1, "a", 5.0)]
    assert rows(files.facts_fallback(pages, "shares").select("cik", "qtrs", "value")) == [(1, 2, 7.0)]
    (tmp_path / "AAA.csv").write_text("Date,Open,Close,Adj Close,Volume\n2020-01-02,1,10,9.5,100\n2020-01-03,1,10,,100\n")
    assert rows(files.vendor_prices(spark, str(tmp_path / "AAA.csv"))) == [("AAA", D(2020, 1, 2), 10.0, 9.5, 100.0)]
    texts = spark.createDataFrame([("a", "header\n202001, 1.5, -2\n202002, 0, 1\n\n202003, 7, 7\n 2020, 9, 9\n"), ("b", "202005,x,3\r\n"), ("c", "none"), ("d", None)], "path string, text string")
    assert rows(files.monthly_block(texts, ["x", "y"])) == [("a", D(2020, 1, 31), 0.015, -0.02), ("a", D(2020, 2, 29), 0.0, 0.01), ("b", D(2020, 5, 31), None, 0.03)]


def test_streamed_first_filings(spark, tmp_path):
    from ledgerline.streaming.filings import first_filings

    f = [(1, "c", D(2020, 1, 1), 0, D(2020, 2, 1), 4.0), (2, "c", D(2020, 1, 1), 0, D(2020, 2, 1), 6.0)]
    schema = "cik long, concept string, ddate date, qtrs int, filed date, value double"
    spark.createDataFrame(f, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = first_filings(stream).writeStream.format("memory").queryName("filed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    spark.createDataFrame([(1, "c", D(2020, 1, 1), 0, D(2020, 3, 1), 9.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select cik, value from filed")) == [(1, 4.0), (2, 6.0)]


def test_float_check_broadcasts_nothing_that_grows(spark):
    """Months of filers, prices, counts and floats are merged even where the threshold would let them be broadcast."""
    from ledgerline.config import Config
    from ledgerline.operators import facts
    from ledgerline.plans.catalog import Market
    from ledgerline.sources import market

    sf, cfg = "/root/testdata/sf0.001", Config()
    m = Market(spark, sf)
    check = facts.public_float_check(market.floats(spark, sf), m.ciks, m.caps, m.raw_prices, m.splits, market.covers(spark, sf), *cfg.float_band, cfg.start, cfg.end)
    plan = check._jdf.queryExecution().sparkPlan().toString()
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sides if "month" in line or "cik" in line or "float_date" in line], sides


def test_figures_keep_the_sign_of_zero_and_round_as_printf(spark):
    import duckdb

    from ledgerline.operators import runs

    values = [-0.0004, -0.00049, 0.0, 0.0004, 0.1235, 0.28745, -0.28745, 0.28755, None]
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate(values)], "factor string, x double")
    got = {r["name"]: r["text"] for r in runs.figures(rows, "factor", {"x": (1, 100.0)}).collect()}
    want = {f"x_{i}": duckdb.execute("SELECT printf('%.1f', round(?::DOUBLE * 100.0, 1))", [x]).fetchall()[0][0] for i, x in enumerate(values) if x is not None}
    assert got == want

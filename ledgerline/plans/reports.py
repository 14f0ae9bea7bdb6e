"""Queries over whole runs, their reports and audits, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import intervals, markdown, portfolio, prices, runs, signals, speclog, stats
from ledgerline.plans import oracles
from ledgerline.plans.catalog import CFG, Market, _delistings, _exclusions, _until_removed, query, r
from ledgerline.plans.oracles import ORACLES, VIEWS, _BODIES, _round, _simulation, _sql
from ledgerline.sources.store import new_table, settled

COSTS = [0.0, 10.0, 50.0]
BLOCKS = [(1995, 1996), (1997, 1998), (1999, 2001)]
TAGS = ["cw", "hold12", "hold3", "hold6", "nosector", "replica", "terminal"]
WANTED = [("momentum", "mkt_rf", -0.5), ("reversal", "smb", 0.9), ("momentum_cw", "hml", 0.2), ("momentum", "bab", 0.2)]


def inputs(m: Market) -> runs.Inputs:
    daily = _until_removed(m)
    ended = prices.monthly_returns(daily, CFG.lag_days, CFG.start, CFG.end)
    terminal = r(prices.terminal_returns(ended, m.members, daily, _delistings(m), -0.3), "ret_fwd")
    raw = {"momentum": r(signals.momentum(m.monthly), "value", digits=9), "reversal": r(signals.momentum(m.monthly, 1, 0), "value", digits=9)}
    return runs.Inputs(raw, m.monthly, m.factors, m.sectors, m.caps, terminal, frozenset({"reversal"}))


def _runs(m: Market, *variants: runs.Variant) -> DataFrame:
    return settled(runs.run(inputs(m), CFG, variants), "runs")


def _scores(m: Market) -> DataFrame:
    """(factor, month, ticker, z) of the base runs."""
    return settled(runs.scores(inputs(m), CFG, True), "scores")


ALL = (runs.BASE, *runs.SENSITIVITIES, runs.TERMINAL, runs.REPLICA)


@query
def run_all(m: Market) -> DataFrame:
    return r(_runs(m, runs.BASE), "ret_gross", "turnover", "ret_net")


@query
def sensitivities(m: Market) -> DataFrame:
    return r(_runs(m, *runs.SENSITIVITIES), "ret_gross", "turnover", "ret_net")


@query
def delisting_runs(m: Market) -> DataFrame:
    return r(_runs(m, runs.TERMINAL), "ret_gross", "turnover", "ret_net")


@query
def replicas(m: Market) -> DataFrame:
    return r(_runs(m, runs.REPLICA), "ret_gross", "turnover", "ret_net")


@query
def rerun(m: Market) -> DataFrame:
    """Everything again, with the note that each run is logged under."""
    notes = m.spark.createDataFrame([(v.tag, f"{v.note} again") for v in ALL], "tag string, note string")
    ls = _runs(m, *ALL)
    return r(ls.groupBy("factor", "tag").agg(F.count("*").alias("months"), stats.sharpe("ret_net").alias("sharpe")).join(F.broadcast(notes), "tag"), "sharpe")


@query
def saved_runs(m: Market) -> DataFrame:
    """Series saved by factor and tag; those of one factor read back."""
    uri = runs.save(_runs(m, runs.BASE, runs.SENSITIVITIES[0]), new_table(m.spark, "runs"))
    return r(runs.load(m.spark, uri, factor="momentum"), "ret_gross", "turnover", "ret_net")


@query
def run_summaries(m: Market) -> DataFrame:
    return runs.summary_lines(_runs(m, runs.BASE, runs.SENSITIVITIES[0]), m.factors, "mkt_rf")


@query
def validation_table(m: Market) -> DataFrame:
    wanted = m.spark.createDataFrame(WANTED, "series string, benchmark string, threshold double")
    return runs.validation(_runs(m, runs.BASE, runs.SENSITIVITIES[0]), m.factors, wanted, ["mkt_rf", "smb", "hml"])


@query
def variant_sharpes(m: Market) -> DataFrame:
    return r(runs.variant_table(_runs(m, *ALL), TAGS), "base", *TAGS)


@query
def hedged_runs(m: Market) -> DataFrame:
    return r(runs.hedged(_runs(m, runs.BASE), m.factors, CFG.cost), "ret_gross", "turnover", "ret_net")


@query
def hedge_table(m: Market) -> DataFrame:
    base = _runs(m, runs.BASE)
    both = settled(base.unionByName(r(runs.hedged(base, m.factors, CFG.cost), "ret_gross", "turnover", "ret_net", digits=9)), "both")
    return r(runs.hedge_table(both, m.factors, "hml"), "sharpe", "beta", "beta_t", "corr", digits=5)


@query
def weighting_gaps(m: Market) -> DataFrame:
    return r(runs.weighting_gaps(_runs(m, runs.BASE, runs.SENSITIVITIES[0]), m.factors), "alpha", "alpha_t", "beta", "beta_t", "r2", digits=5)


RESULTS = ["net_ann", "sharpe_net", "skew", "kurtosis", "max_drawdown", "gross_ann", "vol", "sharpe_gross", "turnover", "breakeven_bps", "sharpe_at_0bp", "sharpe_at_10bp", "sharpe_at_50bp", "mean_ic", "ic_t", "fm_premium", "fm_t", "coverage"]


def _results(m: Market) -> DataFrame:
    return r(runs.results(_runs(m, runs.BASE), _scores(m), m.monthly, m.panel, COSTS), *RESULTS, digits=5)


@query
def results_frame(m: Market) -> DataFrame:
    return _results(m)


@query
def factor_report(m: Market) -> DataFrame:
    """One factor's row of the results."""
    return _results(m).where("factor = 'momentum'")


FORMATS = {"net_ann": (1, 100.0), "sharpe_net": (2, 1.0), "turnover": (2, 1.0), "breakeven_bps": (0, 1.0)}


@query
def prose_figures(m: Market) -> DataFrame:
    return runs.figures(_results(m), "factor", FORMATS)


RESULT_COLUMNS = ["factor", "net_ann", "sharpe_net", "max_drawdown", "breakeven_bps"]


@query
def report_document(m: Market) -> DataFrame:
    """The report as lines of text: results, validation, variants and attribution, each a table."""
    ls = _runs(m, *ALL)
    two = settled(ls.where("tag in ('', 'cw')"), "two")
    wanted = m.spark.createDataFrame(WANTED, "series string, benchmark string, threshold double")
    validation = runs.validation(two, m.factors, wanted, ["mkt_rf", "smb", "hml"]).select("series", "benchmark", "correlation", "months", "passed")
    variants = r(runs.variant_table(ls, TAGS), "base", *TAGS).select("factor", "base", *TAGS)
    fit = r(stats.attribution(two, m.factors, ["mkt_rf", "smb", "hml"], ["factor", "tag"], lags=2), "alpha", "beta_mkt_rf", "r2", digits=5).select("factor", "tag", "alpha", "beta_mkt_rf", "r2")
    return markdown.document("Results", {
        "Results table": markdown.lines(_results(m).select(*RESULT_COLUMNS), ["factor"], {"net_ann": 4, "max_drawdown": 4, "breakeven_bps": 0}),
        "Validation": markdown.lines(validation, ["series", "benchmark"], {"correlation": 4}),
        "Variants (net Sharpe)": markdown.lines(variants, ["factor"]),
        "Attribution": markdown.lines(fit, ["factor", "tag"], {"alpha": 4}),
    })


@query
def filled_text(m: Market) -> DataFrame:
    """A paragraph for each factor with marked figures, old numbers in them, and one without any."""
    figures = settled(runs.figures(_results(m), "factor", FORMATS), "figures")
    factor = F.regexp_extract("name", "^sharpe_net_(.*)$", 1)
    texts = figures.where("name like 'sharpe_net_%'").select(factor.alias("name"), F.concat(F.lit("Of "), factor, F.lit(": net <!--cov:net_ann_"), factor, F.lit("-->9\n9<!--/cov-->%, Sharpe <!--cov:sharpe_net_"), factor, F.lit("--><!--/cov-->.")).alias("text"))
    plain = m.spark.createDataFrame([("none", "No figure <!--cov--> here.")], "name string, text string")
    return markdown.filled(texts.unionByName(plain), figures.select(F.col("name").alias("key"), F.col("text").alias("value")))


@query
def factor_cards(m: Market) -> DataFrame:
    """The results as the page shows them: percent, two digits."""
    pct = lambda c, d: F.round(F.col(c) * 100, d)
    return _results(m).select("factor", pct("gross_ann", 1).alias("gross"), pct("net_ann", 1).alias("net"), F.round("sharpe_net", 2).alias("sharpe"), pct("max_drawdown", 0).cast("int").alias("mdd"), F.round("mean_ic", 3).alias("ic"), F.when(F.col("breakeven_bps") >= 0, F.format_string("%.0f bp", F.round("breakeven_bps", 0))).otherwise("none").alias("be"))


@query
def validation_rows(m: Market) -> DataFrame:
    """Validation rows in the order of the page: series that rebuild their benchmark first, the others after them."""
    from pyspark.sql import Window

    rows = runs.validation(_runs(m, runs.BASE), m.factors, m.spark.createDataFrame(WANTED, "series string, benchmark string, threshold double"), ["mkt_rf", "smb", "hml"])
    kind = F.when(F.col("series").startswith("momentum"), "info").otherwise("join")
    rows = rows.select("series", "benchmark", F.round("correlation", 2).alias("correlation"), F.when(F.col("passed"), "pass").otherwise("fail").alias("verdict"), kind.alias("kind"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy((F.col("kind") == "info").cast("int"), "series", "benchmark")))  # as many rows as thresholds


@query
def exclusion_counts(m: Market) -> DataFrame:
    """Windows, names, member-months inside a window, and those with a price."""
    ex = _exclusions(m)
    hit = intervals.excluded_months(ex, CFG.start, CFG.end).join(m.panel, ["month", "ticker"], "left_semi")
    priced = hit.join(m.monthly.select("month", "ticker"), ["month", "ticker"], "left_semi")
    one = ex.agg(F.count("*").alias("windows"), F.countDistinct("ticker").alias("names"))
    return one.join(hit.agg(F.count("*").alias("member_months"))).join(priced.agg(F.count("*").alias("priced_member_months")))


@query
def cap_shares(m: Market) -> DataFrame:
    """By year: the mean over months of members with a market cap."""
    rows = m.panel.join(m.caps.select("month", "ticker", "cap"), ["month", "ticker"], "left")
    share = rows.groupBy("month").agg((F.count("cap") / F.count("*")).alias("share"))
    return share.groupBy(F.year("month").alias("year")).agg(F.round(F.avg("share") * 100, 4).alias("share_pct"))


@query
def attributions(m: Market) -> DataFrame:
    """Every run and its cap-weighted variant on three factors at once, with two lags."""
    names = ["mkt_rf", "smb", "hml"]
    fit = stats.attribution(_runs(m, runs.BASE, runs.SENSITIVITIES[0]), m.factors, names, ["factor", "tag"], lags=2)
    return r(fit, "alpha", "t_alpha", *(f"{p}_{n}" for n in names for p in ("beta", "t")), "r2", digits=5)


@query
def trial_counts(m: Market) -> DataFrame:
    """Rows logged, and of all and of candidates: distinct specifications and the variance of their latest monthly Sharpe ratios."""
    both = speclog.counts(m.spec_log).join(speclog.trial_variance(m.spec_log), "kind").where("kind in ('all', 'candidate')")
    return r(both.select("kind", "rows", "trials", "variance"), "variance", digits=2)


@query
def log_lines(m: Market) -> DataFrame:
    """What did not work: a line for each superseded or abandoned run, with the first commit after it."""
    commits = m.table("orders").where("o_totalprice > 300000").groupBy(F.to_timestamp(F.to_date("o_orderdate")).alias("when")).agg(F.min(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 7)).alias("sha")).withColumn("subject", F.lit("fix"))
    rows = speclog.classify(m.spec_log, ["f0", "f1", "f2"]).where("status <> 'current'").withColumn("timestamp", F.substring("timestamp", 1, 10))
    return speclog.lines(speclog.superseding_commit(rows, commits))


@query
def spec_history(m: Market) -> DataFrame:
    """The last net Sharpe of one factor under each commit."""
    rows = m.spec_log.where("kind = 'candidate' and factor = 'f1'")
    return rows.groupBy("git_commit").agg(F.max_by("sharpe_net", "timestamp").try_cast("double").alias("sharpe"))


@query
def rolling_ic(m: Market) -> DataFrame:
    return r(stats.rolling_mean(stats.ic_series(m.z, m.monthly), "ic", 36), "ic", "rolling")


@query
def cumulative_deciles(m: Market) -> DataFrame:
    return r(stats.cumulative_log(m.deciles, "ret_gross", ("decile",)).select("decile", "month", "log_return"), "log_return")


@query
def weight_concentration(m: Market) -> DataFrame:
    return r(stats.concentration(portfolio.weights(portfolio.assign_deciles(m.z, 3), m.caps)), "max_w", "top_w")


def _two_scores(m: Market) -> DataFrame:
    """Scores by the signal as it is and after its outliers are cut and it is set against its sector."""
    raw = r(signals.momentum(m.monthly), "value", digits=9).select("month", "ticker", F.col("value").alias("plain"))
    return raw.join(m.z, ["month", "ticker"])


@query
def factor_diagnostics(m: Market) -> DataFrame:
    w = portfolio.weights(portfolio.assign_deciles(m.z, 3), m.caps)
    out = stats.diagnosis(_two_scores(m), "plain", "z", w, m.spread, m.factors, "mkt_rf", BLOCKS)
    return r(out, "mean_gap", "agreement", "rank_corr", "top_share", "corr")


@query
def rank_gap_names(m: Market) -> DataFrame:
    return r(stats.widest_gaps(_two_scores(m), "plain", "z"), "mean_gap")


@query
def heavy_names(m: Market) -> DataFrame:
    """The ten names with the largest mean weight in the outer terciles: a top-k report."""
    w = portfolio.weights(portfolio.assign_deciles(m.z, 3), m.caps).where("decile in (1, 3)")
    return w.groupBy("ticker", "decile").agg(F.round(F.avg("w"), 6).alias("mean_w"), F.count("*").alias("months")).orderBy(F.col("mean_w").desc(), "ticker", "decile").limit(10)


@query
def member_deviation(m: Market) -> DataFrame:
    """The deviation of each member's calendar returns, over its months of membership."""
    return r(m.monthly.join(m.panel, ["month", "ticker"]).groupBy("ticker").agg(F.stddev_samp("ret_cal").alias("sd")), "sd")


# --- their SQL ---

VIEWS["gaps_of"] = """SELECT *, abs(a - b) AS gap, least(floor(a * 3)::INTEGER + 1, 3) AS ta, least(floor(b * 3)::INTEGER + 1, 3) AS tb FROM (
  SELECT month, ticker, (rank() OVER (PARTITION BY month ORDER BY plain) + (count(*) OVER (PARTITION BY month, plain) - 1) / 2 - 0.5::DOUBLE) / count(*) OVER (PARTITION BY month) AS a,
    (rank() OVER (PARTITION BY month ORDER BY z) + (count(*) OVER (PARTITION BY month, z) - 1) / 2 - 0.5::DOUBLE) / count(*) OVER (PARTITION BY month) AS b FROM (SELECT month, ticker, value AS plain, z FROM mom9 JOIN z USING (month, ticker)))"""
VIEWS["blocks"] = "SELECT * FROM (VALUES ('all', 0, 9999), " + ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in BLOCKS) + ") b(block, a0, z0)"
VIEWS["zn"] = "SELECT month, ticker, round((value - mu) / sd, 9) AS z FROM (SELECT month, ticker, value, avg(value) OVER a AS mu, stddev_samp(value) OVER a AS sd FROM momw WINDOW a AS (PARTITION BY month)) WHERE sd > 0"
VIEWS["term"] = f"SELECT month, ticker, ret_fwd AS ret FROM ({_BODIES['terminal_returns']})"
_SERIES: list[tuple[str, str]] = []
for _factor, _z, _zn in (("momentum", "z", "zn"), ("reversal", "rz", "rz")):
    for _v in ALL:
        _name = f"{_factor}_{_v.tag or 'base'}"
        _scored, _rets, _n = (_z if _v.sector_neutral else _zn), ("term" if _v.terminal else "rets"), _v.n_deciles or CFG.n_deciles
        VIEWS[f"sm_{_name}"] = f"SELECT * FROM {_scored} WHERE month IN (SELECT month FROM {_rets} WHERE ret IS NOT NULL) AND month IN (SELECT month FROM {_scored} GROUP BY 1 HAVING count(*) >= 5)"
        VIEWS[f"dc_{_name}"] = f"SELECT month, ticker, ((row_number() OVER (PARTITION BY month ORDER BY z, ticker) - 1) * {_n} // count(*) OVER (PARTITION BY month))::INTEGER + 1 AS decile FROM sm_{_name}"
        VIEWS[f"w_{_name}"] = (
            f"SELECT d.month, d.ticker, decile, cap / sum(cap) OVER (PARTITION BY d.month, decile) AS w FROM dc_{_name} d JOIN caps USING (month, ticker) WHERE cap > 0" if _v.weighting == "cw"
            else f"SELECT month, ticker, decile, 1.0::DOUBLE / count(*) OVER (PARTITION BY month, decile) AS w FROM dc_{_name}"
        )
        _simulation(f"w_{_name}", _v.holding, _rets)
        _gross = f"sum(CASE decile WHEN {_n} THEN ret_gross ELSE -ret_gross END)"
        VIEWS[f"ls_{_name}"] = f"SELECT month, round({_gross}, 9) AS ret_gross, round(sum(turnover), 9) AS turnover, round({_gross} - 0.002 * sum(turnover), 9) AS ret_net FROM bt_w_{_name}{_v.holding} WHERE decile IN (1, {_n}) GROUP BY 1"
        _SERIES.append((_factor, _v.tag))


def _table_sql(section: int, heading: str, source: str, cols: list[str], digits: dict[str, int], order: str) -> str:
    cell = [f"coalesce(printf('%.{digits[c]}f', round({c}, {digits[c]})::DOUBLE + 0.0), 'n/a')" if c in digits else f"coalesce({c}::VARCHAR, 'n/a')" for c in cols]
    head = [(-2, f"## {heading}"), (-1, "| " + " | ".join(cols) + " |"), (0, "| " + " | ".join(["---"] * len(cols)) + " |")]
    fixed = " UNION ALL ".join(f"SELECT {section}, '{heading}', {at}::BIGINT, '{line}'" for at, line in head)
    return f"{fixed} UNION ALL SELECT {section}, '{heading}', row_number() OVER (ORDER BY {order}), '| ' || {" || ' | ' || ".join(cell)} || ' |' FROM {source}"


def _union(*tags: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS factor, '{t}' AS tag, month, ret_gross, turnover, ret_net FROM ls_{f}_{t or 'base'}" for f, t in _SERIES if t in tags)


_SENS = [v.tag for v in runs.SENSITIVITIES]
for _view, _tags in (("runs_base", [""]), ("runs_cw", ["", "cw"]), ("runs_sens", _SENS), ("runs_term", ["terminal"]), ("runs_rep", ["replica"]), ("runs_all", [v.tag for v in ALL])):
    VIEWS[_view] = _union(*_tags)
VIEWS["hedge0"] = """SELECT factor, month, ret_gross - b * mkt_rf AS h, turnover FROM (SELECT *, CASE WHEN count(mkt_rf) OVER w >= 24 THEN regr_slope(ret_gross, mkt_rf) OVER w END AS b FROM
  (SELECT l.factor, l.month, ret_gross, turnover, f.mkt_rf FROM runs_base l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)) WINDOW w AS (PARTITION BY factor ORDER BY month ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)) WHERE b IS NOT NULL"""
VIEWS["runs_hedged"] = "SELECT factor, 'hedged' AS tag, month, round(h, 9) AS ret_gross, round(turnover, 9) AS turnover, round(h - 0.002 * turnover, 9) AS ret_net FROM hedge0"
VIEWS["runs_both"] = "SELECT * FROM runs_base UNION ALL SELECT * FROM runs_hedged"
VIEWS["allz"] = "SELECT 'momentum' AS factor, month, ticker, z FROM z UNION ALL SELECT 'reversal', month, ticker, z FROM rz"
_SHARPE = "CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(12) END"


def _fit(rows: str, keys: str) -> str:
    """A line through (x, y) with robust errors: (keys, n, alpha, alpha_t, beta, beta_t, r2)."""
    return f"""SELECT {keys}, n, alpha * 12 AS alpha, alpha / nullif(sqrt(va), 0) AS alpha_t, beta, beta / nullif(sqrt(vb), 0) AS beta_t, 1 - e2 / nullif(syy, 0) AS r2 FROM (
      SELECT {keys}, count(*) AS n, any_value(b) AS beta, any_value(my) - any_value(b) * any_value(mx) AS alpha, sum(e * e * dx * dx) / pow(sum(dx * dx), 2) AS vb, sum(e * e) AS e2, sum(pow(y - my, 2)) AS syy,
        sum(e * e * pow(1.0::DOUBLE / n_ - mx * dx / sxx, 2)) AS va FROM (
        SELECT *, y - my - b * dx AS e FROM (SELECT *, x - avg(x) OVER k AS dx, avg(x) OVER k AS mx, avg(y) OVER k AS my, regr_slope(y, x) OVER k AS b, count(*) OVER k AS n_, regr_sxx(y, x) OVER k AS sxx FROM ({rows}) WINDOW k AS (PARTITION BY {keys}))) GROUP BY {keys})"""


def _earned(source: str, factor: str, keys: str) -> str:
    return f"SELECT {', '.join('l.' + k for k in keys.split(', '))}, l.ret_gross AS y, f.{factor} AS x FROM {source} l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)"


VIEWS["gaps"] = "SELECT a.factor, a.month, a.ret_gross - b.ret_gross AS ret_gross FROM (SELECT * FROM runs_cw WHERE tag = '') a JOIN (SELECT * FROM runs_cw WHERE tag = 'cw') b USING (factor, month)"
VIEWS["fits"] = " UNION ALL ".join(f"SELECT concat_ws('_', factor, nullif(tag, '')) AS series, '{b}' AS benchmark, count(*) AS n, CASE WHEN count(*) > 2 THEN corr(y, x) END AS corr FROM ({_earned('runs_cw', b, 'factor, tag')}) GROUP BY 1" for b in ("mkt_rf", "smb", "hml"))
VIEWS["wanted"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {t}::DOUBLE)" for a, b, t in WANTED) + ") w(series, benchmark, threshold)"
VIEWS["validated"] = "SELECT series, benchmark, round(corr, 4) AS correlation, coalesce(n, 0) AS months, threshold, coalesce(corr >= threshold, false) AS passed FROM wanted LEFT JOIN fits USING (series, benchmark)"
VIEWS["zrets"] = "SELECT factor, a.month, a.ticker, z, ret_fwd AS r FROM allz a JOIN monthly USING (month, ticker) JOIN panel USING (month, ticker) WHERE ret_fwd IS NOT NULL"
VIEWS["zics"] = """SELECT factor, month, corr(a, b) AS ic FROM (SELECT factor, month, rank() OVER (PARTITION BY factor, month ORDER BY z) + (count(*) OVER (PARTITION BY factor, month, z) - 1) / 2 AS a, rank() OVER (PARTITION BY factor, month ORDER BY r) + (count(*) OVER (PARTITION BY factor, month, r) - 1) / 2 AS b FROM zrets) GROUP BY 1, 2 HAVING count(*) >= 10"""
VIEWS["zslopes"] = "SELECT factor, month, regr_slope(r, z) AS slope FROM zrets GROUP BY 1, 2 HAVING count(*) >= 10"
VIEWS["res"] = f"""SELECT * FROM (
  SELECT factor, count(*) AS months, round(avg(x) * 12, 5) AS net_ann, round({_SHARPE.format('x')}, 5) AS sharpe_net, round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 5) AS skew, round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2), 5) AS kurtosis, round(min(w / top - 1), 5) AS max_drawdown
  FROM (SELECT *, max(w) OVER (PARTITION BY factor ORDER BY month) AS top FROM (SELECT factor, month, ret_net AS x, avg(ret_net) OVER (PARTITION BY factor) AS m, product(1 + ret_net) OVER (PARTITION BY factor ORDER BY month ROWS UNBOUNDED PRECEDING) AS w FROM runs_base)) GROUP BY 1)
  JOIN (SELECT factor, round(avg(ret_gross) * 12, 5) AS gross_ann, round(stddev_samp(ret_gross) * sqrt(12), 5) AS vol, round({_SHARPE.format('ret_gross')}, 5) AS sharpe_gross, round(avg(turnover), 5) AS turnover, round(CASE WHEN avg(turnover) > 0 THEN avg(ret_gross) / (2 * avg(turnover)) * 1e4 END, 5) AS breakeven_bps,
    {', '.join(f"round({_SHARPE.format(f'(ret_gross - 2 * {c} / 1e4 * turnover)')}, 5) AS sharpe_at_{int(c)}bp" for c in COSTS)} FROM runs_base GROUP BY 1) USING (factor)
  LEFT JOIN (SELECT factor, round(avg(ic), 5) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 5) AS ic_t FROM zics GROUP BY 1) USING (factor)
  LEFT JOIN (SELECT factor, round(any_value(m), 5) AS fm_premium, round(any_value(m) / nullif(sqrt(sum(pow(slope - m, 2)) / count(*) / count(*)), 0), 5) AS fm_t FROM (SELECT *, avg(slope) OVER (PARTITION BY factor) AS m FROM zslopes) GROUP BY 1) USING (factor)
  LEFT JOIN (SELECT factor, round(median(s), 5) AS coverage FROM (SELECT f.factor, p.month, count(z)::DOUBLE / count(*) AS s FROM panel p CROSS JOIN (SELECT DISTINCT factor FROM allz) f LEFT JOIN allz a ON a.factor = f.factor AND a.month = p.month AND a.ticker = p.ticker GROUP BY 1, 2) GROUP BY 1) USING (factor)"""
_LS = f"factor, tag, month, {_round('ret_gross turnover ret_net')}"
_TWO = "coalesce(printf('%.2f', round({0}, 2)), 'n/a')"
BODIES: dict[str, str] = {
    "run_all": f"SELECT {_LS} FROM runs_base",
    "sensitivities": f"SELECT {_LS} FROM runs_sens",
    "delisting_runs": f"SELECT {_LS} FROM runs_term",
    "replicas": f"SELECT {_LS} FROM runs_rep",
    "rerun": f"SELECT factor, tag, note, count(*) AS months, round({_SHARPE.format('ret_net')}, 6) AS sharpe FROM runs_all JOIN (VALUES " + ", ".join(f"('{v.tag}', '{v.note} again')" for v in ALL) + ") v(tag, note) USING (tag) GROUP BY 1, 2, 3",
    "saved_runs": f"SELECT {_LS} FROM runs_cw WHERE factor = 'momentum'",
    "run_summaries": f"""SELECT factor, tag, factor || ': ' || n || ' months, gross Sharpe ' || {_TWO.format('g')} || ', net ' || {_TWO.format('s')} || ', mean turnover ' || {_TWO.format('t')} || ', corr ' || coalesce(printf('%.3f', round(corr, 3)), 'n/a') || ' vs mkt_rf' AS line FROM
      (SELECT factor, tag, count(*) AS n, {_SHARPE.format('ret_gross')} AS g, {_SHARPE.format('ret_net')} AS s, avg(turnover) AS t FROM runs_cw GROUP BY 1, 2) JOIN (SELECT factor, tag, CASE WHEN count(*) > 2 THEN corr(y, x) END AS corr FROM ({_earned('runs_cw', 'mkt_rf', 'factor, tag')}) GROUP BY 1, 2) USING (factor, tag)""",
    "validation_table": "SELECT * FROM validated",
    "validation_rows": """SELECT series, benchmark, round(CASE WHEN series NOT LIKE '%\\_cw' ESCAPE '\\' THEN correlation END, 2) AS correlation, CASE WHEN passed AND series NOT LIKE '%\\_cw' ESCAPE '\\' THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN series LIKE 'momentum%' THEN 'info' ELSE 'join' END AS kind,
      row_number() OVER (ORDER BY (series LIKE 'momentum%')::INTEGER, series, benchmark)::INTEGER AS place FROM validated""",
    "variant_sharpes": "SELECT factor, " + ", ".join(f"round(max(s) FILTER (tag = '{t}'), 6) AS {t or 'base'}" for t in ["", *TAGS]) + f" FROM (SELECT factor, tag, {_SHARPE.format('ret_net')} AS s FROM runs_all GROUP BY 1, 2) GROUP BY 1",
    "hedged_runs": "SELECT factor, 'hedged' AS tag, month, round(h, 6) AS ret_gross, round(turnover, 6) AS turnover, round(h - 0.002 * turnover, 6) AS ret_net FROM hedge0",
    "hedge_table": f"""SELECT factor, tag, {_round('sharpe beta beta_t corr', 5)}, months FROM (SELECT factor, tag, {_SHARPE.format('ret_net')} AS sharpe FROM runs_both GROUP BY 1, 2) JOIN ({_fit(_earned('runs_both', 'mkt_rf', 'factor, tag'), 'factor, tag')}) USING (factor, tag)
      JOIN (SELECT factor, tag, count(*) AS months, corr(y, x) AS corr FROM ({_earned('runs_both', 'hml', 'factor, tag')}) GROUP BY 1, 2) USING (factor, tag)""",
    "weighting_gaps": f"SELECT factor, n, {_round('alpha alpha_t beta beta_t r2', 5)} FROM ({_fit(_earned('gaps', 'smb', 'factor'), 'factor')})",
    "factor_diagnostics": f"""SELECT * FROM (SELECT block, count(*) AS names, round(avg(gap), 6) AS mean_gap, round(100 * avg((ta = tb)::INTEGER), 6) AS agreement, count(*) FILTER (abs(ta - tb) = 2) AS crossings, round(corr(a, b), 6) AS rank_corr FROM gaps_of JOIN blocks ON year(month) BETWEEN a0 AND z0 GROUP BY 1)
      LEFT JOIN (SELECT block, round(avg(t), 6) AS top_share FROM (SELECT month, decile, sum(w) FILTER (n <= 5) AS t FROM (SELECT *, row_number() OVER (PARTITION BY month, decile ORDER BY w DESC, ticker) AS n, max(decile) OVER (PARTITION BY month) AS last FROM thirds) WHERE decile IN (1, last) GROUP BY 1, 2) JOIN blocks ON year(month) BETWEEN a0 AND z0 GROUP BY 1) USING (block)
      LEFT JOIN (SELECT block, corr FROM ({_BODIES['fit_by_years']})) USING (block)""",
    "rank_gap_names": "SELECT ticker, count(*) AS months, round(avg(gap), 6) AS mean_gap, count(*) FILTER (abs(ta - tb) = 2) AS crossings FROM gaps_of GROUP BY 1",
    "attributions": "SELECT factor, tag, n, round(beta_one * 12, 5) AS alpha, round(t_one, 5) AS t_alpha, " + ", ".join(f"round({p}_{n}, 5) AS {p}_{n}" for n in ("mkt_rf", "smb", "hml") for p in ("beta", "t"))
    + ", round(r2, 5) AS r2 FROM (" + oracles.least_squares("SELECT l.factor, l.tag, f.*, l.ret_gross AS y FROM runs_cw l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)", ["factor", "tag"], ["mkt_rf", "smb", "hml"], 2) + ")",
    "results_frame": "SELECT * FROM res",
    "factor_report": "SELECT * FROM res WHERE factor = 'momentum'",
    "prose_figures": " UNION ALL ".join(f"SELECT '{c}_' || factor AS name, printf('%.{d}f', round({c} * {by}, {d})) AS text FROM res WHERE {c} IS NOT NULL" for c, (d, by) in FORMATS.items()),
    "report_document": f"""SELECT 0 AS section, 'Results' AS heading, 0::BIGINT AS at, '# Results' AS line
      UNION ALL {_table_sql(1, 'Results table', 'res', RESULT_COLUMNS, {"net_ann": 4, "sharpe_net": 2, "max_drawdown": 4, "breakeven_bps": 0}, 'factor')}
      UNION ALL {_table_sql(2, 'Validation', 'validated', ["series", "benchmark", "correlation", "months", "passed"], {"correlation": 4}, 'series, benchmark')}
      UNION ALL {_table_sql(3, 'Variants (net Sharpe)', '(SELECT factor, ' + ", ".join(f"round(max(s) FILTER (tag = '{t}'), 6) AS {t or 'base'}" for t in ["", *TAGS]) + f" FROM (SELECT factor, tag, {_SHARPE.format('ret_net')} AS s FROM runs_all GROUP BY 1, 2) GROUP BY 1)", ["factor", "base", *TAGS], {t: 2 for t in ("base", *TAGS)}, 'factor')}
      UNION ALL {_table_sql(4, 'Attribution', '(SELECT factor, tag, round(beta_one * 12, 5) AS alpha, round(beta_mkt_rf, 5) AS beta_mkt_rf, round(r2, 5) AS r2 FROM (' + oracles.least_squares("SELECT l.factor, l.tag, f.*, l.ret_gross AS y FROM runs_cw l JOIN factors f ON f.month = last_day((l.month + INTERVAL 1 MONTH)::DATE)", ["factor", "tag"], ["mkt_rf", "smb", "hml"], 2) + '))', ["factor", "tag", "alpha", "beta_mkt_rf", "r2"], {"alpha": 4, "beta_mkt_rf": 2, "r2": 2}, 'factor, tag')}""",
    "filled_text": """SELECT factor AS name, 'Of ' || factor || ': net <!--cov:net_ann_' || factor || '-->' || printf('%.1f', round(net_ann * 100, 1)) || '<!--/cov-->%, Sharpe <!--cov:sharpe_net_' || factor || '-->' || printf('%.2f', round(sharpe_net, 2)) || '<!--/cov-->.' AS text FROM res
      UNION ALL SELECT 'none', 'No figure <!--cov--> here.'""",
    "factor_cards": "SELECT factor, round(gross_ann * 100, 1) AS gross, round(net_ann * 100, 1) AS net, round(sharpe_net, 2) AS sharpe, round(max_drawdown * 100, 0)::INTEGER AS mdd, round(mean_ic, 3) AS ic, CASE WHEN breakeven_bps >= 0 THEN printf('%.0f bp', round(breakeven_bps, 0)) ELSE 'none' END AS be FROM res",
    "exclusion_counts": """SELECT (SELECT count(*) FROM members WHERE k % 6 = 0) AS windows, (SELECT count(DISTINCT ticker) FROM members WHERE k % 6 = 0) AS names, count(*) AS member_months, count(p) AS priced_member_months FROM (SELECT e.month, e.ticker, m.p FROM excluded e JOIN panel USING (month, ticker) LEFT JOIN (SELECT month, ticker, 1 AS p FROM monthly) m USING (month, ticker))""",
    "cap_shares": "SELECT year(month)::INTEGER AS year, round(avg(s) * 100, 4) AS share_pct FROM (SELECT month, count(cap)::DOUBLE / count(*) AS s FROM panel LEFT JOIN caps USING (month, ticker) GROUP BY 1) GROUP BY 1",
    "trial_counts": f"SELECT kind, rows, trials, variance FROM ({_BODIES['spec_counts']}) JOIN ({_BODIES['spec_variance']}) USING (kind) WHERE kind IN ('all', 'candidate')",
    "log_lines": """SELECT status, t || ' `' || factor || '` (' || signal || ', ew, hold 1' || CASE WHEN note LIKE '%no-sector%' THEN ', no-sector' ELSE '' END || ') net Sharpe ' || s || ', "' || note || '" → ' || coalesce(sha || ' "fix"', 'no commit after it yet') AS line FROM
      (SELECT status, substr("timestamp", 1, 10) AS t, factor, signal, note, o_totalprice AS s, (SELECT min_by(sha, w) FROM commits_ WHERE w > substr("timestamp", 1, 10)::DATE) AS sha FROM
        (SELECT *, sharpe AS o_totalprice, CASE WHEN factor NOT IN ('f0', 'f1', 'f2') THEN 'abandoned' WHEN "timestamp" < max("timestamp") OVER (PARTITION BY factor, signal, note LIKE '%no-sector%') THEN 'superseded' ELSE 'current' END AS status FROM speclog) WHERE status <> 'current')""",
    "spec_history": """SELECT substr(md5(cust::VARCHAR), 1, 6) AS git_commit, arg_max(s, t) AS sharpe FROM (SELECT o_custkey AS cust, o_totalprice AS s, strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(o_orderkey::VARCHAR, 12, '0') AS t FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 5 = 1) GROUP BY 1""",
    "rolling_ic": "SELECT month, round(ic, 6) AS ic, n, round(CASE WHEN count(ic) OVER w = 36 THEN avg(ic) OVER w END, 6) AS rolling FROM ic WINDOW w AS (ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)",
    "cumulative_deciles": "SELECT decile, month, round(sum(ln(1 + ret_gross)) OVER (PARTITION BY decile ORDER BY month ROWS UNBOUNDED PRECEDING), 6) AS log_return FROM bt",
    "weight_concentration": "SELECT decile, round(avg(m), 6) AS max_w, round(avg(t), 6) AS top_w FROM (SELECT month, decile, max(w) AS m, sum(w) FILTER (r <= 5) AS t FROM (SELECT *, row_number() OVER (PARTITION BY month, decile ORDER BY w DESC, ticker) AS r FROM thirds) GROUP BY 1, 2) GROUP BY 1",
    "heavy_names": "SELECT ticker, decile, round(avg(w), 6) AS mean_w, count(*) AS months FROM thirds WHERE decile IN (1, 3) GROUP BY 1, 2 ORDER BY mean_w DESC, ticker, decile LIMIT 10",
    "member_deviation": "SELECT ticker, round(stddev_samp(ret_cal), 6) AS sd FROM monthly JOIN panel USING (month, ticker) GROUP BY 1",
}
VIEWS["thirds"] = "SELECT d.month, d.ticker, decile, cap / sum(cap) OVER (PARTITION BY d.month, decile) AS w FROM (SELECT month, ticker, ((row_number() OVER (PARTITION BY month ORDER BY z, ticker) - 1) * 3 // count(*) OVER (PARTITION BY month))::INTEGER + 1 AS decile FROM z) d JOIN caps USING (month, ticker) WHERE cap > 0"
VIEWS["commits_"] = "SELECT o_orderdate::DATE AS w, min(substr(md5(o_orderkey::VARCHAR), 1, 7)) AS sha FROM orders WHERE o_totalprice > 300000 GROUP BY 1"
ORACLES.update({name: _sql(body) for name, body in BODIES.items()})

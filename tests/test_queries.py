"""Queries of the catalog equal their SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from ledgerline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = [
    "rebalance", "member_counts", "exclusion_log", "cik_eras", "reconcile_aliases", "override_starts", "adjudicated_starts", "membership_walk", "clean_log", "monthly_returns", "price_coverage", "removed_names", "price_levels", "preferred_tags",
    "facts_known", "trailing_year", "panel_long", "fundamental_signals", "share_counts", "float_checks", "tag_coverage", "amendments", "sic_sectors", "sector_agreement", "clean_names", "page_words", "unescaped_pages", "filing_similarity", "factor_attribution", "attributions", "deflated", "text_signal",
    "run_all", "delisting_runs", "validation_table", "weighting_gaps", "hedge_table", "results_frame", "log_lines", "trial_counts", "heavy_names", "rolling_ic", "vendor_files", "filing_values", "facts_spans", "submission_documents", "constituent_rows", "snapshot_rows",
    "workbook_series", "exclusion_list", "cached_facts", "logged_runs", "annual_known", "filer_audit", "built_prices", "built_sectors", "loaded_runs", "rebuild_drift", "ingested_quarters", "built_shares", "built_identity", "factor_diagnostics", "factor_file", "tag_map_problems",
    "volatility", "sector_scores", "cap_weights", "long_short", "rank_terciles", "spec_counts", "spec_status", "build_differences", "missing_classes", "fit_by_years", "sharpe_by_coverage",
]


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return out


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9) + 0.0
    return x.date() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    theirs = sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_market_beta_rounds_ties_as_its_sql(spark):
    """Means of returns that lie half way between two last digits."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours = sorted(tuple(r) for r in QUERIES["market_beta"](spark, sf).select("month", "ticker", "value").collect())
    assert ours == sorted(map(tuple, con.sql(ORACLES["market_beta"]).select("month", "ticker", "value").fetchall()))


def test_rebuild_drift_counts_one_source(spark, tmp_path):
    """Returns of all tickers change, also of those whose second source says otherwise."""
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.01/*.parquet"):
        name = os.path.basename(p)[:-8]
        key = {"lineitem": "l_suppkey", "supplier": "s_suppkey"}.get(name)
        con.sql(f"COPY (SELECT * {f'REPLACE (50 * {key} + 7 AS {key})' if key else ''} FROM '{p}') TO '{tmp_path}/{name}.parquet'")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    ours = sorted(tuple(r) for r in QUERIES["rebuild_drift"](spark, str(tmp_path)).select("table", "what", "n").collect())
    assert ours == sorted(map(tuple, con.sql(ORACLES["rebuild_drift"]).fetchall()))

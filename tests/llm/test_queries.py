"""Every query with SQL equals that SQL; every query keeps its schema on an empty table."""

import pytest

from ledgerline.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ours = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    theirs = sorted(want.select(*cols).fetchall(), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_every_capture_has_a_verdict(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(None, None), (None, None), (None, "http://a.example/en"), (7, None)], "page_id long, url string")
    once = pages.unionByName(odd.distinct())
    once.write.parquet(f"{tmp_path}/once/pages.parquet")
    pages.unionByName(pages.limit(20)).unionByName(odd).write.parquet(f"{tmp_path}/twice/pages.parquet")
    op10 = QUERIES["op10_url_filters"]
    verdicts = {(r["page_id"], r["url"]): tuple(r) for r in op10(spark, f"{tmp_path}/once").collect()}
    got = op10(spark, f"{tmp_path}/twice").collect()
    assert len(verdicts) == once.count() and len(got) == pages.count() + 24
    assert all(tuple(r) == verdicts[r["page_id"], r["url"]] for r in got)

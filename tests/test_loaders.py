"""Loaders, caches, workbooks, builds and report texts by hand-worked cases."""

from datetime import date

import pytest

from ledgerline.config import Config
from ledgerline.operators import markdown, runs, stats
from ledgerline.plans import jobs
from ledgerline.plans.loaders import TOML, workbook
from ledgerline.sources import files, incremental, tables, zips


def test_missing_and_wrong_overrides(spark, tmp_path):
    uri = f"file://{tmp_path}/o.csv"
    assert tables.overrides(spark, uri, "ticker string, source string").count() == 0 and tables.optional(spark, uri) is None
    (tmp_path / "o.csv").write_text("ticker,source\nA,cover\nB,guess\n")
    assert tables.overrides(spark, uri, "ticker string, source string").count() == 2
    with pytest.raises(ValueError, match="guess"):
        tables.overrides(spark, uri, "ticker string, source string", "source", tables.SHARE_SOURCES)


def test_cache_follows_its_stamp(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    uri = f"file://{tmp_path}/cache"
    built = [tables.cached(spark, uri, stamp, build)[1] for stamp in ("a", "a", "b", "b")]
    assert built == [True, False, True, False] and len(made) == 2
    assert tables.cached(spark, uri, "b", build)[0].columns == ["id"]


def test_tag_maps():
    base = tables.tag_map(TOML)
    assert tables.of_kind(base, "flow") == ["c1", "c3"] and tables.tag_map_problems(base, base) == []
    longer = {**base, "c1": (["Tag0", "Tag1", "Tag9"], "flow"), "c9": (["x"], "stock")}
    assert tables.tag_map_problems(base, longer) == []
    assert tables.tag_map_problems(base, {**base, "c1": (["Tag0", "Tag1"], "stock")}) == ["c1: kind changed"]


def test_quarters(spark):
    assert [r[0] for r in tables.quarters(spark, (2019, 3), date(2020, 4, 1)).collect()] == ["2019q3", "2019q4", "2020q1", "2020q2"]
    assert tables.quarters(spark, (2021, 1), date(2020, 4, 1)).count() == 0


def test_workbook(spark):
    content = workbook("S", [["x"], ["DATE", "AUS", "USA"], ["01/31/2020", "1", "0.5"], ["02/29/2020", "1", ""], ["no", "1", "2"]])
    other = workbook("S", [["DATE", "USA", "AUS"], ["03/31/2021", "2.5", "1"], ["04/30/2021", "n/a", "1"]])
    cells = tables.sheet_cells(spark.createDataFrame([("a", content), ("b", other)], "path string, content binary"), "S")
    assert sorted(tuple(r) for r in tables.dated_column(cells, "USA", "bab").collect()) == [(date(2020, 1, 31), 0.5), (date(2021, 3, 31), 2.5)]
    with pytest.raises(ValueError, match="no sheet"):
        tables.sheet(content, "T")


def test_optional_inputs_join(spark, tmp_path):
    tree = jobs.Tree(spark, f"file://{tmp_path}/tree")
    month = date(2020, 1, 31)
    tree.save("factors", spark.createDataFrame([(month, 0.1)], "month date, mkt_rf double"))
    tree.save("returns_monthly", spark.createDataFrame([], "month date, ticker string, ret_fwd double"))
    found = jobs.load_inputs(tree, {}, frozenset())
    assert found.sectors is None and found.caps is None and found.terminal is None and found.factors.columns == ["month", "mkt_rf"]
    tree.save("betting", spark.createDataFrame([(month, 0.2)], "month date, bab double"))
    assert [tuple(r) for r in jobs.load_inputs(tree, {}, frozenset()).factors.collect()] == [(month, 0.1, 0.2)]


def test_builds_that_differ(spark, tmp_path):
    trees = [jobs.Tree(spark, f"file://{tmp_path}/{x}") for x in "ab"]
    for tree, x in zip(trees, (1.0, 1.5)):
        tree.save("t", spark.createDataFrame([(1, x), (2, 2.0)], "k int, x double"))
    assert [tuple(r) for r in jobs.drift(spark, *trees, {"t": ["k"]}).collect()] == [("t", "values of x", 1)]


def test_second_source_in_a_build(spark, tmp_path):
    """A ticker that we lack comes from the other source, and one whose returns are in conflict."""
    days = [date(2000, m, 28) for m in (1, 2, 3, 4)]
    rows = lambda t, px: [(t, d, x, x, 1.0) for d, x in zip(days, px)]
    frame = lambda x: spark.createDataFrame(x, "ticker string, date date, close double, adj_close double, volume double")
    ours = frame(rows("A", (10.0, 11.0, 12.0, 13.0)) + rows("B", (10.0, 10.0, 10.0, 10.0)))
    second = frame(rows("A", (10.0, 11.0, 12.0, 14.0)) + rows("B", (10.0, 20.0, 21.0, 22.0)) + rows("C", (5.0, 5.0, 5.0, 5.0)))
    members = spark.createDataFrame([(t, t, date(1999, 1, 1), None) for t in "ABC"], "ticker string, security string, start date, end date")
    tree = jobs.Tree(spark, f"file://{tmp_path}/build")
    jobs.price_panel(tree, ours, second, members, Config())
    last = {r["ticker"]: r["close"] for r in tree.read("prices_daily").where("date = date'2000-04-28'").collect()}
    assert last == {"A": 13.0, "B": 22.0, "C": 5.0}


def test_identity_windows_end_with_the_study(spark):
    rows = [("A", date(2000, 1, 1), None, "name", True), ("B", date(2000, 1, 1), date(2001, 1, 1), "", False)]
    flags = spark.createDataFrame(rows, "ticker string, member_start date, member_end date, reason string, flag boolean")
    assert [tuple(r) for r in tables.identity_windows(flags, date(2005, 12, 31)).collect()] == [("A", date(2000, 1, 1), date(2005, 12, 31), "name", "identity")]


def test_single_fit_equals_least_squares(spark):
    import numpy as np

    dice = np.random.default_rng(1)
    x = dice.normal(0, 1, 50)
    y = 0.3 + 0.7 * x + dice.normal(0, 1, 50) * (1 + x**2)
    got = runs.single_fit(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double"), "y", "x", ("k",)).first()
    design = np.stack([np.ones(50), x], axis=1)
    bread = np.linalg.inv(design.T @ design)
    coef = bread @ design.T @ y
    e = y - design @ coef
    se = np.sqrt(np.diag(bread @ (design.T * e**2) @ design @ bread))
    assert got["alpha"] == pytest.approx(12 * coef[0]) and got["beta"] == pytest.approx(coef[1])
    assert (got["alpha_t"], got["beta_t"]) == pytest.approx(tuple(coef / se)) and got["r2"] == pytest.approx(1 - e.var() / y.var())


def test_report_texts(spark):
    df = spark.createDataFrame([("b", 1.234, None), ("a", 2.0, 3)], "f string, x double, n int")
    assert markdown.table(df, ["f"]) == "| f | x | n |\n| --- | --- | --- |\n| a | 2.00 | 3 |\n| b | 1.23 | n/a |"
    assert markdown.fill("x <!--cov:k-->old<!--/cov--> y", {"k": "7"}) == "x <!--cov:k-->7<!--/cov--> y"
    with pytest.raises(KeyError):
        markdown.fill("<!--cov:z--><!--/cov-->", {})
    assert markdown.report("T", {"A": "x", "B": ""}) == "# T\n\n## A\n\nx\n"


def test_zip_members_line_by_line(spark, tmp_path):
    import zipfile

    head = "adsh\tcik\tname\tsic\tform\tperiod\tfy\tfp\tfiled\taccepted\tinstance"
    row = "a{0}\t{0}\tThe \"N\"\t\t10-K\t20200131\t2020\tFY\t20200301\t2020-03-01 10:00:00.0\ti.xml"
    for q, n in (("q1", 50), ("q2", 3)):
        with zipfile.ZipFile(tmp_path / f"{q}.zip", "w") as z:
            z.writestr("sub.txt", "\r\n".join([head, *(row.format(f"{i}") for i in range(n)), "short\tline"]) + "\r\n")
            z.writestr("num.txt", "x\n")
    lines = zips.zip_lines(spark, f"file://{tmp_path}/*.zip", r"^sub\.txt$", batch_lines=7)
    assert lines.count() == 57
    rows, malformed = files.tab_lines(lines, files.SUB)
    assert rows.columns == [x.split()[0] for x in files.SUB.split(",")] and rows.count() == 53
    assert rows.where("sic is null and name = 'The \"N\"'").count() == 53 and sorted(r[1] for r in malformed.collect()) == [1, 1]
    assert files.filing_index(rows).count() == 50


def test_zip_members_are_partitions_and_stream(tmp_path, spark):
    """A member of 200 MB is read in batches; members are partitions of their own; several paths, folders and none."""
    import tracemalloc
    import zipfile

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("num.txt", "w") as out:
        out.write(b"head\n")
        for _ in range(200):
            out.write((b"a" * 999 + b"\n") * 1000)
        z_small = zipfile.ZipFile(tmp_path / "small.zip", "w")
    with z_small as z:
        z.writestr("num.txt", "head\nx")
        z.writestr("sub.txt", "head\n")
    reader = zips.ZipReader({"path": f"file://{tmp_path}/*.zip", "member": r"\.txt$", "batchlines": "1000"})
    parts = reader.partitions()
    assert [(p.path.rsplit("/", 1)[1], p.name) for p in parts] == [("big.zip", "num.txt"), ("small.zip", "num.txt"), ("small.zip", "sub.txt")]
    tracemalloc.start()
    lines = sum(b.num_rows for b in reader.read(parts[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 200_001 and peak < 20e6
    df = zips.zip_lines(spark, [f"{tmp_path}/small.zip", f"file://{tmp_path}/none*.zip"], "num")
    assert [(r["member"], r["n"], r["line"]) for r in df.orderBy("n").collect()] == [("num.txt", 0, "head"), ("num.txt", 1, "x")]
    assert zips.zip_lines(spark, f"file://{tmp_path}/none", "num").count() == 0


def test_refresh_builds_stale_parts_only(spark, tmp_path):
    uri, built = f"file://{tmp_path}/t", []
    source = {"a": [1, 2], "b": [3], "c": []}

    def build(stale):
        names = [r["part"] for r in stale.collect()]
        built.append(sorted(names))
        return spark.createDataFrame([(n, x) for n in names for x in source[n]], "part string, x long")

    def run(**stamps):
        held, now = incremental.refresh(spark, uri, spark.createDataFrame([(p, "of " + p, s) for p, s in stamps.items()], "part string, path string, stamp string"), build)
        return sorted((r["part"], r["x"]) for r in held.collect()), sorted(r["part"] for r in now.collect())

    assert run(a="1", b="1", c="1") == ([("a", 1), ("a", 2), ("b", 3)], ["a", "b", "c"])
    source["b"] = [4, 5]
    assert run(a="1", b="2", c="1") == ([("a", 1), ("a", 2), ("b", 4), ("b", 5)], ["b"])
    source["b"] = []
    assert run(a="1", b="3", c="1") == ([("a", 1), ("a", 2)], ["b"])  # a part that has become empty
    assert run(a="1", b="3") == ([("a", 1), ("a", 2)], [])
    assert run(b="3") == ([], [])  # a part that is wanted no more
    broken = dict(source)
    source.clear()
    with pytest.raises(KeyError):
        run(a="9", b="3")
    source.update(broken)
    assert run(a="1", b="3") == ([("a", 1), ("a", 2)], ["a"])  # a broken run's part is built again, under the old stamp too
    assert built[-1] == ["a"]


def test_tag_map_changes_as_tables(spark):
    kinds = "concept string, tags array<string>, kind string"
    base = [("a", ["x", "y"], "flow"), ("b", ["x"], "stock"), ("c", ["z"], "flow"), ("d", ["p", "q"], "flow")]
    head = [("a", ["x", "y", "w"], "flow"), ("b", ["x"], "flow"), ("d", ["q", "p"], None), ("e", ["n"], "flow")]
    got = sorted(r[0] for r in tables.tag_map_changes(spark.createDataFrame(base, kinds), spark.createDataFrame(head, kinds)).collect())
    as_dict = lambda rows: {n: (t, k) for n, t, k in rows}
    assert got == ["b: kind changed", "c: concept removed", "d: existing tags removed or reordered", "d: kind changed"] == sorted(tables.tag_map_problems(as_dict(base), as_dict(head)))


def test_a_broken_build_goes_on_where_it_failed(spark, tmp_path):
    """Steps that ended are not done again; a changed step takes those that follow it with it."""
    root, x = f"file://{tmp_path}/tree", spark.range(3).selectExpr("id AS x")
    done = []

    def run(middle, stamp=""):
        tree = jobs.Tree(spark, root)
        tree.step("a", lambda: done.append("a") or x, stamp=stamp)
        tree.step("b", lambda: done.append("b") or middle(tree.read("a")), "a")
        out = tree.step("c", lambda: done.append("c") or tree.read("b").where("x > 0"), "b")
        tree.step("d", lambda: done.append("d") or x)
        return sorted(r[0] for r in out.collect()), tree.built

    with pytest.raises(Exception, match="nothing"):
        run(lambda a: a.select("nothing"))
    assert done == ["a", "b"]
    assert run(lambda a: a.selectExpr("x + 1 AS x")) == ([1, 2, 3], ["b", "c", "d"])
    assert run(lambda a: a) == ([1, 2, 3], [])  # nothing has changed its stamp
    assert run(lambda a: a.where("x = 2"), "other") == ([2], ["a", "b", "c"])


def test_figures_are_filled_by_key(spark):
    texts = spark.createDataFrame([("a", "x <!--cov:k-->old\nold<!--/cov--> y <!--cov:n.1--><!--/cov-->"), ("b", "plain"), ("c", "")], "name string, text string")
    values = spark.createDataFrame([("k", "1.5"), ("n.1", "$2\\"), ("unused", "9")], "key string, value string")
    got = {r["name"]: r["text"] for r in markdown.filled(texts, values).collect()}
    assert got == {r["name"]: markdown.fill(r["text"], {"k": "1.5", "n.1": "$2\\"}) for r in texts.collect()}
    with pytest.raises(Exception, match="nothing computes k"):
        markdown.filled(texts, values.where("key <> 'k'")).collect()


def test_report_lines(spark):
    df = spark.createDataFrame([("b", 1.235, None), ("a", float("nan"), 3), (None, -0.001, 4)], "f string, x double, n int")
    doc = markdown.document("T", {"One": markdown.lines(df, ["f"]), "Two": markdown.lines(df.limit(0), ["f"], {"x": 1})})
    assert [r["line"] for r in doc.orderBy("section", "at").collect()] == ["# T", "## One", "| f | x | n |", "| --- | --- | --- |", "| n/a | 0.00 | 4 |", "| a | n/a | 3 |", "| b | 1.24 | n/a |", "## Two", "| f | x | n |", "| --- | --- | --- |"]

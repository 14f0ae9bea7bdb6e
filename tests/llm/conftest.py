import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("node", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("probability", "sampled", "__n_lines", "__source", "rid", "shard", "rank", "part", "salt", "digest")])
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(120))
#: Null columns, empty and long texts, ties, repeated rows, odd white space, and extra columns whose names clash with inner ones.
ODD = [
    (1, None, None, None, None, "k", 1), (2, "", "en", "s", 0, None, None), (3, " \t\n ", "en", None, 4, "k", 2), (4, BASE, "en", "s", 1, "k", 3), (5, BASE, None, "s", 1, "k", 3),
    (6, BASE + " omega", "en", "s", 1, "k", 3), (7, BASE.replace("alpha7 ", "ALPHA7 "), "en", "t", 1, "k", 3), (8, LONG, "de", "t", 1, "k", 4), (9, "one two", "de", "t", 7, "k", 5), (10, "One\x0btwo", "de", "t", 7, "k", 5),
    (11, "A shared line here\nown line of eleven\n\nA shared line here ", "en", "s", 1, "k", 6), (12, "a SHARED line here\nshort\nÉcole de la mer ", "fr", "s", 1, "k", 6), (13, "école de la mer \nÉcole de la mer ", "fr", "s", 1, "k", 6),
    (14, "12345 67890 !!", "en", "s", 1, "k", 7), (15, "\x1c\x85  x́ <|endoftext|> #*$%", "en", "s", 1, "k", 7), (16, "日本語 のテキスト", None, "u", 1, "k", 8), (9, "one two", "de", "t", 7, "k", 5), (17, "x" * 70_000, "en", "s", 1, "k", 9),
    (None, None, None, None, None, None, None), (None, "one two", "de", "t", 7, "k", 5), (None, BASE, "en", "s", 1, "k", 3), (None, BASE, "en", "s", 1, "k", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, *range(len(SCHEMA) - len(r))) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    return [tuple(r) for r in df.collect()]

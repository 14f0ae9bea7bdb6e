"""A read-only SQL surface over a folder of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LIMIT = 500
_READ = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name!r} is no name for a view")
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, limit: int = LIMIT) -> Result:
    """Rows of one SELECT, at most ``limit`` of them, and whether there were more: the surface is for looking."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL).strip().rstrip(";")
    if not _READ.match(bare) or re.search(r"\b(insert|create|drop|alter|truncate|delete|merge|update)\b\s+\w", bare, re.IGNORECASE):
        raise ValueError("only SELECT or WITH")
    df = spark.sql(bare)
    rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    return Result(df.columns, rows[:limit], len(rows) > limit)

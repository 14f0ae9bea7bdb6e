"""URL filters as a temporal list join.

A list is a history of dated entries that add or remove a pattern under a
category. The entries of each pattern and category become validity intervals of
their own, and every capture is joined, as of its fetch day, to the intervals of
the patterns that can match it: its host, the host's parent domains and the
prefixes of host and path at each slash, as deep as the list's own patterns go.
The join is on equal patterns with the day inside the interval. What travels is a
digest of the URL; captures of one URL and day are judged once and the verdict is
joined back to each. A hot host or pattern is dealt over ``SALTS`` keys, against
as many copies of the list's intervals.

Edge cases: null or unparsable URLs match nothing and pass, and so does a null
day; an entry applies from its day on, and of entries of one pattern and category
on one day the last in order of (day, seq) decides; a removal without an addition
has no effect; a pattern may be on the list under several categories, of which the
last in order names a capture; repeated captures each have a row; an empty list
passes everything; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    found = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 1), r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(found != "", found)


def patterns(url: Column, labels_most: int, steps_most: int) -> Column:
    """Every pattern of at most so many host labels or path steps that matches the URL, host first."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.when(F.size(labels) > 2, F.transform(F.sequence(F.greatest(F.lit(2), F.size(labels) - labels_most + 1), F.greatest(F.lit(2), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.slice(F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != ""), 1, max(1, steps_most))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(name.isNotNull(), F.array_distinct(F.concat(F.array(name), F.coalesce(parents, none), F.coalesce(paths, none))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, first_day, end_day) from entries (pattern, category, day, seq, active); the end is open."""
    by = Window.partitionBy("pattern", "category").orderBy("day", "seq")
    spans = entries.select("pattern", "category", F.col("day").alias("first_day"), "active", F.lead("day").over(by).alias("end_day"))
    return spans.where("active and (end_day is null or end_day > first_day)").drop("active")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(id, url, day, n_active, category, pattern, kept), a row for each capture: the most specific active entry names the category."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).alias("day")).withColumn("digest", F.unhex(F.md5(F.col("url").cast("binary"))))
    depth = entries.agg(F.max(F.size(F.split(F.split("pattern", "/")[0], r"\."))).alias("labels"), F.max(F.size(F.split("pattern", "/")) - 1).alias("steps")).first()
    once = rows.where("url is not null and day is not null").groupBy("digest", "day").agg(F.min("url").alias("url"))
    keyed = once.select("digest", "day", F.explode(patterns(F.col("url"), depth["labels"] or 1, depth["steps"] or 0)).alias("key")).withColumn("salt", F.pmod(F.xxhash64("digest", "day"), F.lit(SALTS)).cast("int")).alias("c")
    spans = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("s")
    on = (F.col("c.key") == F.col("s.pattern")) & (F.col("c.salt") == F.col("s.salt")) & (F.col("c.day") >= F.col("s.first_day")) & (F.col("s.end_day").isNull() | (F.col("c.day") < F.col("s.end_day")))
    hit = F.struct(F.char_length("s.pattern").alias("len"), F.col("s.pattern").alias("pattern"), F.col("s.category").alias("category"))
    found = keyed.join(spans, on).groupBy("c.digest", "c.day").agg(F.count("*").alias("n"), F.max(hit).alias("best"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.join(found, ["digest", "day"], "left").select("id", "url", "day", n.alias("n_active"), "best.category", "best.pattern", (n == 0).alias("kept"))

"""The append-only log of specifications, and what can be read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.names import KEY_FIELDS, sector_neutral_of, spec_key_of_columns, spec_kind, variant_of
from ledgerline.operators.asof import asof_forward_all
from ledgerline.sources.store import settled

# The columns of the log, in order.
COLUMNS = ("timestamp", "factor", "signal", "weighting", "cost_bps", "lag_days", "rebalance", "holding_months", "winsor_lo", "winsor_hi", "n_deciles", "start", "end", "sharpe_gross", "sharpe_net", "note", "config_hash", "git_commit", "kind", "sector_neutral", "variant", "spec_key")
SAME_RUN = ("spec_key", "git_commit", "note")
SCHEMA = ", ".join(f"`{c}` string" for c in COLUMNS)


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The first row of each run; an empty log if there is none yet.

    The same specification, commit and note is the same run. Writers that did not see
    each other may both have added one: what was written first, then the smaller
    row, stands for it, so a run never counts twice.
    """
    try:
        rows = spark.read.schema(f"{SCHEMA}, __at string").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], f"{SCHEMA}, __at string")
    first = F.row_number().over(Window.partitionBy(*SAME_RUN).orderBy("__at", *COLUMNS))
    rows = rows.withColumn("__r", first).where("__r = 1").select(*COLUMNS)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def upgrade(rows: DataFrame) -> DataFrame:
    """Rows of an older log with the columns that have come since, worked out from the note."""
    made = {"kind": spec_kind("note"), "sector_neutral": sector_neutral_of("note"), "variant": variant_of("note", "signal")}
    for name, value in made.items():
        old = F.nullif(F.col(name), F.lit("")) if name in rows.columns and name != "variant" else F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(old, value))
    missing = [c for c in COLUMNS if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*COLUMNS)


def append(spark: SparkSession, path: str, runs: list[dict[str, object]] | DataFrame) -> int:
    """Adds runs that the log does not have, from a list or a table, and says how many; see ``read`` for runs that two writers add at once.

    A task writes its file whole or not at all, and nothing that is there is
    touched, so a writer that fails or is repeated leaves a log that reads the same.
    """
    if not isinstance(runs, DataFrame):
        runs = spark.createDataFrame([tuple(None if run.get(c) is None else str(run[c]) for c in COLUMNS) for run in runs], SCHEMA)
    held = runs.select(*(F.col(c).cast("string").alias(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))
    first = F.row_number().over(Window.partitionBy(*SAME_RUN).orderBy(*COLUMNS))
    new = upgrade(held.withColumn("spec_key", spec_key_of_columns())).withColumn("__r", first).where("__r = 1").drop("__r")
    old = read(spark, path)
    fresh = settled(new.join(old.select(*SAME_RUN), [new[c].eqNullSafe(old[c]) for c in SAME_RUN], "left_anti"), "runs")
    n = fresh.count()
    if n:
        fresh.withColumn("__at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.mode("append").parquet(path)
    return n


def counts(log: DataFrame) -> DataFrame:
    """(kind, rows, trials): rows, and distinct specifications, of each kind and of all."""
    out = log.rollup("kind").agg(F.grouping("kind").alias("__all"), F.count("*").alias("rows"), F.countDistinct("spec_key").alias("trials"))
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col("kind")).alias("kind"), "rows", "trials")


def latest_per_key(log: DataFrame) -> DataFrame:
    """The last row of each specification, with ``first_seen``, the time of its first."""
    last = F.row_number().over(Window.partitionBy("spec_key").orderBy(F.col("timestamp").desc(), F.col("note").desc()))
    return log.withColumns({"__r": last, "first_seen": F.min("timestamp").over(Window.partitionBy("spec_key"))}).where("__r = 1").drop("__r")


def trial_variance(log: DataFrame) -> DataFrame:
    """(kind, n, variance) of the monthly net Sharpe over the latest rows."""
    monthly = F.col("sharpe_net").try_cast("double") / 12**0.5
    out = latest_per_key(log).rollup("kind").agg(F.grouping("kind").alias("__all"), F.count("*").alias("n"), F.var_samp(monthly).alias("variance"))
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n", "variance")


def classify(log: DataFrame, reported: list[str], key: tuple[str, ...] = ("factor", "signal", "weighting", "holding_months", "no_sector", "n_deciles")) -> DataFrame:
    """``log`` with ``status``: abandoned, superseded by a later run of the same key, or current."""
    rows = log.withColumn("no_sector", F.contains(F.coalesce("note", F.lit("")), F.lit("no-sector")))
    last = F.max("timestamp").over(Window.partitionBy(*key))
    status = F.when(~F.col("factor").isin(reported), "abandoned").when(F.col("timestamp") < last, "superseded").otherwise("current")
    return rows.withColumn("status", status)


def superseding_commit(log: DataFrame, commits: DataFrame) -> DataFrame:
    """``log`` with the first commit (when, sha, subject) strictly after each row."""
    rows = log.withColumn("__when", F.to_timestamp("timestamp"))
    return asof_forward_all(rows, commits, "__when", "when", ["when", "sha", "subject"]).drop("__when")


def lines(log: DataFrame) -> DataFrame:
    """(status, line) of classified rows with the commit after them: when, which run, its note and what followed."""
    no_sector = F.when(F.contains(F.coalesce("note", F.lit("")), F.lit("no-sector")), ", no-sector").otherwise("")
    run = [F.col("timestamp"), F.lit(" `"), F.col("factor"), F.lit("` ("), F.col("signal"), F.lit(", "), F.col("weighting"), F.lit(", hold "), F.col("holding_months"), no_sector, F.lit(") net Sharpe ")]
    after = F.coalesce(F.concat(F.col("sha"), F.lit(' "'), F.col("subject"), F.lit('"')), F.lit("no commit after it yet"))
    return log.select("status", F.concat(*run, F.coalesce("sharpe_net", F.lit("n/a")), F.lit(', "'), F.col("note"), F.lit('" → '), after).alias("line"))

"""Joins on what was known at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str], tie_break: list[Column] | None = None) -> DataFrame:
    """``left`` with the payload of the last right row at or before ``left_on``, nulls if there is none.

    Both sides go through one shuffle by key and one sorted window, so rows grow
    as the sum of the sides. Of right rows of one time, the last by ``tie_break``
    (ascending, over right columns) counts.
    """
    breaks = tie_break or []
    names = [f"__k{i}" for i in range(len(breaks))]
    values = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*payload).alias("__v"), *(b.alias(n) for b, n in zip(breaks, names, strict=True)))
    probes = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*(F.col(c) for c in left.columns)).alias("__row"))
    order = Window.partitionBy(*by).orderBy("__t", "__side", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = values.unionByName(probes, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    return both.where("__side = 1").select("__row.*", *(F.col(f"__v.{p}").alias(p) for p in payload))


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str]) -> DataFrame:
    """``left`` with the payload of the first right row strictly after ``left_on``."""
    values = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*payload).alias("__v"))
    probes = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.struct(*(F.col(c) for c in left.columns)).alias("__row"))
    order = Window.partitionBy(*by).orderBy(F.col("__t").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # going down in time, a value of the same time comes after its probe and so does not reach it
    both = values.unionByName(probes, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    return both.where("__side = 1").select("__row.*", *(F.col(f"__v.{p}").alias(p) for p in payload))


def _by_year(left: DataFrame, right: DataFrame, left_on: str, right_on: str, back: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides under ``__year``; a year of the left side also gets the right row that is carried into it from the nearest other year."""
    left = left.withColumn("__year", F.year(left_on))
    right = right.where(F.col(right_on).isNotNull()).withColumn("__year", F.year(right_on))
    pick = F.max_by if back else F.min_by
    row = F.struct(*right.columns)
    yearly = right.groupBy("__year").agg(pick(row, right_on).alias("__row"), (F.max if back else F.min)(right_on).alias("__t"))
    wanted = left.select(F.col("__year").alias("__to")).distinct()
    near = F.col("__year") < F.col("__to") if back else F.col("__year") > F.col("__to")
    # both are lists of years
    carried = wanted.join(F.broadcast(yearly), near).groupBy("__to").agg(pick("__row", "__t").alias("__row")).select("__row.*", "__to").drop("__year").withColumnRenamed("__to", "__year")
    return left, right.unionByName(carried)


def asof_backward_all(left: DataFrame, right: DataFrame, left_on: str, right_on: str, payload: list[str]) -> DataFrame:
    """``asof_backward`` without a key: years are told apart, so no task gets all rows."""
    a, b = _by_year(left, right, left_on, right_on, True)
    return asof_backward(a, b, ["__year"], left_on, right_on, payload).drop("__year")


def asof_forward_all(left: DataFrame, right: DataFrame, left_on: str, right_on: str, payload: list[str]) -> DataFrame:
    """``asof_forward`` without a key: years are told apart, so no task gets all rows."""
    a, b = _by_year(left, right, left_on, right_on, False)
    return asof_forward(a, b, ["__year"], left_on, right_on, payload).drop("__year")


def first_filed(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The earliest filing of every fact; of one day, by filing, tag if there is one, then the larger value."""
    keys = keys or ["cik", "concept", "ddate", "qtrs"]
    order = [F.col("filed").asc(), F.col("adsh").asc(), *([F.col("tag").asc()] if "tag" in facts.columns else []), F.col("value").desc()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return facts.withColumn("__r", rank).where("__r = 1").drop("__r")


def known_by(panel: DataFrame, values: DataFrame, buffer_days: int, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """(panel.*, value, period_end, available_from): the newest period known at each month.

    A filing about an older period than one already filed is passed over; a value
    is available ``buffer_days`` after it was filed. Of values that become
    available together the later period counts, then the larger value.
    """
    by = by or ["cik"]
    so_far = Window.partitionBy(*by).orderBy("filed", "ddate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = values.withColumn("__newest", F.max("ddate").over(so_far)).where(F.col("ddate") >= F.col("__newest"))
    ready = fresh.select(*by, F.col(value).alias("value"), F.col("ddate").alias("period_end"), F.date_add("filed", buffer_days).alias("available_from"))
    return asof_backward(panel, ready, by, "month", "available_from", ["value", "period_end", "available_from"], [F.col("period_end"), F.col("value")])


def assert_point_in_time(df: DataFrame, column: str = "available_from") -> DataFrame:
    """``df``; evaluating a row that was not known at its month is an error."""
    late = F.col(column) > F.col("month")
    return df.withColumn(column, F.when(F.coalesce(late, F.lit(False)), F.raise_error(F.concat(F.lit("not known yet at "), F.col("month").cast("string"))).cast("date")).otherwise(F.col(column)))

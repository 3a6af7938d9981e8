"""Exact quantiles of large groups: range-partitioned counts of values, prefix sums, and only the ranks that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_counts(counts: DataFrame, scope: str, value: str) -> DataFrame:
    """counts: scope, value, n (a row for each value) -> also part, start (rows of the scope before this value) and total.

    Values are dealt by ranges, so a scope of any size is spread over tasks: ranges are summed first, then each adds up
    its own values. The deal is written, for it need not cut its ranges alike twice.
    """
    from ..sources.scratch import saved

    cut = saved(counts.repartitionByRange(scope, value).withColumn("part", F.spark_partition_id()), "value-counts")
    per = cut.groupBy(scope, "part").agg(F.sum("n").alias("here"))  # a row for each scope and range
    before = Window.partitionBy(scope).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("past", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn("total", F.sum("here").over(Window.partitionBy(scope)))
    inside = Window.partitionBy(scope, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return cut.join(per.select(scope, "part", "past", "total"), [scope, "part"]).withColumn("start", F.col("past") + F.col("inside")).drop("past", "inside")


def exact_quantiles(rows: DataFrame, scope: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """rows: scope and value -> scope, point, value: exact quantiles with linear interpolation between ranks.

    Null values don't count; a scope without others has no rows. Rows are counted by value on the way (partial sums), and
    no task holds a scope: of the counts, only those at the ranks around each point are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(scope, value).agg(F.count(F.lit(1)).alias("n"))
    return counted_quantiles(counts, scope, value, points)


def counted_quantiles(counts: DataFrame, scope: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """exact_quantiles() of rows that are counted already (n)."""
    at = prefix_counts(counts, scope, value)
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("point"), place(p).alias("place")) for p in points])
    # a value holds the ranks start .. start + n - 1; a point needs the ranks below and above its place
    low, high = F.floor("place"), F.ceil("place")
    holds = lambda r: (F.col("start") <= r) & (r < F.col("start") + F.col("n"))
    near = at.select(scope, value, "start", "n", F.explode(ranks).alias("q")).select(scope, value, "start", "n", "q.*").where(holds(low) | holds(high))
    ends = near.groupBy(scope, "point", "place").agg(F.max(F.when(holds(low), F.col(value))).alias("low"), F.max(F.when(holds(high), F.col(value))).alias("high"))
    return ends.select(scope, "point", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias(value))

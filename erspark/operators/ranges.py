"""Running sums over an order that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into, at quantiles of the values.
RANGES = 64


def cumulative(df: DataFrame, value: str, count: str, *by: str, descending: bool = False, n: int = RANGES) -> DataFrame:
    """Adds ``before``: the sum of ``count`` over the group's rows with an earlier value.

    Values are cut into ranges at constant quantiles; a window runs inside each range,
    and the ranges' totals, a few rows, give the offsets.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] or []))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    ranged = df.withColumn("_range", -at if descending else at)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = F.sum(count).over(Window.partitionBy(*by, "_range").orderBy(order)) - F.col(count)
    totals = ranged.groupBy(*by, "_range").agg(F.sum(count).alias("_n"))
    start = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(*by, "_range", (F.sum("_n").over(start.orderBy("_range")) - F.col("_n")).alias("_offset"))
    joined = ranged.withColumn("before", inside).join(F.broadcast(offsets) if not by else offsets, [*by, "_range"])
    return joined.withColumn("before", F.col("before") + F.col("_offset")).drop("_range", "_offset")

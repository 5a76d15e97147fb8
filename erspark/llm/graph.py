"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, apart


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the smallest one: of all larger neighbours, or of all smaller."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(apart(least), "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    down = both.filter("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(apart(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame, ws: Workspace) -> DataFrame | None:
    """(node, root) of all nodes of (a, b) links; None if there are no links.

    Each step writes its links to the workspace, so lineage stays short. Counts are
    combined before the shuffle, and a hub's rows are dealt out by the skew join.
    """
    seen, step, last = None, 0, edges.filter("a <> b")
    while True:
        now = ws.save(_star(_star(last, True), False), f"links-{step}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] == 0:
            return None
        if step > 1:
            ws.drop(f"links-{step - 2}")
        if state == seen:  # only stars are left, and they do not change
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen, last, step = state, now, step + 1

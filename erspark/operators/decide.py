"""Decision rules over scored pairs (qi, pj, p), and their tuning.

Ties in p go to the smaller qi, then the smaller pj, everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

#: Decimal steps are given as whole numbers over a divisor, so that grids are exact.
def steps(first: int, last: int, step: int, divisor: int) -> list[float]:
    return [x / divisor for x in range(first, last + 1, step)]


# The parameter grids of the rules.
GRIDS: dict[str, list[tuple[float, ...]]] = {
    "threshold": [(t,) for t in steps(300, 950, 25, 1000)],
    "top1_plus": [(a, b) for a in steps(1, 7, 1, 10) for b in steps(50, 95, 5, 100) if b >= a],
    "relative": [(t, r) for t in steps(30, 85, 5, 100) for r in (0.5, 0.7, 0.8)],
    "expected_f": [(0.0,), (0.05,), (0.1,), (0.2,)],
    "gated": [(e, a, b) for e in steps(0, 8, 1, 10) for a in steps(2, 6, 1, 10) for b in steps(60, 85, 5, 100)],
}


def one_to_one(scored: DataFrame) -> DataFrame:
    """Each pool row's best claim."""
    order = Window.partitionBy("pj").orderBy(F.col("p").desc(), F.col("qi").asc())
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def prepared(scored: DataFrame) -> DataFrame:
    """One-to-one claims with rank, best p, running and total p, and the log of no match at all."""
    by = Window.partitionBy("qi")
    order = by.orderBy(F.col("p").desc(), F.col("pj").asc())
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    miss = F.log(1 - F.greatest(F.lit(0.0), F.least(F.col("p"), F.lit(1 - 1e-6))))
    base = one_to_one(scored)
    return base.withColumn("r", F.row_number().over(order) - 1).withColumn("mx", F.max("p").over(by)).withColumn("s", F.sum("p").over(running)).withColumn("t", F.sum("p").over(by)).withColumn("l", F.sum(miss).over(by))


def threshold(p: DataFrame, t) -> DataFrame:
    return p.filter(F.col("p") >= _c(t))


def top1_plus(p: DataFrame, t1, t2) -> DataFrame:
    """The best claim from t1 on, further ones from t2 on."""
    return p.filter(((F.col("r") == 0) & (F.col("p") >= _c(t1))) | ((F.col("r") > 0) & (F.col("p") >= _c(t2))))


def relative(p: DataFrame, t, r) -> DataFrame:
    """At least t, and at least r times the best claim."""
    return p.filter((F.col("p") >= _c(t)) & (F.col("p") >= _c(r) * F.col("mx")))


def gated(p: DataFrame, te, t1, t2) -> DataFrame:
    """``top1_plus`` where the entity's own score e is at least te."""
    return top1_plus(p.filter(F.col("e") >= _c(te)), t1, t2)


def expected_f(p: DataFrame, c) -> DataFrame:
    """The first m claims with the best expected F0.5, if that beats predicting nothing."""
    keys = [k for k in ("g",) if k in p.columns]
    by = Window.partitionBy("qi", *keys)
    m = F.col("r") + 1
    scored = p.withColumn("_ef", 1.25 * F.col("s") / (0.25 * (F.col("t") + _c(c)) + m)).withColumn("_best", F.max("_ef").over(by))
    scored = scored.withColumn("_m", F.min(F.when(F.col("_ef") == F.col("_best"), m)).over(by))
    return scored.filter((m <= F.col("_m")) & (F.col("_best") > F.exp(F.col("l") - _c(c)))).drop("_ef", "_best", "_m")


RULES = {"threshold": threshold, "top1_plus": top1_plus, "relative": relative, "expected_f": expected_f, "gated": gated}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def apply(scored: DataFrame, rule: str, params: tuple[float, ...], entity: DataFrame | None = None) -> DataFrame:
    """Kept (qi, pj, p) of a named rule. entity: (qi, e) for the gated one."""
    p = prepared(scored)
    if entity is not None:
        p = p.join(entity, "qi")
    return RULES[rule](p, *params).select("qi", "pj", "p")


def grid_scores(scored: DataFrame, truth: DataFrame, rule: str, grid: list[tuple[float, ...]] | None = None, entity: DataFrame | None = None) -> DataFrame:
    """(g, params..., f05) of every grid point over the truth's entities (qi, k, and owner pairs in scored.tp).

    The grid is a short constant list beside each claim: one pass over the claims serves
    all points, and only hits per entity and point are summed.
    """
    grid = GRIDS[rule] if grid is None else grid
    names = [f"x{i}" for i in range(len(grid[0]))]
    points = F.array(*[F.struct(F.lit(i).alias("g"), *[F.lit(float(x)).alias(n) for n, x in zip(names, g, strict=True)]) for i, g in enumerate(grid)])
    p = prepared(scored)
    if entity is not None:
        p = p.join(entity, "qi")
    p = p.join(truth.select("qi", "k"), "qi")
    wide = p.select("*", F.inline(points))
    kept = RULES[rule](wide, *[F.col(n) for n in names])
    per = kept.groupBy("g", "qi").agg(F.count("*").alias("n"), F.sum(F.col("tp").cast("long")).alias("tp"), F.first("k").alias("k"))
    # Entities without a kept claim score 1 if they have no match and 0 otherwise.
    gained = per.groupBy("g").agg(F.sum(metrics.f05(F.col("k"), F.col("n"), F.col("tp"))).alias("got"), F.sum((F.col("k") == 0).cast("long")).alias("wrong"))
    all_ = truth.agg(F.count("*").alias("all"), F.sum((F.col("k") == 0).cast("long")).alias("single"))
    table = scored.sparkSession.createDataFrame([(i, *map(float, g)) for i, g in enumerate(grid)], "g int, " + ", ".join(f"{n} double" for n in names))
    joined = table.join(gained, "g", "left").join(F.broadcast(all_))
    f = (F.coalesce("got", F.lit(0.0)) + F.col("single") - F.coalesce("wrong", F.lit(0))) / F.col("all")
    return joined.select("g", *names, f.alias("f05"))


def best(scores: DataFrame) -> DataFrame:
    """The first grid point with the best score."""
    return scores.orderBy(F.col("f05").desc(), "g").limit(1)

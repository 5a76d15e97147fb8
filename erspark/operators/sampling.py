"""Filters, samples, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(key: Column, seed: int = 0) -> Column:
    """A stable number in [0, 1) from an id."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003


def portable_priority(key: Column) -> Column:
    """The same from integer arithmetic alone, for other engines to repeat."""
    return F.pmod(key * 7919 + 104729, F.lit(10007)) / 10007


def between(rows: DataFrame, lo: float, hi: float, prio: str = "prio") -> DataFrame:
    """lo <= prio < hi."""
    return rows.filter((F.col(prio) >= lo) & (F.col(prio) < hi))


def sample(rows: DataFrame, n: int, prio: Column, *ties: str) -> DataFrame:
    """n rows by a hash order: the same ones for any partitioning."""
    return rows.orderBy(prio, *ties).limit(n)


def stratified(rows: DataFrame, n: int, native: Column, prio: Column, share: float = 0.8, *ties: str) -> DataFrame:
    """At most share * n rows that are native and the rest of n that are not."""
    first = round(n * share)
    return sample(rows.filter(native), first, prio, *ties).unionByName(sample(rows.filter(~native), n - first, prio, *ties))


def universe(s1: DataFrame, pool: DataFrame, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """Entities by priority, all their matches, and the same share of ownerless rows; larger bounds hold smaller ones."""
    some = between(s1, lo, hi)
    owned = pool.filter("owner >= 0").join(some.select(F.col("qi").alias("owner")), "owner", "left_semi")
    rest = pool.filter("owner < 0").filter(portable_priority(F.col("pj")) < hi - lo)
    return some, owned.select(*pool.columns).unionByName(rest)


def random_negatives(truth_pairs: DataFrame, q: DataFrame, p: DataFrame, seed: int = 0) -> DataFrame:
    """One non-matching pool row of the same country per true pair.

    Both sides are numbered within their country; each pair points to a number by a hash,
    so this is an equi-join. Draws that hit a true pair are moved on by one, then dropped
    if they hit again.
    """
    numbered = p.select("pj", "country", (F.row_number().over(Window.partitionBy("country", F.pmod(F.xxhash64("pj"), F.lit(64))).orderBy("pj"))).alias("i"), F.pmod(F.xxhash64("pj"), F.lit(64)).alias("b"))
    sizes = numbered.groupBy("country", "b").agg(F.max("i").alias("n"))
    wanted = truth_pairs.join(q.select("qi", "country"), "qi").withColumn("b", F.pmod(F.xxhash64("qi", "pj", F.lit(seed)), F.lit(64))).join(sizes, ["country", "b"])
    wanted = wanted.withColumn("i", F.explode(F.array(*[F.pmod(F.xxhash64("pj", "qi", F.lit(seed + j)), F.col("n")) + 1 for j in range(2)])))
    drawn = wanted.select("qi", F.col("pj").alias("true_pj"), "country", "b", "i").join(numbered, ["country", "b", "i"]).select("qi", "true_pj", "pj")
    good = drawn.join(truth_pairs, ["qi", "pj"], "left_anti")
    return good.groupBy("qi", "true_pj").agg(F.min("pj").alias("pj")).select("qi", "pj").distinct()


def hard_negatives(ranked: DataFrame) -> DataFrame:
    """Each query's most similar pool row of another owner; rows have tp and rank."""
    order = Window.partitionBy("qi").orderBy("rank")
    return ranked.filter(~F.col("tp")).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def triplets(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(qi, pos, neg): every true pair with its query's hard negative."""
    return positives.select("qi", F.col("pj").alias("pos")).join(negatives.select("qi", F.col("pj").alias("neg")), "qi")


def dedupe(pairs: DataFrame) -> DataFrame:
    return pairs.dropDuplicates(["qi", "pj"])


def duplicate_rate(rows: DataFrame, *columns: str) -> Column:
    """Aggregate: share of rows that repeat an earlier one in the columns."""
    return (F.count("*") - F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))) / F.count("*")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qi, pj, kind) of pairs that one run has and the other has not."""
    added = new.select("qi", "pj").subtract(old.select("qi", "pj")).withColumn("kind", F.lit("added"))
    return added.unionByName(old.select("qi", "pj").subtract(new.select("qi", "pj")).withColumn("kind", F.lit("removed")))


def hooked(pairs: DataFrame, *extra: DataFrame) -> DataFrame:
    """Left joins further feature tables on (qi, pj)."""
    for e in extra:
        pairs = pairs.join(e, ["qi", "pj"], "left")
    return pairs

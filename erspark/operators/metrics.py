"""Scores of decisions and of candidate sets.

truth: (qi, country, fold, k). pairs: (qi, pj), with tp (boolean: pj belongs to qi).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import cumulative


def f05(k: Column, n: Column, tp: Column) -> Column:
    """F0.5 of one entity: 1 if nothing is due nor given, 0 if only one of both."""
    return F.when((k == 0) & (n == 0), 1.0).when((k == 0) | (n == 0), 0.0).otherwise(1.25 * tp / (0.25 * k + n))


def ceiling(k: Column, tp: Column) -> Column:
    """F0.5 of a perfect choice among the candidates."""
    return F.when(k == 0, 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (0.25 * k + tp))


def with_tp(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds tp: the pool row's owner is the entity."""
    return pairs.join(pool.select("pj", "owner"), "pj").withColumn("tp", F.col("owner") == F.col("qi")).drop("owner")


def per_entity(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """truth with n, tp and f05 of every entity, those without a pair too."""
    counts = pairs.dropDuplicates(["qi", "pj"]).groupBy("qi").agg(F.count("*").alias("n"), F.sum(F.col("tp").cast("long")).alias("tp"))
    joined = truth.join(counts, "qi", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("tp", F.coalesce("tp", F.lit(0)))
    return joined.withColumn("f05", f05(F.col("k"), F.col("n"), F.col("tp")))


def report(scored: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5 of a ``per_entity`` frame with its parts, overall or by columns."""
    single = F.col("k") == 0
    return scored.groupBy(*by).agg(
        F.avg("f05").alias("f05"),
        F.avg(F.when(single, F.col("f05"))).alias("f05_singletons"),
        F.avg(F.when(~single, F.col("f05"))).alias("f05_nonsingletons"),
        (F.sum("tp") / F.greatest(F.sum("n"), F.lit(1))).alias("micro_precision"),
        (F.sum("tp") / F.greatest(F.sum("k"), F.lit(1))).alias("micro_recall"),
        F.avg("n").alias("avg_pred"),
        F.avg(F.when(single, (F.col("n") > 0).cast("double"))).alias("singleton_false_merge"),
        F.count("*").alias("n_s1"),
    )


def blocking(scored: DataFrame, *by: str) -> DataFrame:
    """Recall, ceiling and sizes of candidates, of a ``per_entity`` frame."""
    pct = lambda q: F.percentile("n", F.lit(q))
    return scored.groupBy(*by).agg(
        (F.sum("tp") / F.greatest(F.sum("k"), F.lit(1))).alias("pair_recall"),
        F.avg(ceiling(F.col("k"), F.col("tp"))).alias("ceiling_f05"),
        F.avg("n").alias("cand_mean"),
        pct(0.5).alias("cand_p50"), pct(0.9).alias("cand_p90"), pct(0.99).alias("cand_p99"),
        F.max("n").alias("cand_max"),
        F.avg((F.col("n") == 0).cast("double")).alias("no_cand_rate"),
        F.avg(F.when(F.col("k") > 0, (F.col("tp") == F.col("k")).cast("double"))).alias("full_entity_recall"),
    )


def recall_at(ranked: DataFrame, total: DataFrame, ks: list[int], *by: str) -> DataFrame:
    """(k, by..., recall): share of true pairs ranked below each k. total: (by..., n) true pairs."""
    grid = F.array(*[F.lit(k) for k in ks])
    hits = ranked.filter("tp").withColumn("topk", F.explode(F.filter(grid, lambda k: F.col("rank") < k))).groupBy("topk", *by).agg(F.count("*").alias("hits"))
    points = total.withColumn("topk", F.explode(grid))
    return points.join(hits, ["topk", *by], "left").select("topk", *by, (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def auc(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Area under the curve from rank sums, ties at their middle rank.

    Rows are summed per distinct score first; ranks run over distinct scores only.
    """
    per = rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    per = cumulative(per, score, "n", *by)
    mid = F.col("before") + (F.col("n") + 1) / 2
    s = per.withColumn("mid", mid).groupBy(*by).agg(F.sum(F.col("mid") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    return s.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mean precision at each positive, equal scores together."""
    per = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    s = cumulative(cumulative(per, score, "pos", descending=True).withColumnRenamed("before", "b"), score, "n", descending=True)
    tp, all_ = F.col("b") + F.col("pos"), F.col("before") + F.col("n")
    return s.agg((F.sum(F.col("pos") * tp / all_) / F.sum("pos")).alias("average_precision"))


def log_loss(rows: DataFrame, score: str, label: str, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.col(score), F.lit(1 - eps)))
    return rows.agg((-F.avg(F.when(F.col(label), F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))

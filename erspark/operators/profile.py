"""Profiles of record tables and of their matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import exploded

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def text_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Sizes and shares of conditions of name and addr."""
    rate = lambda cond: F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))
    name, addr = F.col("name"), F.coalesce("addr", F.lit(""))
    n_addr = F.length(addr)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.length(name)).alias("name_len"), F.median(F.length(name)).alias("name_len_median"),
        F.avg(n_addr).alias("addr_len"), F.percentile(n_addr, F.lit(0.9)).alias("addr_len_p90"),
        rate(addr == "").alias("addr_empty"), rate(name.rlike(r"[^\x00-\x7F]")).alias("name_non_ascii"), rate(addr.rlike("[0-9]")).alias("addr_digit"),
        rate(addr.rlike(r"(^|[^0-9])[0-9]{5}([^0-9]|$)")).alias("zip5"), rate(addr.rlike(r"(^|[^0-9])[0-9]{6}([^0-9]|$)")).alias("pin6"),
        rate(addr.contains(",")).alias("addr_comma"),
    )


def quantiles(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """(by..., p10, p25, p50, p75, p90), interpolated."""
    got = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(q) for q in QUANTILES])).alias("q"))
    return got.select(*by, *[F.get("q", i).alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)])


def histogram(rows: DataFrame, value: Column, top: int, *by: str) -> DataFrame:
    """(by..., bin, n, share); the last bin holds all from ``top`` on."""
    n = rows.withColumn("bin", F.least(value, F.lit(top))).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))


def composition(pool: DataFrame) -> DataFrame:
    """(class, n, share) of entities by the sources of their matches."""
    has = lambda s: F.max((F.col("src") == s).cast("int")) == 1
    per = pool.filter("owner >= 0").groupBy("owner").agg(has("S2").alias("s2"), has("S3").alias("s3"))
    kind = F.when(F.col("s2") & F.col("s3"), "S2+S3").when(F.col("s2"), "S2 only").otherwise("S3 only")
    n = per.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with one column per value, 0 where none."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def coverage(pool: DataFrame, *by: str) -> DataFrame:
    """Share of pool rows with an owner."""
    return pool.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("owner") >= 0).cast("double")).alias("matched"))


def integrity(truth_pairs: DataFrame, entities: DataFrame, pool: DataFrame) -> DataFrame:
    """One row of counts: pairs, unknown entities and pool rows, rows of several owners, repeated pairs."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(truth_pairs, "n_pairs"),
        one(truth_pairs.join(entities, "qi", "left_anti"), "unknown_entities"),
        one(truth_pairs.join(pool, "pj", "left_anti"), "unknown_rows"),
        one(truth_pairs.groupBy("pj").agg(F.countDistinct("qi").alias("o")).filter("o > 1"), "several_owners"),
        one(truth_pairs.groupBy("qi", "pj").agg(F.count("*").alias("c")).filter("c > 1"), "repeated_pairs"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def top_tokens(rows: DataFrame, tokens: Column, n: int, *by: str) -> DataFrame:
    """(by..., t, c, rank): the n most frequent tokens, ties by token."""
    counted = exploded(rows, tokens, *by).groupBy(*by, "t").agg(F.count("*").alias("c"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("c").desc(), F.col("t"))
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def size_ratio(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, n_a, n_b, ratio)."""
    x, y = a.groupBy(by).agg(F.count("*").alias("n_a")), b.groupBy(by).agg(F.count("*").alias("n_b"))
    return x.join(y, by).withColumn("ratio", F.col("n_b") / F.col("n_a"))


def unseen(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    return test.select(column).distinct().subtract(train.select(column).distinct())


def headline(values: list[tuple[str, DataFrame]]) -> DataFrame:
    """(seq, metric, value) of one-row, one-column aggregates, in the given order."""
    out = None
    for i, (name, df) in enumerate(values):
        row = df.select(F.lit(i).alias("seq"), F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out

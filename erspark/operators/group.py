"""Features of a candidate among its entity's others and among claims on its pool row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _q():
    return Window.partitionBy("qi")


def _qo():
    return _q().orderBy(F.col("p").desc(), F.col("pj").asc())


def _p():
    return Window.partitionBy("pj")


def _po():
    return _p().orderBy(F.col("p").desc(), F.col("qi").asc())


def claims(scored: DataFrame) -> DataFrame:
    """Claims on the same pool row: number, rank of this one (from 1), best other p."""
    top = F.max("p").over(_p())
    second = F.nth_value("p", 2).over(_po().rowsBetween(*_ALL))
    return scored.select(
        "*", F.count("*").over(_p()).alias("s2_nclaim_pj"), F.row_number().over(_po()).alias("s2_rank_pj"),
        F.when(F.col("p") >= top, F.coalesce(second, F.lit(0.0))).otherwise(top).alias("s2_pmax_other_pj"),
    )


def ranks(scored: DataFrame) -> DataFrame:
    """Place and share of a candidate in its entity, and how many others are strong. Needs src."""
    hi = (F.col("p") > 0.5).cast("int")
    return scored.select(
        "*", (F.row_number().over(_qo()) - 1).alias("s2_rank_q"), F.max("p").over(_q()).alias("s2_pmax_q"),
        (F.col("p") / (F.max("p").over(_q()) + 1e-9)).alias("s2_prel"), F.sum("p").over(_q()).alias("s2_psum_q"),
        F.sum(hi).over(_q()).alias("s2_nhi_q"), F.sum(hi).over(Window.partitionBy("qi", "src")).alias("s2_nhi_same_src"),
    )


def sibling(scored: DataFrame) -> DataFrame:
    """Adds ref: the entity's best other candidate (the second for the first); -1 if alone."""
    first, second = F.first("pj").over(_qo().rowsBetween(*_ALL)), F.nth_value("pj", 2).over(_qo().rowsBetween(*_ALL))
    return scored.withColumn("ref", F.when(F.row_number().over(_qo()) == 1, F.coalesce(second, F.lit(-1))).otherwise(first).cast("bigint"))


def sibling_text(with_ref: DataFrame, records: DataFrame) -> DataFrame:
    """Similarity of a candidate's texts and numbers to its sibling's; null where undefined."""
    r = records.select("pj", F.struct("ntri", "atri", "empty_addr", "nums").alias("x"))
    d = with_ref.join(r, "pj").join(r.select(F.col("pj").alias("ref"), F.col("x").alias("y")), "ref", "left")
    x, y = F.col("x"), F.col("y")
    address = y.isNotNull() & ~x["empty_addr"] & ~y["empty_addr"]
    nums = (F.size(x["nums"]) > 0) & (F.size(y["nums"]) > 0)
    return d.select(
        *with_ref.columns, F.when(y.isNotNull(), sets.jaccard(x["ntri"], y["ntri"], None)).alias("s2_sib_name_j"),
        F.when(address, sets.jaccard(x["atri"], y["atri"], None)).alias("s2_sib_addr_j"),
        F.when(y.isNotNull() & nums, F.arrays_overlap(x["nums"], y["nums"]).cast("int").cast("double")).alias("s2_sib_num"),
    )


def siblings(scored: DataFrame, *columns: str) -> DataFrame:
    """All ordered pairs of different candidates of an entity: own columns and o_* of the other."""
    mine = scored.select("qi", "pj", *columns)
    other = scored.select(F.col("qi").alias("o_qi"), F.col("pj").alias("o_pj"), *[F.col(c).alias(f"o_{c}") for c in columns])
    return mine.join(other, (F.col("qi") == F.col("o_qi")) & (F.col("pj") != F.col("o_pj"))).drop("o_qi")


def vector_cluster(scored: DataFrame, vectors: DataFrame) -> DataFrame:
    """Closeness of a candidate's vector to those of its entity's other candidates.

    scored: qi, pj, p, src. vectors: pj, e.
    """
    d = siblings(scored.join(vectors.select("pj", "e"), "pj"), "p", "src", "e").withColumn("c", sets.dot(F.col("e"), F.col("o_e")))
    hi = F.col("o_p") > 0.5
    agg = d.groupBy("qi", "pj").agg(
        F.when(F.sum("o_p") > 0, F.sum(F.col("o_p") * F.col("c")) / F.sum("o_p")).alias("x_emb_wmean"),
        F.max(F.when(hi, F.col("c"))).alias("x_emb_max_hi"),
        F.sum((hi & (F.col("c") > 0.9)).cast("int")).alias("x_emb_n_close_hi"),
        F.max(F.when(hi & (F.col("o_src") != F.col("src")), F.col("c"))).alias("x_emb_max_hi_other"),
    )
    ref = sibling(scored.select("qi", "pj", "p")).select("qi", "pj", "ref")
    top = d.join(ref, ["qi", "pj"]).filter(F.col("o_pj") == F.col("ref")).select("qi", "pj", F.col("c").alias("x_emb_sib_top"))
    base = scored.select("qi", "pj").join(agg, ["qi", "pj"], "left").join(top, ["qi", "pj"], "left")
    return base.withColumn("x_emb_n_close_hi", F.coalesce("x_emb_n_close_hi", F.lit(0)))


def core_siblings(scored: DataFrame, cores: DataFrame) -> DataFrame:
    """Number of strong other candidates with the same core name. cores: pj, core."""
    d = siblings(scored.join(cores, "pj"), "p", "core")
    n = d.groupBy("qi", "pj").agg(F.sum(((F.col("o_p") > 0.5) & (F.col("core") == F.col("o_core"))).cast("int")).alias("x_sib_core_hi"))
    return scored.select("qi", "pj").join(n, ["qi", "pj"], "left").withColumn("x_sib_core_hi", F.coalesce("x_sib_core_hi", F.lit(0)))


def relative_to_best(df: DataFrame, *columns: str) -> DataFrame:
    """rel_c = c minus the entity's largest c."""
    return df.withColumns({f"rel_{c}": F.col(c) - F.max(c).over(_q()) for c in columns})


def entity_rollup(scored: DataFrame, top: tuple[str, ...] = ("p", "cos")) -> DataFrame:
    """One row per entity: the profile of its scores and values of its best candidate."""
    best = F.max_by(F.struct(*top), F.struct(F.col("p"), -F.col("pj")))
    second = F.get(F.reverse(F.array_sort(F.collect_list("p"))), F.lit(1))  # an entity has a few candidates
    return scored.groupBy("qi").agg(
        F.max("p").alias("e_pmax"), F.sum("p").alias("e_psum"), F.count("*").alias("e_ncand"),
        F.sum((F.col("p") > 0.5).cast("int")).alias("e_nhi"), F.sum((F.col("p") > 0.2).cast("int")).alias("e_nmid"),
        second.alias("e_p2nd"), F.max("cos").alias("e_cosmax"), best.alias("b"),
    ).select("qi", "e_pmax", "e_psum", "e_ncand", "e_nhi", "e_nmid", "e_p2nd", "e_cosmax", *[F.col(f"b.{c}").alias(f"e_top_{c}") for c in top])


def top_gap(ranked: DataFrame, key: str = "qi", score: str = "cos") -> DataFrame:
    """Best score and its lead on the second, of rows with a 0-based rank."""
    g = ranked.groupBy(key).agg(F.max(F.when(F.col("rank") == 0, F.col(score))).alias("top1"), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top2"))
    return g.select(key, "top1", (F.col("top1") - F.col("top2")).alias("gap"))


def stage_two(scored: DataFrame) -> DataFrame:
    """The frame of group features: pool-row windows first, then entity windows."""
    return sibling(ranks(claims(scored)))

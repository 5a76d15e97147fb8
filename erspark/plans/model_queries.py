"""Queries that train models; of them feature_auc alone has SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, group, metrics, models
from ..sources import tables, toy
from .er_queries import ER, r6
from .registry import query
from .resolver import Resolver

COLUMNS = ["s2_rank_q", "s2_prel", "s2_psum_q", "s2_nhi_q", "s2_nclaim_pj", "s2_pmax_other_pj"]
GROUPS = {"rank": ["s2_rank_q", "s2_prel"], "mass": ["s2_psum_q", "s2_nhi_q"], "claims": ["s2_nclaim_pj", "s2_pmax_other_pj"]}


def labelled(v):
    d = group.ranks(group.claims(v.er_claims)).join(v.er_s1.select("qi", "fold", "country"), "qi")
    return d.withColumn("label", F.col("tp").cast("int"))


@query()
def gbt_scores(v):
    d = labelled(v)
    return models.fit(d.filter("fold < 3"), COLUMNS, rounds=10).score(d.filter("fold >= 3"), "score").select("qi", "pj", r6("score").alias("score"))


@query()
def oof_stack(v):
    return models.out_of_fold(labelled(v), COLUMNS, out="score", rounds=5).select("qi", "pj", "fold", r6("score").alias("score"))


@query()
def isotonic(v):
    return models.isotonic_out_of_fold(labelled(v)).select("qi", "pj", r6("p_cal").alias("p_cal"))


@query()
def transfer(v):
    d = labelled(v).withColumn("country", F.when(F.col("country") % 2 == 0, "even").otherwise("odd"))
    out = models.transfer(d.drop("p"), COLUMNS, "even", "odd", rounds=10)
    return metrics.auc(out, "p", "label").select(r6("auc").alias("auc"))


@query()
def feature_ladder(v):
    return models.ladder(labelled(v).drop("p"), GROUPS, rounds=5).withColumn("auc", r6("auc"))


@query()
def leave_one_out(v):
    return models.leave_one_out(labelled(v).drop("p"), GROUPS, rounds=5).withColumn("auc", r6("auc"))


@query()
def feature_importance(v):
    got = models.fit(labelled(v), COLUMNS, rounds=10).importance()
    return v._spark.createDataFrame([(n, float(x)) for n, x in got], "feature string, importance double").withColumn("importance", r6("importance"))


FEATURES = (
    "f AS (SELECT tp, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) - 1 AS s2_rank_q, round(p / (max(p) OVER (PARTITION BY qi) + 1e-9), 9) AS s2_prel, round(sum(p) OVER (PARTITION BY qi), 9) AS s2_psum_q, "
    "sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY qi) AS s2_nhi_q, count(*) OVER (PARTITION BY pj) AS s2_nclaim_pj, CASE WHEN p >= max(p) OVER (PARTITION BY pj) THEN coalesce(nth_value(p, 2) OVER (PARTITION BY pj ORDER BY p DESC, qi ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) ELSE max(p) OVER (PARTITION BY pj) END AS s2_pmax_other_pj FROM er_claims), "
    "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, tp, CAST(coalesce({c}, (SELECT median({c}) FROM f), 0) AS DOUBLE) AS x FROM f" for c in COLUMNS) + "), "
    "mids AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS mid FROM long), "
    "areas AS (SELECT feature, (sum(CASE WHEN tp THEN mid ELSE 0 END) - sum(CAST(tp AS BIGINT)) * (sum(CAST(tp AS BIGINT)) + 1) / 2.0) / (sum(CAST(tp AS BIGINT)) * sum(CAST(NOT tp AS BIGINT))) AS a FROM mids GROUP BY feature)"
)


@query("SELECT feature, round(greatest(a, 1 - a), 6) AS auc FROM areas", ER, FEATURES)
def feature_auc(v):
    """Sums are rounded, so that equal ones tie whatever the order of adding."""
    d = labelled(v).withColumns({c: F.round(c, 9) for c in ("s2_prel", "s2_psum_q")})
    return models.feature_auc(d, COLUMNS).withColumn("auc", r6("auc"))


@query()
def entity_model(v):
    """Has-a-match scores of entities from their candidates' profile, then the gated rule."""
    e = group.entity_rollup(v.er_scored.withColumn("cos", F.col("p"))).join(v.er_truth, "qi").withColumn("label", (F.col("k") > 0).cast("int"))
    columns = ["e_pmax", "e_psum", "e_ncand", "e_nhi", "e_nmid", "e_p2nd"]
    scored = models.out_of_fold(e, columns, out="e", rounds=5).select("qi", "e")
    kept = decide.apply(v.er_claims, "gated", (0.3, 0.4, 0.7), scored).join(v.er_claims.select("qi", "pj", "tp"), ["qi", "pj"])
    return metrics.report(metrics.per_entity(kept, v.er_truth)).select(r6("f05").alias("f05"), "n_s1")


@query()
def rescore_old_model(v):
    """A model of the first folds at its old threshold, and at the best one, on the last folds."""
    d = labelled(v)
    old = models.fit(d.filter("fold < 2"), COLUMNS, rounds=5).score(d.filter("fold >= 2").drop("p")).select("qi", "pj", "p", "tp", "fold")
    out, truth = None, v.er_truth.filter("fold >= 3")
    best = decide.best(decide.grid_scores(old.filter("fold = 2").drop("fold"), v.er_truth.filter("fold = 2"), "threshold")).first()["x0"]
    for name, t in (("old", 0.7), ("tuned", best)):
        kept = decide.threshold(decide.one_to_one(old), t).filter("fold >= 3")
        row = metrics.report(metrics.per_entity(kept, truth)).select(F.lit(name).alias("threshold"), r6("f05").alias("f05"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def resolver_end_to_end(v):
    """Generated records through the whole resolver: submission rows of a second, unseen set."""
    spark = v._spark
    n = 80

    def split(seed):
        t = toy.tables(spark, n, seed)
        s1, pool = tables.build_split(t["source1"], t["source2"], t["source3"], t["truth"])
        q = s1.withColumn("qi", F.substring_index("entity_id", "-", -1).cast("long"))
        p = pool.withColumn("pj", F.pmod(F.xxhash64("entity_id"), F.lit(2**40)))
        p = p.withColumn("owner", F.when(F.col("owner") == "", F.lit(-1)).otherwise(F.substring_index("owner", "-", -1).cast("long")))
        return q, p

    q, p = split(1)
    model = Resolver(rounds=2, folder=tables.scratch(spark)).fit(q, p)
    model.folder = tables.scratch(spark)
    matches, _ = model.transform(*split(2))
    return matches

"""Queries over scored pairs: samples, joins, group features, rules, metrics, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, diagnostics, group, metrics, profile, sampling
from ..sources import tables
from .registry import query
from .views import Views

ER = "er_s1 er_pool er_truth er_scored er_claims"
PRIO = "CAST((qi * 7919 + 104729) % 10007 AS DOUBLE) / 10007"
#: One-to-one claims with ranks, running sums and the log of no match.
ONE = "one AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY pj ORDER BY p DESC, qi) AS n FROM er_claims) WHERE n = 1)"
PREP = ONE + (
    ", prep AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) - 1 AS r, max(p) OVER (PARTITION BY qi) AS mx, "
    "sum(p) OVER (PARTITION BY qi ORDER BY p DESC, pj ROWS UNBOUNDED PRECEDING) AS s, sum(p) OVER (PARTITION BY qi) AS t, "
    "sum(ln(1 - greatest(0, least(p, 1 - 1e-6)))) OVER (PARTITION BY qi) AS l FROM one)"
)
F05 = "CASE WHEN k = 0 AND n = 0 THEN 1.0 WHEN k = 0 OR n = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * k + n) END"
CEILING = "CASE WHEN k = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * k + tp) END"
HIGH = "kept AS (SELECT * FROM one WHERE p >= 0.7)"


def per(source: str, name: str = "per") -> str:
    return f"{name} AS (SELECT *, {F05} AS f05 FROM (SELECT t.qi, t.country, t.fold, t.k, coalesce(c.n, 0) AS n, coalesce(c.tp, 0) AS tp FROM er_truth t LEFT JOIN (SELECT qi, count(*) AS n, sum(CAST(tp AS BIGINT)) AS tp FROM {source} GROUP BY qi) c USING (qi)))"


def truth_pairs(v: Views):
    return v.er_pool.filter("owner >= 0").select(F.col("owner").alias("qi"), "pj")


def kept07(v: Views):
    return decide.threshold(decide.one_to_one(v.er_claims), 0.7)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Sources and samples


@query("SELECT src, count(*) AS n, count(*) FILTER (owner >= 0) AS owned FROM er_pool GROUP BY src", "er_pool")
def load_union_src(v):
    two, three = v.er_pool.filter("src = 'S2'"), v.er_pool.filter("src = 'S3'")
    return two.unionByName(three).groupBy("src").agg(F.count("*").alias("n"), F.sum((F.col("owner") >= 0).cast("int")).alias("owned"))


@query("SELECT qi, count(*) AS k, sum(pj) AS ids FROM (SELECT owner AS qi, pj FROM er_pool WHERE owner >= 0) GROUP BY qi", "er_pool")
def truth_explode_attach(v):
    lists = truth_pairs(v).groupBy("qi").agg(F.array_join(F.collect_list(F.col("pj").cast("string")), ",").alias("matched_entity_ids"))
    pairs = tables.explode_truth(lists.withColumnRenamed("qi", "source1_entity_id"))
    return pairs.groupBy(F.col("s1").cast("long").alias("qi")).agg(F.count("*").alias("k"), F.sum(F.col("id").cast("long")).alias("ids"))


LISTS = "SELECT s.qi, coalesce(string_agg(CAST(k.pj AS VARCHAR), ',' ORDER BY k.p DESC, k.pj), '') AS list FROM er_s1 s LEFT JOIN kept k ON k.qi = s.qi GROUP BY s.qi"


@query(LISTS, ER, f"{ONE}, {HIGH}")
def match_list_sink(v):
    return tables.with_lists(v.er_s1, kept07(v), "qi", "pj", "p", "list")


@query("SELECT qi, CAST(pj AS VARCHAR) AS item FROM kept", ER, f"{ONE}, {HIGH}")
def match_list_read(v):
    return tables.read_lists(tables.with_lists(v.er_s1, kept07(v), "qi", "pj", "p", "list"), "qi", "list")


@query("SELECT exp, variant, event_id, value FROM (SELECT event_type AS exp, user_id % 10 AS variant, event_id, value, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(v):
    rows = v.events.select(F.col("event_type").alias("exp"), (F.col("user_id") % 10).alias("variant"), "event_id", "value")
    return tables.latest(rows, ["exp", "variant"], "event_id")


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS \"unknown\", CAST(0 AS BIGINT) AS claimed_twice, (SELECT count(*) FROM kept WHERE p < 0.75) AS outside", ER, f"{ONE}, {HIGH}")
def submission_check(v):
    matches = tables.with_lists(v.er_s1, kept07(v), "qi", "pj", "p", "list")
    cands = tables.with_lists(v.er_s1, v.er_scored.filter("p >= 0.75"), "qi", "pj", "p", "list")
    return tables.check_submission(v.er_s1.select("qi"), v.er_pool, matches, cands)


@query(f"SELECT qi, country, round({PRIO}, 6) AS prio FROM er_s1 WHERE {PRIO} >= 0.15 AND {PRIO} < 0.30", "er_s1")
def slice_filter(v):
    rows = v.er_s1.withColumn("prio", sampling.portable_priority(F.col("qi")))
    return sampling.between(rows, 0.15, 0.30).select("qi", "country", r6("prio").alias("prio"))


@query(f"SELECT qi, country FROM er_s1 ORDER BY {PRIO}, qi LIMIT 50", "er_s1")
def hash_sample_n(v):
    return sampling.sample(v.er_s1, 50, sampling.portable_priority(F.col("qi")), "qi").select("qi", "country")


@query(f"SELECT * FROM (SELECT qi, name FROM er_s1 WHERE name LIKE '%1%' ORDER BY {PRIO}, qi LIMIT 40) UNION ALL SELECT * FROM (SELECT qi, name FROM er_s1 WHERE NOT name LIKE '%1%' ORDER BY {PRIO}, qi LIMIT 10)", "er_s1")
def stratified_sample(v):
    return sampling.stratified(v.er_s1, 50, F.col("name").contains("1"), sampling.portable_priority(F.col("qi")), 0.8, "qi").select("qi", "name")


@query(
    f"SELECT f, (SELECT count(*) FROM s1p WHERE prio < f) AS n_s1, (SELECT count(*) FROM er_pool p JOIN s1p s ON s.qi = p.owner WHERE s.prio < f) + (SELECT count(*) FROM er_pool WHERE owner < 0 AND CAST((pj * 7919 + 104729) % 10007 AS DOUBLE) / 10007 < f) AS n_pool FROM (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.25), (0.5)) AS t(f)",
    "er_s1 er_pool",
    f"s1p AS (SELECT qi, {PRIO} AS prio FROM er_s1)",
)
def nested_universe_sizes(v):
    s1 = v.er_s1.withColumn("prio", sampling.portable_priority(F.col("qi")))
    out = None
    for f in (0.05, 0.1, 0.25, 0.5):
        a, b = sampling.universe(s1, v.er_pool, 0.0, f)
        row = a.agg(F.count("*").alias("n_s1")).join(F.broadcast(b.agg(F.count("*").alias("n_pool")))).select(F.lit(f).alias("f"), "n_s1", "n_pool")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT qi, pj, p FROM (SELECT qi, pj, p, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) AS n FROM er_claims WHERE NOT tp) WHERE n = 1", ER)
def hard_negative(v):
    ranked = group.ranks(v.er_claims).withColumn("rank", F.col("s2_rank_q"))
    return sampling.hard_negatives(ranked).select("qi", "pj", "p")


@query("SELECT t.qi, t.pj AS pos, n.pj AS neg FROM (SELECT owner AS qi, pj FROM er_pool WHERE owner >= 0) t JOIN (SELECT qi, pj FROM (SELECT qi, pj, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) AS n FROM er_claims WHERE NOT tp) WHERE n = 1) n USING (qi)", ER)
def triplet_mining(v):
    negatives = sampling.hard_negatives(group.ranks(v.er_claims).withColumn("rank", F.col("s2_rank_q")))
    return sampling.triplets(truth_pairs(v), negatives)


@query()
def random_negatives(v):
    pool = v.er_pool.join(v.er_s1.select(F.col("qi").alias("seed"), "country"), "seed")
    return sampling.random_negatives(truth_pairs(v), v.er_s1, pool.select("pj", "country"))


@query("SELECT count(*) AS n_all, count(DISTINCT (qi, pj)) AS n_distinct FROM (SELECT qi, pj FROM er_scored UNION ALL SELECT qi, pj FROM er_scored WHERE p > 0.5)", "er_scored")
def pair_dedupe(v):
    twice = v.er_scored.select("qi", "pj").unionByName(v.er_scored.filter("p > 0.5").select("qi", "pj"))
    return twice.agg(F.count("*").alias("n_all")).join(F.broadcast(sampling.dedupe(twice).agg(F.count("*").alias("n_distinct"))))


@query("SELECT round(CAST(count(*) - count(DISTINCT text) AS DOUBLE) / count(*), 6) AS text_rate, round(CAST(count(*) - count(DISTINCT (lang, source)) AS DOUBLE) / count(*), 6) AS pair_rate FROM documents")
def dup_rates(v):
    return v.documents.agg(F.round(sampling.duplicate_rate(v.documents, "text"), 6).alias("text_rate"), F.round(sampling.duplicate_rate(v.documents, "lang", "source"), 6).alias("pair_rate"))


# Joins and set operations


@query("SELECT p.pj, p.src, p.owner, coalesce(s.country, -1) AS country FROM er_pool p LEFT JOIN er_s1 s ON s.qi = p.owner", "er_pool er_s1")
def owner_left_join(v):
    joined = v.er_pool.join(v.er_s1.select(F.col("qi").alias("owner"), "country"), "owner", "left")
    return joined.select("pj", "src", "owner", F.coalesce("country", F.lit(-1)).alias("country"))


@query("SELECT pj, owner AS own FROM er_pool", "er_pool")
def owner_index(v):
    pairs = truth_pairs(v).select("pj", F.col("qi").alias("o"))
    return v.er_pool.select("pj").join(pairs, "pj", "left").select("pj", F.coalesce("o", F.lit(-1)).alias("own"))


@query("SELECT qi, pj, CAST(tp AS INTEGER) AS label FROM er_claims", ER)
def pair_label(v):
    return metrics.with_tp(v.er_scored.select("qi", "pj"), v.er_pool).select("qi", "pj", F.col("tp").cast("int").alias("label"))


@query("SELECT s.qi, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM er_s1 s LEFT JOIN (SELECT seed, count(*) AS n FROM er_pool GROUP BY seed) c ON c.seed = s.qi", "er_s1 er_pool")
def key_lookup_default(v):
    n = v.er_pool.groupBy("seed").agg(F.count("*").alias("n"))
    return v.er_s1.join(n, F.col("qi") == F.col("seed"), "left").select("qi", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT a.qi, a.pj, b.pj AS o_pj, b.p AS o_p FROM er_scored a JOIN er_scored b ON a.qi = b.qi AND a.pj <> b.pj", "er_scored")
def sibling_self_join(v):
    return group.siblings(v.er_scored, "p").select("qi", "pj", "o_pj", "o_p")


@query("SELECT p.owner AS qi, p.pj FROM er_pool p WHERE p.owner >= 0 AND NOT EXISTS (SELECT 1 FROM er_scored s WHERE s.qi = p.owner AND s.pj = p.pj)", "er_pool er_scored")
def missed_pairs_anti(v):
    return truth_pairs(v).join(v.er_scored, ["qi", "pj"], "left_anti")


@query("SELECT p.owner AS qi, p.pj FROM er_pool p WHERE p.owner >= 0 AND EXISTS (SELECT 1 FROM er_scored s WHERE s.qi = p.owner AND s.pj = p.pj)", "er_pool er_scored")
def found_semi(v):
    return truth_pairs(v).join(v.er_scored, ["qi", "pj"], "left_semi")


@query("SELECT DISTINCT qi, pj FROM (SELECT qi, pj FROM er_scored WHERE p >= 0.6 UNION ALL SELECT owner, pj FROM er_pool WHERE owner >= 0)", "er_scored er_pool")
def cand_union_distinct(v):
    return sampling.dedupe(v.er_scored.filter("p >= 0.6").select("qi", "pj").unionByName(truth_pairs(v)))


@query(
    "SELECT s.country, round(1000.0 * coalesce(a.n, 0) / s.n, 6) AS added, round(1000.0 * coalesce(r.n, 0) / s.n, 6) AS removed FROM (SELECT country, count(*) AS n FROM er_s1 GROUP BY country) s "
    "LEFT JOIN (SELECT country, count(*) AS n FROM (SELECT qi, pj FROM new EXCEPT SELECT qi, pj FROM old) JOIN er_s1 USING (qi) GROUP BY country) a USING (country) LEFT JOIN (SELECT country, count(*) AS n FROM (SELECT qi, pj FROM old EXCEPT SELECT qi, pj FROM new) JOIN er_s1 USING (qi) GROUP BY country) r USING (country)",
    ER,
    f"{PREP}, old AS (SELECT * FROM one WHERE p >= 0.7), new AS (SELECT * FROM prep WHERE (r = 0 AND p >= 0.4) OR (r > 0 AND p >= 0.8))",
)
def run_diff_by_country(v):
    new = decide.top1_plus(decide.prepared(v.er_claims), 0.4, 0.8)
    out = diagnostics.changes_by_country(kept07(v), new, v.er_s1)
    return out.select("country", r6("added").alias("added"), r6("removed").alias("removed"))


@query("SELECT qi, pj FROM er_scored WHERE p >= 0.5 INTERSECT SELECT owner, pj FROM er_pool WHERE owner >= 0", "er_scored er_pool")
def search_intersect(v):
    return v.er_scored.filter("p >= 0.5").select("qi", "pj").intersect(truth_pairs(v))


# Aggregates


@query("SELECT least(k, 5) AS bin, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM er_truth), 6) AS share FROM er_truth GROUP BY least(k, 5)", "er_truth")
def match_histogram(v):
    return profile.histogram(v.er_truth, F.col("k"), 5).withColumn("share", r6("share"))


@query(
    "SELECT class, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM (SELECT owner, CASE WHEN count(DISTINCT src) = 2 THEN 'S2+S3' WHEN min(src) = 'S2' THEN 'S2 only' ELSE 'S3 only' END AS class FROM er_pool WHERE owner >= 0 GROUP BY owner) GROUP BY class",
    "er_pool",
)
def composition_classes(v):
    return profile.composition(v.er_pool).withColumn("share", r6("share"))


@query("SELECT o_orderpriority AS prio, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def country_crosstab(v):
    return profile.crosstab(v.orders.select(F.col("o_orderpriority").alias("prio"), "o_orderstatus"), "prio", "o_orderstatus", ["F", "O", "P"])


@query("SELECT src, count(*) AS n, round(avg(CASE WHEN owner >= 0 THEN 1.0 ELSE 0.0 END), 6) AS matched FROM er_pool GROUP BY src", "er_pool")
def coverage_by_source(v):
    return profile.coverage(v.er_pool, "src").withColumn("matched", r6("matched"))


@query("SELECT (SELECT count(*) FROM er_scored) AS n_pairs, CAST(0 AS BIGINT) AS unknown_entities, CAST(0 AS BIGINT) AS unknown_rows, (SELECT count(*) FROM (SELECT pj FROM er_scored GROUP BY pj HAVING count(DISTINCT qi) > 1)) AS several_owners, CAST(0 AS BIGINT) AS repeated_pairs", "er_scored")
def integrity_counts(v):
    return profile.integrity(v.er_scored.select("qi", "pj"), v.er_s1.select("qi"), v.er_pool.select("pj"))


@query("SELECT l_returnflag AS g, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def quantile_vector(v):
    q = profile.quantiles(v.lineitem, F.col("l_extendedprice"), "l_returnflag")
    return q.select(F.col("l_returnflag").alias("g"), *[F.round(c, 4).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")])


AUC = "SELECT {by} round((sum(CASE WHEN tp THEN mid ELSE 0 END) - sum(CAST(tp AS BIGINT)) * (sum(CAST(tp AS BIGINT)) + 1) / 2.0) / (sum(CAST(tp AS BIGINT)) * sum(CAST(NOT tp AS BIGINT))), 6) AS auc FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({part2} p) - 1) / 2.0 AS mid FROM er_claims) {group}"


@query(AUC.format(by="src,", part="PARTITION BY src", part2="PARTITION BY src,", group="GROUP BY src"), ER)
def auc_rank_sum(v):
    return metrics.auc(v.er_claims, "p", "tp", "src").withColumn("auc", r6("auc"))


@query(
    "SELECT round(sum(CAST(tp AS BIGINT) * hits / alln) / sum(CAST(tp AS BIGINT)), 6) AS average_precision, round(-avg(CASE WHEN tp THEN ln(greatest(1e-15, least(p, 1 - 1e-15))) ELSE ln(1 - greatest(1e-15, least(p, 1 - 1e-15))) END), 6) AS log_loss FROM (SELECT *, CAST(sum(CAST(tp AS BIGINT)) OVER w AS DOUBLE) AS hits, count(*) OVER w AS alln FROM er_claims WINDOW w AS (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))",
    ER,
)
def average_precision_log_loss(v):
    a = metrics.average_precision(v.er_claims, "p", "tp").select(r6("average_precision").alias("average_precision"))
    return a.join(F.broadcast(metrics.log_loss(v.er_claims, "p", "tp").select(r6("log_loss").alias("log_loss"))))


@query("SELECT round(regr_slope(n, x), 6) AS slope, round(regr_intercept(n, x), 6) AS intercept FROM (SELECT log10(CAST(n_pool AS DOUBLE)) AS x, CAST(n AS DOUBLE) AS n FROM (SELECT country + 1 AS n_pool, count(*) AS n FROM er_s1 GROUP BY country))", "er_s1")
def scaling_regression(v):
    pts = v.er_s1.groupBy("country").agg(F.count("*").cast("double").alias("n")).withColumn("n_pool", F.col("country") + 1)
    return diagnostics.scaling_fit(pts, "n_pool", "n").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("SELECT c.c_nationkey AS country, count(DISTINCT c_mktsegment) AS segs, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 4) AS mean_pos FROM customer c GROUP BY c.c_nationkey")
def conditional_group_means(v):
    return v.customer.groupBy(F.col("c_nationkey").alias("country")).agg(F.countDistinct("c_mktsegment").alias("segs"), F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 4).alias("mean_pos"))


@query("SELECT a.src, a.n AS n_a, b.n AS n_b, round(CAST(b.n AS DOUBLE) / a.n, 6) AS ratio FROM (SELECT src, count(*) AS n FROM er_pool WHERE pj % 5 < 3 GROUP BY src) a JOIN (SELECT src, count(*) AS n FROM er_pool WHERE pj % 5 >= 3 GROUP BY src) b USING (src)", "er_pool")
def split_size_ratio(v):
    return profile.size_ratio(v.er_pool.filter("pj % 5 < 3"), v.er_pool.filter("pj % 5 >= 3"), "src").withColumn("ratio", r6("ratio"))


@query("SELECT DISTINCT country FROM er_s1 WHERE qi % 7 = 0 EXCEPT SELECT country FROM er_s1 WHERE qi % 7 <> 0 AND country % 2 = 0", "er_s1")
def unseen_countries(v):
    return profile.unseen(v.er_s1.filter("qi % 7 <> 0 and country % 2 = 0"), v.er_s1.filter("qi % 7 = 0"), "country")


@query("SELECT 0 AS seq, 'n_s1' AS metric, CAST(count(*) AS DOUBLE) AS value FROM er_s1 UNION ALL SELECT 1, 'n_pool', count(*) FROM er_pool UNION ALL SELECT 2, 'singleton_rate', round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END), 6) FROM er_truth", ER)
def headline_metrics(v):
    return profile.headline([("n_s1", v.er_s1.agg(F.count("*"))), ("n_pool", v.er_pool.agg(F.count("*"))), ("singleton_rate", v.er_truth.agg(F.round(F.avg((F.col("k") == 0).cast("double")), 6)))])


@query(
    "SELECT count(*) AS n_s1, (SELECT count(*) FROM er_pool) AS n_pool, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END), 6) AS singleton_rate, (SELECT round(avg(CASE WHEN owner < 0 THEN 1.0 ELSE 0.0 END), 6) FROM er_pool) AS distractor_rate, round(CAST((SELECT count(*) FROM er_pool) AS DOUBLE) / count(*), 6) AS pool_per_s1 FROM er_truth",
    ER,
)
def universe_summary(v):
    s = v.er_truth.agg(F.count("*").alias("n_s1"), F.round(F.avg((F.col("k") == 0).cast("double")), 6).alias("singleton_rate"))
    p = v.er_pool.agg(F.count("*").alias("n_pool"), F.round(F.avg((F.col("owner") < 0).cast("double")), 6).alias("distractor_rate"))
    return s.join(F.broadcast(p)).withColumn("pool_per_s1", F.round(F.col("n_pool") / F.col("n_s1"), 6))


@query(
    "SELECT country, kind, qi FROM (SELECT country, kind, qi, row_number() OVER (PARTITION BY country, kind ORDER BY (qi * 7919 + 104729) % 10007, qi) AS r FROM (SELECT qi, country, CASE WHEN k = 0 THEN 'singleton' WHEN k >= 3 THEN 'large' ELSE 'small' END AS kind FROM er_truth)) WHERE r <= CASE kind WHEN 'singleton' THEN 4 WHEN 'large' THEN 2 ELSE 3 END",
    ER,
)
def sample_groups(v):
    from pyspark.sql import Window

    kinds = v.er_truth.withColumn("kind", F.when(F.col("k") == 0, "singleton").when(F.col("k") >= 3, "large").otherwise("small"))
    order = Window.partitionBy("country", "kind").orderBy(sampling.portable_priority(F.col("qi")), "qi")
    limit = F.when(F.col("kind") == "singleton", 4).when(F.col("kind") == "large", 2).otherwise(3)
    return kinds.withColumn("r", F.row_number().over(order)).filter("r <= 4").filter(F.col("r") <= limit).select("country", "kind", "qi")


# Group features


@query(
    "SELECT qi, pj, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) - 1 AS s2_rank_q, round(max(p) OVER (PARTITION BY qi), 6) AS s2_pmax_q, round(p / (max(p) OVER (PARTITION BY qi) + 1e-9), 6) AS s2_prel, round(sum(p) OVER (PARTITION BY qi), 6) AS s2_psum_q, CAST(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY qi) AS BIGINT) AS s2_nhi_q FROM er_claims",
    ER,
)
def rank_share_q(v):
    d = group.ranks(v.er_claims)
    return d.select("qi", "pj", "s2_rank_q", r6("s2_pmax_q").alias("s2_pmax_q"), r6("s2_prel").alias("s2_prel"), r6("s2_psum_q").alias("s2_psum_q"), "s2_nhi_q")


@query("SELECT qi, pj, CAST(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY qi, src) AS BIGINT) AS s2_nhi_same_src FROM er_claims", ER)
def nhi_same_src(v):
    return group.ranks(v.er_claims).select("qi", "pj", "s2_nhi_same_src")


@query("SELECT qi, pj, count(*) OVER (PARTITION BY pj) AS s2_nclaim_pj, row_number() OVER (PARTITION BY pj ORDER BY p DESC, qi) AS s2_rank_pj FROM er_scored", "er_scored")
def claims_pj(v):
    return group.claims(v.er_scored).select("qi", "pj", "s2_nclaim_pj", "s2_rank_pj")


@query("SELECT qi, pj, CASE WHEN p >= mx THEN coalesce(p2, 0.0) ELSE mx END AS s2_pmax_other_pj FROM (SELECT *, max(p) OVER (PARTITION BY pj) AS mx, nth_value(p, 2) OVER (PARTITION BY pj ORDER BY p DESC, qi ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p2 FROM er_scored)", "er_scored")
def pmax_other_pj(v):
    return group.claims(v.er_scored).select("qi", "pj", "s2_pmax_other_pj")


@query("SELECT qi, pj, CASE WHEN r = 1 THEN coalesce(sec, -1) ELSE fst END AS ref FROM (SELECT qi, pj, row_number() OVER w AS r, first_value(pj) OVER w AS fst, nth_value(pj, 2) OVER (PARTITION BY qi ORDER BY p DESC, pj ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sec FROM er_scored WINDOW w AS (PARTITION BY qi ORDER BY p DESC, pj))", "er_scored")
def sibling_ref(v):
    return group.sibling(v.er_scored).select("qi", "pj", "ref")


@query("SELECT qi, pj, round(p - max(p) OVER (PARTITION BY qi), 6) AS rel_p FROM er_scored", "er_scored")
def rel_to_best(v):
    return group.relative_to_best(v.er_scored, "p").select("qi", "pj", r6("rel_p").alias("rel_p"))


@query("SELECT qi, pj, CAST(r AS INTEGER) AS r, round(mx, 6) AS mx, round(s, 6) AS s, round(t, 6) AS t, round(l, 6) AS l FROM prep", ER, PREP)
def cum_expected(v):
    d = decide.prepared(v.er_claims)
    return d.select("qi", "pj", "r", *[r6(c).alias(c) for c in ("mx", "s", "t", "l")])


@query("SELECT qi, top1, round(top1 - top2, 6) AS gap FROM (SELECT qi, max(CASE WHEN r = 1 THEN p END) AS top1, max(CASE WHEN r = 2 THEN p END) AS top2 FROM (SELECT qi, p, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) AS r FROM er_scored) GROUP BY qi)", "er_scored")
def top_gap(v):
    ranked = group.ranks(v.er_claims).withColumn("rank", F.col("s2_rank_q"))
    return group.top_gap(ranked, "qi", "p").select("qi", "top1", r6("gap").alias("gap"))


@query(
    "SELECT qi, max(p) AS e_pmax, round(sum(p), 6) AS e_psum, count(*) AS e_ncand, CAST(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS e_nhi, CAST(sum(CASE WHEN p > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS e_nmid, max(CASE WHEN r = 2 THEN p END) AS e_p2nd, max(p) AS e_cosmax, max(CASE WHEN r = 1 THEN p END) AS e_top_p, max(CASE WHEN r = 1 THEN pj END) AS e_top_pj FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) AS r FROM er_scored) GROUP BY qi",
    "er_scored",
)
def entity_rollup(v):
    return group.entity_rollup(v.er_scored.withColumn("cos", F.col("p")), ("p", "pj")).withColumn("e_psum", r6("e_psum"))


@query("SELECT a.qi, a.pj, CAST(coalesce(sum(CASE WHEN b.p > 0.5 AND b.pj % 3 = a.pj % 3 THEN 1 ELSE 0 END), 0) AS BIGINT) AS x_sib_core_hi FROM er_scored a LEFT JOIN er_scored b ON a.qi = b.qi AND a.pj <> b.pj GROUP BY a.qi, a.pj", "er_scored")
def sib_core_hi(v):
    cores = v.er_pool.select("pj", (F.col("pj") % 3).cast("string").alias("core"))
    return group.core_siblings(v.er_scored, cores)


@query("SELECT * EXCLUDE (p, tp, owner, src), CAST(row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) - 1 AS INTEGER) AS s2_rank_q, count(*) OVER (PARTITION BY pj) AS s2_nclaim_pj FROM er_claims", ER)
def stage_two_frame(v):
    return group.stage_two(v.er_claims).select("qi", "pj", "s2_rank_q", "s2_nclaim_pj")


# Rules


@query("SELECT qi, pj, p FROM one", ER, ONE)
def one_to_one(v):
    return decide.one_to_one(v.er_scored).select("qi", "pj", "p")


@query("SELECT qi, pj, p FROM one WHERE p >= 0.6", ER, ONE)
def rule_threshold(v):
    return decide.apply(v.er_scored, "threshold", (0.6,))


@query("SELECT qi, pj, p FROM prep WHERE (r = 0 AND p >= 0.4) OR (r > 0 AND p >= 0.7)", ER, PREP)
def rule_top1_plus(v):
    return decide.apply(v.er_scored, "top1_plus", (0.4, 0.7))


@query("SELECT qi, pj, p FROM prep WHERE p >= 0.4 AND p >= 0.8 * mx", ER, PREP)
def rule_relative(v):
    return decide.apply(v.er_scored, "relative", (0.4, 0.8))


EXPECTED = "ef AS (SELECT *, 1.25 * s / (0.25 * (t + 0.05) + r + 1) AS ef FROM prep), efb AS (SELECT *, max(ef) OVER (PARTITION BY qi) AS best FROM ef), efm AS (SELECT *, min(CASE WHEN ef = best THEN r + 1 END) OVER (PARTITION BY qi) AS m FROM efb)"


@query("SELECT qi, pj, p FROM efm WHERE r + 1 <= m AND best > exp(l - 0.05)", ER, f"{PREP}, {EXPECTED}")
def rule_expected_f(v):
    return decide.apply(v.er_scored, "expected_f", (0.05,))


ENTITY = "ent AS (SELECT qi, max(p) AS e FROM er_scored GROUP BY qi)"


@query("SELECT qi, pj, p FROM prep JOIN ent USING (qi) WHERE e >= 0.6 AND ((r = 0 AND p >= 0.4) OR (r > 0 AND p >= 0.7))", ER, f"{PREP}, {ENTITY}")
def rule_gated(v):
    return decide.apply(v.er_scored, "gated", (0.6, 0.4, 0.7), v.er_scored.groupBy("qi").agg(F.max("p").alias("e")))


def grid_sql(grid: str, condition: str, params: str) -> str:
    return (
        f"SELECT {params}, round(avg(CASE WHEN k = 0 AND n = 0 THEN 1.0 WHEN k = 0 OR n = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * k + n) END), 6) AS f05 FROM (SELECT g.*, t.qi, t.k, coalesce(c.n, 0) AS n, coalesce(c.tp, 0) AS tp FROM ({grid}) g CROSS JOIN er_truth t LEFT JOIN "
        f"(SELECT {params}, qi, count(*) AS n, sum(CAST(tp AS BIGINT)) AS tp FROM prep CROSS JOIN ({grid}) WHERE {condition} GROUP BY {params}, qi) c USING ({params}, qi)) GROUP BY {params}"
    )


@query(grid_sql("SELECT CAST(x AS DOUBLE) / 1000 AS t0 FROM range(300, 951, 25) r(x)", "p >= t0", "t0"), ER, PREP)
def grid_tune_threshold(v):
    g = decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth, "threshold")
    return g.select(F.col("x0").alias("t0"), r6("f05").alias("f05"))


@query(grid_sql("SELECT CAST(a AS DOUBLE) / 10 AS x0, CAST(b AS DOUBLE) / 100 AS x1 FROM range(1, 8) ra(a), range(50, 96, 5) rb(b) WHERE CAST(b AS DOUBLE) / 100 >= CAST(a AS DOUBLE) / 10", "(r = 0 AND p >= x0) OR (r > 0 AND p >= x1)", "x0, x1"), ER, PREP)
def grid_tune_top1_plus(v):
    return decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth, "top1_plus").select("x0", "x1", r6("f05").alias("f05"))


@query(grid_sql("SELECT CAST(a AS DOUBLE) / 100 AS x0, CAST(b AS DOUBLE) / 10 AS x1 FROM range(30, 86, 5) ra(a), (VALUES (5), (7), (8)) rb(b)", "p >= x0 AND p >= x1 * mx", "x0, x1"), ER, PREP)
def grid_tune_relative(v):
    return decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth, "relative").select("x0", "x1", r6("f05").alias("f05"))


@query(
    grid_sql("SELECT CAST(a AS DOUBLE) / 10 AS x0, CAST(b AS DOUBLE) / 10 AS x1, CAST(c AS DOUBLE) / 100 AS x2 FROM range(0, 9) ra(a), range(2, 7) rb(b), range(60, 86, 5) rc(c)", "e >= x0 AND ((r = 0 AND p >= x1) OR (r > 0 AND p >= x2))", "x0, x1, x2").replace("FROM prep CROSS", "FROM (SELECT * FROM prep JOIN ent USING (qi)) CROSS"),
    ER,
    f"{PREP}, {ENTITY}",
)
def grid_tune_gated(v):
    e = v.er_scored.groupBy("qi").agg(F.max("p").alias("e"))
    return decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth, "gated", entity=e).select("x0", "x1", "x2", r6("f05").alias("f05"))


@query(
    "SELECT c0, round(avg(CASE WHEN k = 0 AND n = 0 THEN 1.0 WHEN k = 0 OR n = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * k + n) END), 6) AS f05 FROM (SELECT g.c0, t.k, coalesce(x.n, 0) AS n, coalesce(x.tp, 0) AS tp FROM g CROSS JOIN er_truth t LEFT JOIN (SELECT c0, qi, count(*) AS n, sum(CAST(tp AS BIGINT)) AS tp FROM (SELECT *, min(CASE WHEN ef = best THEN r + 1 END) OVER (PARTITION BY c0, qi) AS m FROM (SELECT *, max(ef) OVER (PARTITION BY c0, qi) AS best FROM (SELECT *, 1.25 * s / (0.25 * (t + c0) + r + 1) AS ef FROM prep CROSS JOIN g))) WHERE r + 1 <= m AND best > exp(l - c0) GROUP BY c0, qi) x ON x.c0 = g.c0 AND x.qi = t.qi) GROUP BY c0",
    ER,
    f"{PREP}, g AS (SELECT * FROM (VALUES (CAST(0.0 AS DOUBLE)), (0.05), (0.1), (0.2)) v(c0))",
)
def grid_tune_expected_f(v):
    return decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth, "expected_f").select(F.col("x0").alias("c0"), r6("f05").alias("f05"))


@query(f"SELECT t0, f05 FROM ({grid_sql('SELECT CAST(x AS DOUBLE) / 1000 AS t0 FROM range(100, 951, 25) r(x)', 'p >= t0', 't0').replace('er_truth t', '(SELECT * FROM er_truth WHERE fold < 3) t')}) ORDER BY f05 DESC, t0 LIMIT 1", ER, PREP)
def tune_threshold(v):
    g = decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth.filter("fold < 3"), "threshold", [(t,) for t in decide.steps(100, 950, 25, 1000)])
    return decide.best(g.withColumn("f05", r6("f05"))).select(F.col("x0").alias("t0"), "f05")


@query(
    f"SELECT round(avg({F05}), 6) AS f05, count(*) AS n_s1 FROM per WHERE fold >= 3",
    ER,
    f"{PREP}, tuned AS (SELECT t0 FROM ({grid_sql('SELECT CAST(x AS DOUBLE) / 100 AS t0 FROM range(20, 96, 5) r(x)', 'p >= t0', 't0').replace('er_truth t', '(SELECT * FROM er_truth WHERE fold < 3) t')}) ORDER BY f05 DESC, t0 LIMIT 1), kept AS (SELECT one.* FROM one, tuned WHERE p >= t0), {per('kept')}",
)
def quick_decision(v):
    grid = [(t,) for t in decide.steps(20, 95, 5, 100)]
    g = decide.grid_scores(v.er_claims.select("qi", "pj", "p", "tp"), v.er_truth.filter("fold < 3"), "threshold", grid)
    best = decide.best(g.withColumn("f05", r6("f05"))).select("x0")
    kept = decide.one_to_one(v.er_claims).join(F.broadcast(best)).filter("p >= x0")
    scored = metrics.per_entity(kept, v.er_truth).filter("fold >= 3")
    return scored.agg(r6(F.avg("f05")).alias("f05"), F.count("*").alias("n_s1"))


def strategy_sql(name: str, source: str) -> str:
    return f"SELECT '{name}' AS strategy, round(avg({F05}), 6) AS f05 FROM (SELECT t.k, coalesce(c.n, 0) AS n, coalesce(c.tp, 0) AS tp FROM er_truth t LEFT JOIN (SELECT qi, count(*) AS n, sum(CAST(tp AS BIGINT)) AS tp FROM {source} GROUP BY qi) c USING (qi) WHERE fold >= 3)"


@query(
    " UNION ALL ".join(
        strategy_sql(n, s)
        for n, s in (
            ("S0 threshold", "(SELECT * FROM er_claims WHERE p >= 0.6)"), ("S1 one-to-one", "(SELECT * FROM one WHERE p >= 0.6)"), ("S2 relative", "(SELECT * FROM prep WHERE p >= 0.4 AND p >= 0.7 * mx)"),
            ("S3 top1_plus", "(SELECT * FROM prep WHERE (r = 0 AND p >= 0.4) OR (r > 0 AND p >= 0.7))"), ("S4 expected_f", "(SELECT * FROM efm WHERE r + 1 <= m AND best > exp(l - 0.05))"),
        )
    ),
    ER,
    f"{PREP}, {EXPECTED}",
)
def strategy_matrix(v):
    prep, truth = decide.prepared(v.er_claims), v.er_truth
    kept = {
        "S0 threshold": v.er_claims.filter("p >= 0.6"), "S1 one-to-one": decide.threshold(prep, 0.6), "S2 relative": decide.relative(prep, 0.4, 0.7),
        "S3 top1_plus": decide.top1_plus(prep, 0.4, 0.7), "S4 expected_f": decide.expected_f(prep, 0.05),
    }
    out = None
    for name, k in kept.items():
        row = metrics.per_entity(k, truth).filter("fold >= 3").agg(r6(F.avg("f05")).alias("f05")).select(F.lit(name).alias("strategy"), "f05")
        out = row if out is None else out.unionByName(row)
    return out


FLOORS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


@query(f"SELECT t, recall FROM (SELECT t, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM er_claims WHERE tp) AS recall FROM er_claims, (SELECT unnest({FLOORS})::DOUBLE AS t) WHERE tp AND p >= t GROUP BY t) WHERE recall >= 0.95 ORDER BY t DESC LIMIT 1", ER)
def cheap_threshold_search(v):
    return diagnostics.cheap_threshold(v.er_claims, FLOORS, 0.05)


# Metrics


REPORT = "round(avg(f05), 6) AS f05, round(avg(CASE WHEN k = 0 THEN f05 END), 6) AS f05_singletons, round(avg(CASE WHEN k > 0 THEN f05 END), 6) AS f05_nonsingletons, round(CAST(sum(tp) AS DOUBLE) / greatest(sum(n), 1), 6) AS micro_precision, round(CAST(sum(tp) AS DOUBLE) / greatest(sum(k), 1), 6) AS micro_recall, round(avg(n), 6) AS avg_pred, round(avg(CASE WHEN k = 0 THEN CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END END), 6) AS singleton_false_merge, count(*) AS n_s1"


def rounded(df, *keep):
    return df.select(*[F.col(c) if c in keep or t in ("bigint", "int", "string") else r6(c).alias(c) for c, t in df.dtypes])


@query(f"SELECT {REPORT} FROM per", ER, f"{ONE}, {HIGH}, {per('kept')}")
def macro_f05(v):
    return rounded(metrics.report(metrics.per_entity(kept07(v), v.er_truth)))


@query(f"SELECT country, {REPORT} FROM per GROUP BY country", ER, f"{ONE}, {HIGH}, {per('kept')}")
def f05_by_country(v):
    return rounded(metrics.report(metrics.per_entity(kept07(v), v.er_truth), "country"))


@query("SELECT qi, k, n, tp, round(f05, 6) AS f05 FROM per", ER, f"{ONE}, {HIGH}, {per('kept')}")
def entity_f05(v):
    return metrics.per_entity(kept07(v), v.er_truth).select("qi", "k", "n", "tp", r6("f05").alias("f05"))


STATS = f"round(CAST(sum(tp) AS DOUBLE) / greatest(sum(k), 1), 6) AS pair_recall, round(avg({CEILING}), 6) AS ceiling_f05, round(avg(n), 6) AS cand_mean, quantile_cont(n, 0.5) AS cand_p50, quantile_cont(n, 0.9) AS cand_p90, round(quantile_cont(n, 0.99), 6) AS cand_p99, max(n) AS cand_max, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_cand_rate, round(avg(CASE WHEN k > 0 THEN CASE WHEN tp = k THEN 1.0 ELSE 0.0 END END), 6) AS full_entity_recall"


@query(f"SELECT {STATS} FROM per", ER, per("er_claims"))
def blocking_stats(v):
    return rounded(metrics.blocking(metrics.per_entity(v.er_claims, v.er_truth)))


@query(f"SELECT country, {STATS} FROM per GROUP BY country", ER, per("er_claims"))
def blocking_stats_by_country(v):
    return rounded(metrics.blocking(metrics.per_entity(v.er_claims, v.er_truth), "country"))


@query(f"SELECT round(avg({CEILING}), 6) AS upper_bound FROM per", ER, per("er_claims"))
def candidate_upper_bound(v):
    d = metrics.per_entity(v.er_claims, v.er_truth)
    return d.agg(r6(F.avg(metrics.ceiling(F.col("k"), F.col("tp")))).alias("upper_bound"))


KS = [1, 2, 3, 5, 10]
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) - 1 AS rank FROM er_claims)"


@query(f"SELECT topk, s.src, round(CAST(coalesce(sum(CASE WHEN rk.rank < topk THEN 1 ELSE 0 END), 0) AS DOUBLE) / any_value(s.n), 6) AS recall FROM (SELECT unnest({KS}) AS topk) g CROSS JOIN (SELECT src, count(*) AS n FROM er_pool WHERE owner >= 0 GROUP BY src) s LEFT JOIN rk ON rk.src = s.src AND rk.tp GROUP BY topk, s.src", ER, RANKED)
def recall_at_k(v):
    ranked = group.ranks(v.er_claims).withColumn("rank", F.col("s2_rank_q"))
    total = v.er_pool.filter("owner >= 0").groupBy("src").agg(F.count("*").alias("n"))
    return metrics.recall_at(ranked, total, KS, "src").withColumn("recall", r6("recall"))


@query(f"SELECT topk, round(CAST(sum(tp) AS DOUBLE) / sum(k), 6) AS recall, round(avg({CEILING}), 6) AS ceiling_f05, round(avg(n), 6) AS cand_mean FROM (SELECT g.topk, t.qi, t.k, coalesce(sum(CASE WHEN rk.rank < g.topk THEN 1 ELSE 0 END), 0) AS n, coalesce(sum(CASE WHEN rk.rank < g.topk AND rk.tp THEN 1 ELSE 0 END), 0) AS tp FROM (SELECT unnest({KS}) AS topk) g CROSS JOIN er_truth t LEFT JOIN rk ON rk.qi = t.qi GROUP BY g.topk, t.qi, t.k) GROUP BY topk", ER, RANKED)
def recall_curve(v):
    grid = F.array(*[F.lit(k) for k in KS])
    ranked = group.ranks(v.er_claims).withColumn("topk", F.explode(F.filter(grid, lambda k: F.col("s2_rank_q") < k)))
    per_k = ranked.groupBy("topk", "qi").agg(F.count("*").alias("n"), F.sum(F.col("tp").cast("long")).alias("tp"))
    d = v.er_truth.withColumn("topk", F.explode(grid)).join(per_k, ["topk", "qi"], "left").na.fill(0, ["n", "tp"])
    return d.groupBy("topk").agg(r6(F.sum("tp") / F.sum("k")).alias("recall"), r6(F.avg(metrics.ceiling(F.col("k"), F.col("tp")))).alias("ceiling_f05"), r6(F.avg("n")).alias("cand_mean"))


@query("SELECT qi, pj, p, CAST(r AS INTEGER) AS rank FROM (SELECT qi, pj, p, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) - 1 AS r FROM er_scored WHERE p >= 0.3) WHERE r < 3", "er_scored")
def topk_score_floor(v):
    from ..operators.blocking import ranked

    return ranked(v.er_scored.filter("p >= 0.3"), "qi", "pj", 3, "p").select("qi", "pj", "p", "rank")


@query(
    f"SELECT t, round(avg(n), 6) AS cand_per_s1, round(avg({CEILING}), 6) AS ceiling_f05, round(avg(CASE WHEN k = 0 AND kn = 0 THEN 1.0 WHEN k = 0 OR kn = 0 THEN 0.0 ELSE 1.25 * ktp / (0.25 * k + kn) END), 6) AS f05 FROM (SELECT g.t, e.qi, e.k, (SELECT count(*) FROM er_claims c WHERE c.qi = e.qi AND c.p >= g.t) AS n, (SELECT count(*) FROM er_claims c WHERE c.qi = e.qi AND c.p >= g.t AND c.tp) AS tp, (SELECT count(*) FROM one c WHERE c.qi = e.qi AND c.p >= g.t AND c.p >= 0.5) AS kn, (SELECT count(*) FROM one c WHERE c.qi = e.qi AND c.p >= g.t AND c.p >= 0.5 AND c.tp) AS ktp FROM (SELECT unnest({FLOORS})::DOUBLE AS t) g CROSS JOIN er_truth e) GROUP BY t",
    ER,
    ONE,
)
def size_curve(v):
    return rounded(diagnostics.size_curve(v.er_claims, v.er_truth, FLOORS), "t")


@query(
    "SELECT s.qi, s.country, round(CASE WHEN coalesce(k.n, 0) = 0 THEN CASE WHEN coalesce(a.mass, 0) < 0.5 THEN 1.0 ELSE 0.0 END ELSE 1.25 * (k.got / k.n) * (k.got / a.mass) / (0.25 * (k.got / k.n) + k.got / a.mass) END, 6) AS est FROM er_s1 s LEFT JOIN (SELECT qi, sum(p) AS mass FROM er_scored GROUP BY qi) a USING (qi) LEFT JOIN (SELECT qi, sum(p) AS got, count(*) AS n FROM kept GROUP BY qi) k USING (qi)",
    ER,
    f"{ONE}, {HIGH}",
)
def selfest_f05(v):
    return diagnostics.self_estimate(v.er_scored, kept07(v), v.er_s1).withColumn("est", r6("est"))


@query("SELECT class, count(*) AS n, round(sum(1 - f05) / (SELECT count(*) FROM per), 6) AS loss FROM (SELECT *, CASE WHEN k = 0 AND n > 0 THEN 'singleton merged' WHEN k > 0 AND n = 0 THEN 'nothing kept' WHEN tp < k AND tp < n THEN 'missed and false' WHEN tp < n THEN 'false only' WHEN tp < k THEN 'missed only' ELSE 'perfect' END AS class FROM per) GROUP BY class", ER, f"{ONE}, {HIGH}, {per('kept')}")
def loss_decomposition(v):
    return diagnostics.loss_classes(metrics.per_entity(kept07(v), v.er_truth)).withColumn("loss", r6("loss"))


@query(
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM er_scored s WHERE s.qi = p.owner AND s.pj = p.pj) THEN 'not a candidate' WHEN NOT EXISTS (SELECT 1 FROM er_scored s WHERE s.qi = p.owner AND s.pj = p.pj AND s.p >= 0.2) THEN 'filtered' WHEN NOT EXISTS (SELECT 1 FROM one s WHERE s.qi = p.owner AND s.pj = p.pj) THEN 'taken by another' ELSE 'below the rule' END AS reason FROM er_pool p WHERE p.owner >= 0 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.qi = p.owner AND k.pj = p.pj)) GROUP BY reason",
    ER,
    f"{ONE}, {HIGH}",
)
def missed_attribution(v):
    return diagnostics.missed(truth_pairs(v), v.er_scored, v.er_scored.filter("p >= 0.2"), decide.one_to_one(v.er_scored), kept07(v))


@query("SELECT qi, pj, p, owner FROM kept WHERE owner <> qi", ER, f"{ONE}, {HIGH}")
def false_merge_profile(v):
    return diagnostics.false_merges(kept07(v))


@query(f"SELECT round(avg({F05}), 6) AS f05 FROM per", ER, "claims2 AS (SELECT c.* FROM er_claims c JOIN er_truth t USING (qi) WHERE t.k > 0), one2 AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY pj ORDER BY p DESC, qi) AS n FROM claims2) WHERE n = 1), kept AS (SELECT * FROM one2 WHERE p >= 0.7), " + per("kept"))
def oracle_singleton_ceiling(v):
    left = diagnostics.without_singletons(v.er_claims, v.er_truth)
    kept = decide.threshold(decide.one_to_one(left), 0.7)
    return metrics.per_entity(kept, v.er_truth).agg(r6(F.avg("f05")).alias("f05"))


@query(
    "SELECT country, round(CAST(coalesce(u, 0) AS DOUBLE) / n, 6) AS unsure, round(CAST(coalesce(w, 0) AS DOUBLE) / n, 6) AS weak FROM (SELECT country, count(*) AS n FROM er_s1 GROUP BY country) LEFT JOIN (SELECT country, count(*) AS u FROM er_scored JOIN er_s1 USING (qi) WHERE p >= 0.1 AND p < 0.9 GROUP BY country) USING (country) LEFT JOIN (SELECT country, count(*) AS w FROM one JOIN er_s1 USING (qi) WHERE p >= 0.5 AND p < 0.7 GROUP BY country) USING (country)",
    ER,
    ONE,
)
def uncertain_mass(v):
    kept = decide.threshold(decide.one_to_one(v.er_claims), 0.5)
    return rounded(diagnostics.uncertain(v.er_scored, kept, v.er_s1), "country")


@query("SELECT fold, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM er_truth GROUP BY fold", "er_truth")
def fold_sizes(v):
    return v.er_truth.groupBy("fold").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(
    "SELECT CASE WHEN k = 0 THEN 'singleton' ELSE 'matched' END AS kind, count(*) AS n, round(quantile_cont(top1, 0.5), 6) AS top1_median, round(quantile_cont(gap, 0.5), 6) AS gap_median, round(avg(CASE WHEN k > 0 THEN CASE WHEN own THEN 1.0 ELSE 0.0 END END), 6) AS top1_true FROM (SELECT c.qi, t.k, max(CASE WHEN r = 1 THEN p END) AS top1, max(CASE WHEN r = 1 THEN p END) - coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS gap, bool_or(r = 1 AND tp) AS own FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY p DESC, pj) AS r FROM er_claims) c JOIN er_truth t USING (qi) GROUP BY c.qi, t.k) GROUP BY 1",
    ER,
)
def top1_quality(v):
    ranked = group.ranks(v.er_claims)
    at = lambda i: F.max(F.when(F.col("s2_rank_q") == i, F.col("p")))
    per_q = ranked.groupBy("qi").agg(at(0).alias("top1"), (at(0) - F.coalesce(at(1), F.lit(0.0))).alias("gap"), F.max(((F.col("s2_rank_q") == 0) & F.col("tp")).cast("int")).alias("own")).join(v.er_truth, "qi")
    kind = F.when(F.col("k") == 0, "singleton").otherwise("matched")
    return per_q.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), r6(F.percentile("top1", F.lit(0.5))).alias("top1_median"), r6(F.percentile("gap", F.lit(0.5))).alias("gap_median"), r6(F.avg(F.when(F.col("k") > 0, F.col("own").cast("double")))).alias("top1_true"))


@query(
    "SELECT country, round(quantile_cont(top1, 0.1), 6) AS p10, round(quantile_cont(top1, 0.25), 6) AS p25, round(quantile_cont(top1, 0.5), 6) AS p50, round(quantile_cont(top1, 0.75), 6) AS p75, round(quantile_cont(top1, 0.9), 6) AS p90, round(avg(near), 6) AS near FROM (SELECT s.country, qi, max(p) AS top1, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS near FROM er_scored JOIN er_s1 s USING (qi) GROUP BY s.country, qi) GROUP BY country",
    ER,
)
def probe_quantiles(v):
    per_q = v.er_scored.join(v.er_s1.select("qi", "country"), "qi").groupBy("country", "qi").agg(F.max("p").alias("top1"), F.sum((F.col("p") >= 0.5).cast("int")).alias("near"))
    q = profile.quantiles(per_q, F.col("top1"), "country").join(per_q.groupBy("country").agg(F.avg("near").alias("near")), "country")
    return rounded(q, "country")


HASH = "(qi * 7919 + pj * 104729 + 17) % 10007"


@query(f"SELECT * FROM (SELECT qi, pj, 1 AS label FROM er_claims WHERE tp ORDER BY {HASH}, qi, pj LIMIT 100) UNION ALL SELECT * FROM (SELECT qi, pj, 0 AS label FROM er_claims WHERE NOT tp ORDER BY {HASH}, qi, pj LIMIT 300)", ER)
def training_pairs(v):
    """Matches and three times as many others, by a hash order, to train a pair scorer on."""
    order = F.pmod(F.col("qi") * 7919 + F.col("pj") * 104729 + 17, F.lit(10007))
    pos = sampling.sample(v.er_claims.filter("tp"), 100, order, "qi", "pj")
    return pos.unionByName(sampling.sample(v.er_claims.filter("not tp"), 300, order, "qi", "pj")).select("qi", "pj", F.col("tp").cast("int").alias("label"))


@query("SELECT qi, pj, p, CAST(tp AS INTEGER) AS label, max(p) OVER (PARTITION BY qi) AS q_top1, max(p) OVER (PARTITION BY pj) AS p_top1 FROM er_claims", ER)
def candidate_file(v):
    return tables.candidate_file(v.er_claims, "p").select("qi", "pj", "p", "label", "q_top1", "p_top1")

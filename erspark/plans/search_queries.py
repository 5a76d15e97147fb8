"""Queries over vectors and texts: blocking, normal forms, pair features, profiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import sets
from ..functions import text as tx
from ..functions import fuzzy
from ..operators import blocking, diagnostics, features, group, metrics, profile, stats
from . import normal_sql as ns
from .er_queries import r6
from .registry import query
from .views import with_views

VEC = "vec_q vec_p"
DOT = "list_inner_product(CAST(q.e AS DOUBLE[]), CAST(p.e AS DOUBLE[]))"
SCORED = f"sc AS (SELECT q.qi, p.pj, q.country, {DOT} AS cos FROM vec_q q JOIN vec_p p ON q.country = p.country)"
FWD = "fwd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, pj) - 1 AS rank FROM sc) WHERE rank < 10)"
REV = "rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pj ORDER BY cos DESC, qi) - 1 AS rank FROM sc) WHERE rank < 3)"
BLOCK = f"{SCORED}, {FWD}, {REV}, blk AS (SELECT coalesce(f.qi, r.qi) AS qi, coalesce(f.pj, r.pj) AS pj, coalesce(f.cos, r.cos) AS cos, f.rank AS fwd_rank, r.rank AS rev_rank FROM fwd f FULL JOIN rev r ON f.qi = r.qi AND f.pj = r.pj)"


@query("SELECT qi, pj, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM fwd", VEC, f"{SCORED}, {FWD}")
def knn_forward_topk(v):
    return blocking.knn(v.vec_q, v.vec_p, 10).select("qi", "pj", r6("cos").alias("cos"), "rank")


@query("SELECT qi, pj, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM rev", VEC, f"{SCORED}, {REV}")
def knn_reverse_topk(v):
    return blocking.knn(v.vec_q, v.vec_p, 3, "pj").select("qi", "pj", r6("cos").alias("cos"), "rank")


@query("SELECT qi, pj, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM fwd", VEC, f"{SCORED}, {FWD}")
def knn_block_kernel(v):
    return blocking.knn(v.vec_q, v.vec_p, 10, backend="blocks").select("qi", "pj", r6("cos").alias("cos"), "rank")


@query("SELECT qi, pj, round(cos, 6) AS cos FROM sc", VEC, SCORED)
def pair_cosine(v):
    return blocking.pair_scores(v.vec_q, v.vec_p).select("qi", "pj", r6("cos").alias("cos"))


@query("SELECT qi, pj, round(cos, 6) AS cos, CAST(fwd_rank AS INTEGER) AS fwd_rank, CAST(rev_rank AS INTEGER) AS rev_rank FROM blk", VEC, BLOCK)
def block_union(v):
    return blocking.block(v.vec_q, v.vec_p).withColumn("cos", r6("cos"))


@query("SELECT qi, pj, CAST(fwd_rank AS INTEGER) AS fwd_rank, CAST(rev_rank AS INTEGER) AS rev_rank FROM blk", VEC, BLOCK)
def fwd_rev_full_outer(v):
    return blocking.union_candidates(blocking.knn(v.vec_q, v.vec_p, 10), blocking.knn(v.vec_q, v.vec_p, 3, "pj")).select("qi", "pj", "fwd_rank", "rev_rank")


@query("SELECT qi, pj, CAST(fwd_rank AS INTEGER) AS fwd_rank, CAST(rev_rank AS INTEGER) AS rev_rank FROM blk", "vec_p", "vec_q AS (SELECT vec_id AS qi, embedding AS e, label AS country FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 25 <> 20), " + BLOCK)
def block_hidden(v):
    return blocking.block(v.vec_q, v.vec_p, hidden=F.col("qi") % 25 == 20).select("qi", "pj", "fwd_rank", "rev_rank")


@query(
    "SELECT b.qi, b.pj, round(q1 - b.cos, 6) AS gap_q, round(p1 - b.cos, 6) AS rev_margin, CASE WHEN fwd_rank = 0 AND rev_rank = 0 THEN 1 ELSE 0 END AS mutual, count(*) OVER (PARTITION BY b.qi) AS n_cand_q, CASE WHEN src = 'S3' THEN 1 ELSE 0 END AS is_s3 FROM blk b JOIN (SELECT qi, max(cos) AS q1 FROM sc GROUP BY qi) USING (qi) JOIN (SELECT pj, max(cos) AS p1 FROM sc GROUP BY pj) USING (pj) JOIN vec_p USING (pj)",
    VEC,
    BLOCK,
)
def context_features(v):
    scored = blocking.pair_scores(v.vec_q, v.vec_p)
    d = blocking.context(blocking.block(v.vec_q, v.vec_p), scored, v.vec_p)
    return d.select("qi", "pj", r6("gap_q").alias("gap_q"), r6("rev_margin").alias("rev_margin"), "mutual", "n_cand_q", "is_s3")


@query("SELECT topk, round(CAST(count(r.pj) AS DOUBLE) / count(*), 6) AS overlap FROM (SELECT g.topk, f.qi, f.pj FROM (SELECT unnest([1, 3, 10]) AS topk) g JOIN fwd f ON f.rank < g.topk) x LEFT JOIN (SELECT qi, pj, rank FROM rev) r ON r.qi = x.qi AND r.pj = x.pj AND r.rank < x.topk GROUP BY topk", VEC, f"{SCORED}, {FWD}, {REV}")
def overlap_at_k(v):
    a, b = blocking.knn(v.vec_q, v.vec_p, 10), blocking.knn(v.vec_q, v.vec_p, 3, "pj")
    return diagnostics.overlap_at(a, b, [1, 3, 10]).withColumn("overlap", r6("overlap"))


@query()
def ivf_topk(v):
    return blocking.ivf(v.vec_q, v.vec_p, 10, probes=2, list_size=8, recall=0.95).select("qi", "pj", r6("cos").alias("cos"), "rank")


@query()
def lsh_topk(v):
    """Every row whose id is divisible by 100, against all rows, itself among them."""
    rows = v.embeddings.select(F.col("vec_id").alias("pj"), F.col("embedding").alias("e"), F.col("label").alias("country"))
    return blocking.lsh(rows.filter("pj % 100 = 0").withColumnRenamed("pj", "qi"), rows, 10, 64).select("qi", "pj", r6("cos").alias("cos"), "rank")


@query()
def ann_impact(v):
    exact = blocking.knn(v.vec_q, v.vec_p, 10, backend="blocks")
    found = {"ivf": blocking.ivf(v.vec_q, v.vec_p, 10, probes=2, list_size=8, recall=0.95), "lsh": blocking.lsh(v.vec_q, v.vec_p, 10, 64)}
    out = [diagnostics.overlap_at(exact, d, [1, 5, 10]).select(F.lit(name).alias("index"), "topk", r6("overlap").alias("overlap")) for name, d in found.items()]
    return out[0].unionByName(out[1])


VS = f"{SCORED}, {FWD}, vs AS (SELECT f.qi, f.pj, round(f.cos * 0.5 + 0.5, 9) AS p, p.src, p.e FROM fwd f JOIN vec_p p USING (pj)), sib AS (SELECT a.qi, a.pj, a.src, b.pj AS opj, b.p AS op, b.src AS osrc, list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS c FROM vs a JOIN vs b ON a.qi = b.qi AND a.pj <> b.pj)"


def vec_scored(v):
    return blocking.knn(v.vec_q, v.vec_p, 10).withColumn("p", F.round(F.col("cos") * 0.5 + 0.5, 9)).join(v.vec_p.select("pj", "src"), "pj").select("qi", "pj", "p", "src", "cos")


@query("SELECT qi, pj, round(sum(op * c) / sum(op), 6) AS x_emb_wmean FROM sib GROUP BY qi, pj", VEC, VS)
def emb_wmean_siblings(v):
    d = group.vector_cluster(vec_scored(v), v.vec_p)
    return d.filter("x_emb_wmean is not null").select("qi", "pj", r6("x_emb_wmean").alias("x_emb_wmean"))


@query("SELECT a.qi, a.pj, round(max(CASE WHEN op > 0.5 THEN c END), 6) AS x_emb_max_hi, CAST(coalesce(sum(CASE WHEN op > 0.5 AND c > 0.9 THEN 1 ELSE 0 END), 0) AS BIGINT) AS x_emb_n_close_hi, round(max(CASE WHEN op > 0.5 AND osrc <> a.src THEN c END), 6) AS x_emb_max_hi_other FROM vs a LEFT JOIN sib s ON s.qi = a.qi AND s.pj = a.pj GROUP BY a.qi, a.pj", VEC, VS)
def emb_max_hi(v):
    d = group.vector_cluster(vec_scored(v), v.vec_p)
    return d.select("qi", "pj", r6("x_emb_max_hi").alias("x_emb_max_hi"), "x_emb_n_close_hi", r6("x_emb_max_hi_other").alias("x_emb_max_hi_other"))


@query("SELECT v.qi, v.pj, round(s.c, 6) AS x_emb_sib_top FROM (SELECT qi, pj, CASE WHEN r = 1 THEN sec ELSE fst END AS ref FROM (SELECT qi, pj, row_number() OVER w AS r, first_value(pj) OVER w AS fst, nth_value(pj, 2) OVER (PARTITION BY qi ORDER BY p DESC, pj ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sec FROM vs WINDOW w AS (PARTITION BY qi ORDER BY p DESC, pj))) v LEFT JOIN sib s ON s.qi = v.qi AND s.pj = v.pj AND s.opj = v.ref", VEC, VS)
def emb_sib_top(v):
    return group.vector_cluster(vec_scored(v), v.vec_p).select("qi", "pj", r6("x_emb_sib_top").alias("x_emb_sib_top"))


# Profiles of texts


@query(
    "SELECT country, count(*) AS n, round(avg(length(name)), 6) AS name_len, median(length(name)) AS name_len_median, round(avg(length(coalesce(addr, ''))), 6) AS addr_len, round(quantile_cont(length(coalesce(addr, '')), 0.9), 6) AS addr_len_p90, round(avg(CASE WHEN coalesce(addr, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS addr_empty, round(avg(CASE WHEN regexp_matches(name, '[^\\x00-\\x7F]') THEN 1.0 ELSE 0.0 END), 6) AS name_non_ascii, round(avg(CASE WHEN regexp_matches(addr, '[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS addr_digit, round(avg(CASE WHEN regexp_matches(addr, '(^|[^0-9])[0-9]{5}([^0-9]|$)') THEN 1.0 ELSE 0.0 END), 6) AS zip5, round(avg(CASE WHEN regexp_matches(addr, '(^|[^0-9])[0-9]{6}([^0-9]|$)') THEN 1.0 ELSE 0.0 END), 6) AS pin6, round(avg(CASE WHEN contains(addr, ',') THEN 1.0 ELSE 0.0 END), 6) AS addr_comma FROM txt_all GROUP BY country",
    "txt_all",
)
def profile_text_stats(v):
    d = profile.text_stats(v.txt_all, "country")
    return d.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


TOK = "regexp_split_to_array(trim(regexp_replace(lower(name), '[^0-9a-zß-ÿ]+', ' ', 'g')), ' +')"


def raw_tokens(c):
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^0-9a-zß-ÿ]+", " "), " "), lambda t: t != "")


@query(f"SELECT country, t, c, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY c DESC, t) AS r FROM (SELECT country, t, count(*) AS c FROM (SELECT country, unnest({TOK}) AS t FROM txt_all) WHERE t <> '' GROUP BY country, t)) WHERE r <= 20", "txt_all")
def token_top_n(v):
    return profile.top_tokens(v.txt_all, raw_tokens(F.col("name")), 20, "country")


@query(f"SELECT country, t, c, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY c DESC, t) AS r FROM (SELECT country, ({TOK})[-1] AS t, count(*) AS c FROM txt_all WHERE ({TOK})[-1] <> '' GROUP BY ALL)) WHERE r <= 10", "txt_all")
def last_token_top_n(v):
    return profile.top_tokens(v.txt_all, F.slice(F.reverse(raw_tokens(F.col("name"))), 1, 1), 10, "country")


@query(f"SELECT country, t, count(*) AS df FROM (SELECT country, unnest(list_distinct({TOK})) AS t FROM txt_all) WHERE t <> '' GROUP BY country, t", "txt_all")
def doc_freq(v):
    return stats.document_frequency(v.txt_all, raw_tokens(F.col("name")), "country")


@query(f"SELECT d.country, t, df, round(ln(CAST(n + 1 AS DOUBLE) / (df + 1)) + 1, 6) AS idf, round(ln(n + 1.0) + 1, 6) AS dflt FROM (SELECT country, t, count(*) AS df FROM (SELECT country, unnest(list_distinct({TOK})) AS t FROM txt_all) WHERE t <> '' GROUP BY country, t) d JOIN (SELECT country, count(*) AS n FROM txt_all GROUP BY country) USING (country) WHERE df >= 2", "txt_all")
def token_idf(v):
    d = stats.idf(v.txt_all, raw_tokens(F.col("name")))
    return d.select("country", "t", "df", r6("idf").alias("idf"), r6("dflt").alias("dflt"))


# Normal forms

SIDE = "id, country, name, addr"


def norm(v, level=4):
    rows = v.txt_all.select(F.col("doc_id").alias("id"), "country", "name", "addr")
    return rows.withColumn("nname", tx.normalize(F.col("name"), level, "name")).withColumn("naddr", tx.normalize(F.col("addr"), level, "addr", F.col("country")))


@query("SELECT id, nname, naddr FROM norm", "txt_all", ns.normal_ctes(4))
def normalize_l4(v):
    return norm(v).select("id", "nname", "naddr")


@query("SELECT id, nname, naddr FROM norm", "txt_all", ns.normal_ctes(1))
def normalize_l1(v):
    return norm(v, 1).select("id", "nname", "naddr")


@query("SELECT doc_id AS id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS nname FROM txt_all", "txt_all")
def normalize_l0(v):
    return v.txt_all.select(F.col("doc_id").alias("id"), tx.normalize(F.col("name"), 0).alias("nname"))


@query("SELECT id, nname FROM norm", "txt_all", ns.normal_ctes(4))
def normalize_distinct_values(v):
    rows = v.txt_all.select(F.col("doc_id").alias("id"), "name", "country")
    return tx.normalize_table(rows, "name", "nname", 4, "name", "country").select("id", "nname")


@query("SELECT doc_id AS id, strip_accents(lower(name)) AS folded FROM txt_all", "txt_all")
def fold_accents(v):
    return v.txt_all.select(F.col("doc_id").alias("id"), tx.fold_latin(F.lower("name")).alias("folded"))


@query(f"SELECT t, {ns.skeleton('t')} AS skel FROM (SELECT DISTINCT unnest(string_split(nname, ' ')) AS t FROM norm) WHERE t <> ''", "txt_all", ns.normal_ctes(1))
def skeleton(v):
    t = norm(v, 1).select(F.explode(tx.words(F.col("nname"))).alias("t")).distinct()
    return t.select("t", tx.skeleton(F.col("t")).alias("skel"))


@query("SELECT id, core FROM rec", "", ns.record_ctes())
def core_names(v):
    return norm(v).select("id", tx.core_name(F.col("nname")).alias("core"))


CANON = "SELECT n_nationkey AS id, 'The ' || n_name || ' Private Limited Company' AS name, '12 ' || n_name || ' Road, North Avenue' AS addr, 'X' AS country FROM nation"


@query("SELECT id, nname, naddr FROM norm", "", ns.normal_ctes(4, CANON))
def canon_words(v):
    rows = v.nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("The "), "n_name", F.lit(" Private Limited Company")).alias("name"), F.concat(F.lit("12 "), "n_name", F.lit(" Road, North Avenue")).alias("addr"))
    return rows.select("id", tx.normalize(F.col("name")).alias("nname"), tx.normalize(F.col("addr"), 4, "addr", F.lit("X")).alias("naddr"))


NUMS = "list_distinct(list_transform(regexp_extract_all(s, '[0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '0+') THEN '0' ELSE ltrim(t, '0') END))"


@query(f"SELECT id, array_to_string(list_sort({NUMS}), ',') AS nums, CASE WHEN regexp_extract(s, '[0-9]+') = '' THEN '' WHEN regexp_full_match(regexp_extract(s, '[0-9]+'), '0+') THEN '0' ELSE ltrim(regexp_extract(s, '[0-9]+'), '0') END AS first FROM (SELECT c_custkey AS id, c_name || ' 007-42, 0 ' || CAST(c_custkey AS VARCHAR) AS s FROM customer)")
def numbers_first(v):
    s = F.concat("c_name", F.lit(" 007-42, 0 "), F.col("c_custkey").cast("string"))
    return v.customer.select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(tx.numbers(s)), ",").alias("nums"), tx.first_number(s).alias("first"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(s, '\\b([0-9]{3}) ([0-9]{3})\\b', '\\1\\2', 'g'), '[0-9]+'), lambda t: length(t) IN (5, 6)))), ',') AS zips FROM (SELECT c_custkey AS id, 'x 700 ' || CAST(100 + c_custkey % 900 AS VARCHAR) || ' y ' || CAST(c_custkey * 37 AS VARCHAR) AS s FROM customer)")
def zips(v):
    s = F.concat(F.lit("x 700 "), (100 + F.col("c_custkey") % 900).cast("string"), F.lit(" y "), (F.col("c_custkey") * 37).cast("string"))
    return v.customer.select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(tx.zips(s)), ",").alias("zips"))


@query("SELECT page_id AS id, regexp_replace(lower(url), '\\b(?:https?://)?(?:www\\.)?([a-z0-9\\-]+)\\.(?:com|in|net|org|co|io|biz|info|fr|us)\\b', ' \\1 ', 'g') AS domain FROM pages")
def url_domain(v):
    return v.pages.select(F.col("page_id").alias("id"), tx.url_domain(F.lower("url")).alias("domain"))


@query("SELECT t, regexp_replace(regexp_replace(t, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g') AS parts FROM (SELECT lower(replace(p_brand, '#', '')) || 'x' || CAST(p_size AS VARCHAR) || 'q' AS t FROM part)")
def split_alnum(v):
    t = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("x"), F.col("p_size").cast("string"), F.lit("q"))
    return v.part.select(t.alias("t")).select("t", tx.split_alnum(F.col("t")).alias("parts"))


SINGLES = "SELECT doc_id AS id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda t: t <> '') AS toks FROM documents"


@query(f"SELECT id, trim(array_to_string(list_transform(toks, lambda t, i: t || CASE WHEN i < len(toks) AND length(t) = 1 AND length(toks[i + 1]) = 1 THEN '' ELSE ' ' END), '')) AS joined FROM ({SINGLES})")
def join_singles(v):
    s = F.array_join(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda t: t != ""), " ")
    return v.documents.select(F.col("doc_id").alias("id"), tx.join_singles(s).alias("joined"))


@query(f"SELECT id, array_to_string(list_filter(toks, lambda t, i: i = 1 OR t <> toks[i - 1]), ' ') AS deduped FROM ({SINGLES})")
def dedupe_adjacent(v):
    s = F.array_join(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda t: t != ""), " ")
    return v.documents.select(F.col("doc_id").alias("id"), tx.drop_repeats(s).alias("deduped"))


@query()
def address_components(v):
    return v.txt_all.select(F.col("doc_id").alias("id"), F.array_join(tx.components(F.col("addr")), "|").alias("parts"))


@query("SELECT doc_id AS id, CASE WHEN coalesce(addr, '') = '' THEN name ELSE name || ' , ' || addr END AS joint FROM txt_all", "txt_all")
def joint_text(v):
    return v.txt_all.select(F.col("doc_id").alias("id"), tx.joint_text(F.col("name"), F.col("addr")).alias("joint"))


@query("SELECT doc_id AS id, regexp_matches(name, '[\\x{0900}-\\x{0D7F}]') AS indic FROM txt_all", "txt_all")
def has_indic(v):
    return v.txt_all.select(F.col("doc_id").alias("id"), tx.has_indic(F.col("name")).alias("indic"))


@query("SELECT doc_id AS id, trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(name, ''))), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS w FROM txt_all", "txt_all")
def profile_words(v):
    return v.txt_all.select(F.col("doc_id").alias("id"), tx.profile_words(F.col("name")).alias("w"))


# Pair features

PAIRS = "pairs AS (SELECT tp.qi, tp.pj, a, b FROM txt_pairs tp JOIN rec a ON a.id = tp.qi JOIN rec b ON b.id = tp.pj)"
REC = ns.record_ctes() + ", txt_pairs AS (SELECT s.qi, p.pj, s.country FROM txt_s1 s JOIN txt_pool p ON p.pj BETWEEN s.qi + 1 AND s.qi + 4), " + PAIRS


def framed(v):
    q = features.records(v.txt_s1)
    p = features.records(v.txt_pool)
    # Pool ids follow the query's closely, so the pairs are an equi-join on the block of five.
    pairs = v.txt_s1.select("qi", F.col("qi").alias("b")).join(v.txt_pool.select("pj", (F.col("pj") - F.col("pj") % 5).alias("b")), "b").select("qi", "pj")
    return features.pair_frame(pairs, q, p), q, p


def shown(d, columns):
    return d.select("qi", "pj", *[F.round(c, 6).alias(n) for n, c in columns.items()])


J = ns.jaccard


@query(f"SELECT qi, pj, round({J('a.ntri', 'b.ntri')}, 6) AS name_tri_j, round({J('a.ntok', 'b.ntok')}, 6) AS name_tok_j, round({J('a.ctok', 'b.ctok')}, 6) AS core_tok_j, round({J('a.skels', 'b.skels')}, 6) AS skel_j, CASE WHEN a.naddr <> '' AND b.naddr <> '' THEN round({J('a.atri', 'b.atri')}, 6) END AS addr_tri_j, CASE WHEN a.naddr <> '' AND b.naddr <> '' THEN round({J('a.atok', 'b.atok')}, 6) END AS addr_tok_j FROM pairs", "", REC)
def jaccard_tri_tok(v):
    f = features.name_features() | features.address_features()
    return shown(framed(v)[0], {k: f[k] for k in ("name_tri_j", "name_tok_j", "core_tok_j", "skel_j", "addr_tri_j", "addr_tok_j")})


@query(f"SELECT qi, pj, round({ns.containment('a.ctok', 'b.ctok')}, 6) AS core_contain, CAST(CASE WHEN a.core = b.core AND a.core <> '' THEN 1 ELSE 0 END AS DOUBLE) AS core_exact, CASE WHEN a.naddr <> '' AND b.naddr <> '' THEN round({ns.containment('a.atok', 'b.atok')}, 6) END AS addr_contain FROM pairs", "", REC)
def containment(v):
    f = features.name_features() | features.address_features()
    return shown(framed(v)[0], {k: f[k] for k in ("core_contain", "core_exact", "addr_contain")})


FA, FB = "replace(a.nname, ' ', '')", "replace(b.nname, ' ', '')"


@query(f"SELECT qi, pj, CAST(CASE WHEN {FA} = {FB} AND {FA} <> '' THEN 1 ELSE 0 END AS DOUBLE) AS nospace_eq, CAST(CASE WHEN least(length({FA}), length({FB})) >= 4 AND (contains({FA}, {FB}) OR contains({FB}, {FA})) THEN 1 ELSE 0 END AS DOUBLE) AS nospace_contain FROM pairs", "", REC)
def nospace(v):
    f = features.name_features()
    return shown(framed(v)[0], {k: f[k] for k in ("nospace_eq", "nospace_contain")})


BOTHN = "len(a.nums) > 0 AND len(b.nums) > 0"


@query(f"SELECT qi, pj, CAST(len(a.nums) AS DOUBLE) AS num_n_q, CAST(len(b.nums) AS DOUBLE) AS num_n_c, CASE WHEN {BOTHN} THEN round({J('a.nums', 'b.nums')}, 6) END AS num_j, CASE WHEN {BOTHN} THEN CASE WHEN len(list_intersect(a.nums, b.nums)) > 0 THEN 1.0 ELSE 0.0 END END AS num_share, CASE WHEN {BOTHN} THEN CASE WHEN len(list_intersect(a.nums, b.nums)) = 0 THEN 1.0 ELSE 0.0 END END AS num_conflict, CASE WHEN a.num1 <> '' AND b.num1 <> '' THEN CASE WHEN a.num1 = b.num1 THEN 1.0 ELSE 0.0 END END AS first_eq FROM pairs", "", REC)
def num_features(v):
    f = features.number_features()
    return shown(framed(v)[0], {k: f[k] for k in ("num_n_q", "num_n_c", "num_j", "num_share", "num_conflict", "first_eq")})


@query(
    "SELECT c.c_custkey AS qi, o.o_orderkey AS pj, CAST(levenshtein(CAST(c.c_custkey * 13 AS VARCHAR), CAST(o.o_orderkey AS VARCHAR)) AS DOUBLE) AS num_min_edit, CAST(CASE WHEN CAST(c.c_custkey * 13 AS VARCHAR) <> CAST(o.o_orderkey AS VARCHAR) AND least(length(CAST(c.c_custkey * 13 AS VARCHAR)), length(CAST(o.o_orderkey AS VARCHAR))) >= 2 AND (contains(CAST(c.c_custkey * 13 AS VARCHAR), CAST(o.o_orderkey AS VARCHAR)) OR contains(CAST(o.o_orderkey AS VARCHAR), CAST(c.c_custkey * 13 AS VARCHAR))) THEN 1 ELSE 0 END AS DOUBLE) AS num_contain, round(abs(c.c_custkey * 13 - o.o_orderkey) / greatest(c.c_custkey * 13, o.o_orderkey, 1.0), 6) AS num_min_reldiff, CAST(levenshtein(CAST(c.c_custkey * 13 AS VARCHAR), CAST(o.o_orderkey AS VARCHAR)) AS DOUBLE) AS first_edit FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey"
)
def fuzzy_numbers(v):
    side = lambda n: F.struct(F.array(n).alias("nums"), n.alias("num1"))
    d = v.customer.join(v.orders, F.col("o_custkey") == F.col("c_custkey"))
    d = d.select(F.col("c_custkey").alias("qi"), F.col("o_orderkey").alias("pj"), side((F.col("c_custkey") * 13).cast("string")).alias("a"), side(F.col("o_orderkey").cast("string")).alias("b"))
    return shown(d, features.fuzzy_number_features())


@query(
    "SELECT qi, pj, CAST(coalesce(x.n, 0) AS BIGINT) AS n_s1_core_q, CAST(coalesce(y.n, 0) AS BIGINT) AS n_pool_core_c FROM pairs LEFT JOIN (SELECT country, core, count(*) AS n FROM rec WHERE id % 5 = 0 AND core <> '' GROUP BY country, core) x ON x.country = a.country AND x.core = a.core LEFT JOIN (SELECT country, core, count(*) AS n FROM rec WHERE id % 5 <> 0 AND core <> '' GROUP BY country, core) y ON y.country = b.country AND y.core = b.core",
    "",
    REC,
)
def namesake_counts(v):
    d, q, p = framed(v)
    return features.namesakes(d, q, p).select("qi", "pj", "n_s1_core_q", "n_pool_core_c")


WEIGHTS = (
    "wt AS (SELECT country, t, CASE WHEN df >= 2 THEN ln(CAST(n + 1 AS DOUBLE) / (df + 1)) + 1 END AS idf, ln(n + 1.0) + 1 AS dflt FROM (SELECT country, t, count(*) AS df FROM (SELECT country, unnest({col}) AS t FROM rec) GROUP BY country, t) JOIN (SELECT country, count(*) AS n FROM rec GROUP BY country) USING (country)), "
    "wl AS (SELECT id, t, coalesce(idf, dflt) AS w FROM (SELECT id, country, unnest({col}) AS t FROM rec) JOIN wt USING (country, t)), "
    "wa AS (SELECT tp.qi, tp.pj, sum(wl.w) AS s, sum(wl.w * wl.w) AS s2 FROM txt_pairs tp JOIN wl ON wl.id = tp.qi GROUP BY tp.qi, tp.pj), wb AS (SELECT tp.qi, tp.pj, sum(wl.w) AS s, sum(wl.w * wl.w) AS s2 FROM txt_pairs tp JOIN wl ON wl.id = tp.pj GROUP BY tp.qi, tp.pj), "
    "wx AS (SELECT tp.qi, tp.pj, sum(x.w) AS s, sum(x.w * x.w) AS s2, sum(x.w * y.w) AS xy, max(x.w) AS m FROM txt_pairs tp JOIN wl x ON x.id = tp.qi JOIN wl y ON y.id = tp.pj AND y.t = x.t GROUP BY tp.qi, tp.pj)"
)
SAME = "same AS (SELECT tp.qi, tp.pj FROM txt_pairs tp JOIN rec a ON a.id = tp.qi JOIN rec b ON b.id = tp.pj WHERE a.country = b.country)"


def weighted(v, column, min_df):
    """Pairs of one country with the weights of both sides' tokens of a column as maps."""
    d, q, p = framed(v)
    both = q.select(F.col("qi").alias("id"), "country", column).unionByName(p.select(F.col("pj").alias("id"), "country", column))
    table = stats.idf(both, F.col(column), min_df)
    w = stats.weights_for(both, "id", F.col(column), table)
    n = both.groupBy("country").agg((F.log(F.count("*") + 1.0) + 1).alias("dflt"))
    d = d.filter("a.country = b.country").withColumn("country", F.col("a.country")).join(F.broadcast(n), "country")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    for side, key in (("a", "qi"), ("b", "pj")):
        d = d.join(w.select(F.col("id").alias(key), F.col("w").alias(f"w{side}")), key, "left").withColumn(f"w{side}", F.coalesce(f"w{side}", none))
    return features.merged(d, "wa", "wb", "wm"), sets.weight(F.col("wm"), F.col("dflt"))


@query("SELECT wa.qi, wa.pj, round(coalesce(wx.s, 0) / wa.s, 6) AS core_idf_q, round(coalesce(wx.s, 0) / wb.s, 6) AS core_idf_c FROM same JOIN wa USING (qi, pj) JOIN wb USING (qi, pj) LEFT JOIN wx USING (qi, pj)", "", f"{REC}, {SAME}, {WEIGHTS.format(col='ctok')}")
def idf_overlap(v):
    d, w = weighted(v, "ctok", 2)
    d = d.filter("size(a.ctok) > 0 and size(b.ctok) > 0")
    return shown(d, {"core_idf_q": sets.weighted_overlap(F.col("a.ctok"), F.col("b.ctok"), w), "core_idf_c": sets.weighted_overlap(F.col("b.ctok"), F.col("a.ctok"), w)})


@query("SELECT wa.qi, wa.pj, round(coalesce(wx.s2, 0) / sqrt(wa.s2 * wb.s2), 6) AS name_tri_idfcos, round(coalesce(wx.s2, 0) / least(wa.s2, wb.s2), 6) AS name_tri_idfcont FROM same JOIN wa USING (qi, pj) JOIN wb USING (qi, pj) LEFT JOIN wx USING (qi, pj)", "", f"{REC}, {SAME}, {WEIGHTS.format(col='ntri').replace('df >= 2', 'df >= 1')}")
def tri_idf_cosine(v):
    d, w = weighted(v, "ntri", 1)
    d = d.filter("size(a.ntri) > 0 and size(b.ntri) > 0")
    cos, cont = sets.weighted_cosine(F.col("a.ntri"), F.col("b.ntri"), w)
    return shown(d, {"name_tri_idfcos": cos, "name_tri_idfcont": cont})


@query("SELECT wa.qi, wa.pj, round(wa.s, 6) AS core_info_q, round(wb.s, 6) AS core_info_c, round(coalesce(wx.m, 0), 6) AS shared_max_idf FROM same JOIN wa USING (qi, pj) JOIN wb USING (qi, pj) LEFT JOIN wx USING (qi, pj)", "", f"{REC}, {SAME}, {WEIGHTS.format(col='ctok')}")
def name_specificity(v):
    d, w = weighted(v, "ctok", 2)
    d = d.filter("size(a.ctok) > 0 and size(b.ctok) > 0")
    return shown(d, {"core_info_q": sets.total(F.col("a.ctok"), w), "core_info_c": sets.total(F.col("b.ctok"), w), "shared_max_idf": sets.heaviest(F.array_intersect("a.ctok", "b.ctok"), w)})


@query("SELECT qi, pj, round(jaro_winkler_similarity(a.core, b.core), 6) AS name_jw FROM pairs", "", REC)
def jaro_winkler(v):
    d = framed(v)[0].select("qi", "pj", fuzzy.udf("jaro_winkler")(F.col("a.core"), F.col("b.core")).alias("name_jw"))
    return d.withColumn("name_jw", r6("name_jw"))


@query()
def fuzzy_ratios(v):
    f = features.fuzzy_features()
    d = features.add(framed(v)[0], {k: f[k] for k in ("name_tsr", "name_tsort", "name_partial", "name_ratio", "addr_tsr")})
    return d.select("qi", "pj", *[r6(c).alias(c) for c in ("name_tsr", "name_tsort", "name_partial", "name_ratio", "addr_tsr")])


@query()
def component_match(v):
    d = features.component_features(framed(v)[0])
    return d.select("qi", "pj", "comp_n_q", "comp_n_c", *[r6(c).alias(c) for c in ("comp_mean_best", "comp_frac85", "comp_min_best")])


@query("SELECT qi, pj, round(tj + aj, 6) AS sim FROM (SELECT qi, pj, " + f"{J('a.ntri', 'b.ntri')} AS tj, CASE WHEN a.naddr <> '' AND b.naddr <> '' THEN {J('a.atri', 'b.atri')} ELSE 0 END AS aj FROM pairs) ORDER BY tj + aj, qi, pj LIMIT 15", "", REC)
def hardest_pairs(v):
    f = features.name_features() | features.address_features()
    d = framed(v)[0].select("qi", "pj", (f["name_tri_j"] + F.coalesce(f["addr_tri_j"], F.lit(0.0))).alias("s"))
    return d.orderBy("s", "qi", "pj").limit(15).select("qi", "pj", r6("s").alias("sim"))


SIB = f"{REC}, tsc AS (SELECT qi, pj, CAST((pj * 37) % 1000 AS DOUBLE) / 1000 AS p FROM txt_pairs), tref AS (SELECT qi, pj, CASE WHEN r = 1 THEN coalesce(sec, -1) ELSE fst END AS ref FROM (SELECT qi, pj, row_number() OVER w AS r, first_value(pj) OVER w AS fst, nth_value(pj, 2) OVER (PARTITION BY qi ORDER BY p DESC, pj ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sec FROM tsc WINDOW w AS (PARTITION BY qi ORDER BY p DESC, pj)))"


@query(f"SELECT qi, pj, round({J('x.ntri', 'y.ntri', 'NULL')}, 6) AS s2_sib_name_j, CASE WHEN x.naddr <> '' AND y.naddr <> '' THEN round({J('x.atri', 'y.atri', 'NULL')}, 6) END AS s2_sib_addr_j, CASE WHEN len(x.nums) > 0 AND len(y.nums) > 0 THEN CASE WHEN len(list_intersect(x.nums, y.nums)) > 0 THEN 1.0 ELSE 0.0 END END AS s2_sib_num FROM tref JOIN rec x ON x.id = tref.pj JOIN rec y ON y.id = tref.ref", "", SIB)
def sibling_text_sim(v):
    d, _, p = framed(v)
    scored = d.select("qi", "pj").withColumn("p", ((F.col("pj") * 37) % 1000).cast("double") / 1000)
    out = group.sibling_text(group.sibling(scored), p).filter("ref >= 0")
    return out.select("qi", "pj", r6("s2_sib_name_j").alias("s2_sib_name_j"), r6("s2_sib_addr_j").alias("s2_sib_addr_j"), "s2_sib_num")


# Sparse vectors and keys

TF = (
    "tq AS (SELECT id, country, t, 1 + ln(count(*)) AS tf FROM (SELECT id, country, unnest(nw) AS t FROM rec) GROUP BY id, country, t), td AS (SELECT country, t, count(*) AS df FROM tq GROUP BY country, t HAVING count(*) >= 2), tn AS (SELECT country, count(*) AS n FROM rec GROUP BY country), "
    "tw AS (SELECT id, tq.country, t, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tq JOIN td USING (country, t) JOIN tn ON tn.country = tq.country), tu AS (SELECT id, country, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM tw), "
    "ts AS (SELECT a.id AS qi, b.id AS pj, round(sum(a.w * b.w), 9) AS cos FROM tu a JOIN tu b ON a.country = b.country AND a.t = b.t WHERE a.id % 5 = 0 AND b.id % 5 <> 0 GROUP BY a.id, b.id)"
)


def all_records(v):
    return features.records(v.txt_all.select(F.col("doc_id").alias("id"), "name", "addr", "country"))


def kept(rows):
    """Rows written once to the checkpoint folder, since a search reads them twice; on the executors if there is none."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def vectors(v):
    return blocking.tfidf(kept(all_records(v).select("id", "country", "nname")), "id", tx.words(F.col("nname")))


def search(rows, terms, k, min_df=2):
    """Rows whose id is divisible by 5 against the others."""
    return blocking.tfidf_topk(rows, "id", terms, k, F.col("id") % 5 == 0, min_df)


@query("SELECT qi, pj, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, pj) - 1 AS rank FROM ts) WHERE rank < 5", "", f"{ns.record_ctes()}, {TF}")
def tfidf_topk(v):
    return search(kept(all_records(v).select("id", "country", "nname")), tx.words(F.col("nname")), 5).select("qi", "pj", r6("cos").alias("cos"), "rank")


@query()
def char_tfidf_topk(v):
    rows = v.txt_all.select(F.col("doc_id").alias("id"), "country", tx.normalize(F.col("name"), 1).alias("t"))
    return search(rows, blocking.char_grams(F.col("t")), 5).select("qi", "pj", r6("cos").alias("cos"), "rank")


@query()
def hashed_tfidf_topk(v):
    rows = v.txt_all.select(F.col("doc_id").alias("id"), "country", tx.normalize(F.col("name"), 1).alias("t"))
    return search(rows, blocking.hashed_terms(blocking.char_grams(F.col("t"), (3,))), 5, 1).select("qi", "pj", r6("cos").alias("cos"), "rank")


@query()
def svd_topk(v):
    d = kept(blocking.dense_from_sparse(vectors(v), "id", 32))
    return blocking.knn(d.filter("id % 5 = 0").withColumnRenamed("id", "qi"), d.filter("id % 5 <> 0").withColumnRenamed("id", "pj"), 5, backend="blocks").select("qi", "pj", r6("cos").alias("cos"), "rank")


@query("SELECT qi, pj FROM (SELECT DISTINCT a.id AS qi, b.id AS pj FROM (SELECT id, country, unnest(ntok) AS t FROM rec WHERE id % 5 = 0) a JOIN (SELECT id, country, unnest(ntok) AS t FROM rec WHERE id % 5 <> 0) b USING (country, t) JOIN (SELECT country, t FROM (SELECT country, unnest(ntok) AS t FROM rec WHERE id % 5 <> 0) GROUP BY country, t HAVING count(*) <= 20) c USING (country, t))", "", ns.record_ctes())
def inverted_index_probe(v):
    q, p = features.records(v.txt_s1), features.records(v.txt_pool)
    return blocking.inverted_index(q, p, tx.words(F.col("nname")), 20)


NAME4 = f"SELECT id, country || '|' || n || '|' || substr({ns.skeleton('s')}, 1, 4) AS bk FROM (SELECT id, country, unnest(list_slice(list_transform(list_sort(list_transform(nums, lambda n: {{'l': -length(n), 'n': n}})), lambda x: x.n), 1, 3)) AS n, cw FROM rec WHERE len(nums) > 0), unnest(list_filter(cw, lambda t: length(t) >= 2)) u(s)"


@query("SELECT DISTINCT a.id AS qi, b.id AS pj FROM k4 a JOIN k4 b USING (bk) WHERE a.id % 5 = 0 AND b.id % 5 <> 0 AND bk IN (SELECT bk FROM (SELECT DISTINCT id, bk FROM k4 WHERE id % 5 <> 0) GROUP BY bk HAVING count(*) <= 200)", "", f"{ns.record_ctes()}, k4 AS ({NAME4})")
def key_num_name4(v):
    q, p = features.records(v.txt_s1), features.records(v.txt_pool)
    return blocking.key_join(blocking.block_keys(q, "qi", "num_x_name4"), blocking.block_keys(p, "pj", "num_x_name4"))


RARE = (
    f"sk AS (SELECT DISTINCT id, country, t FROM (SELECT id, country, unnest(list_transform(list_filter(cw, lambda c: length(c) >= 3), lambda c: {ns.skeleton('c')})) AS t FROM rec)), sd AS (SELECT country, t, count(*) AS df FROM sk GROUP BY country, t), "
    "k2 AS (SELECT id, country || '|' || t AS bk FROM (SELECT sk.id, sk.country, t, row_number() OVER (PARTITION BY sk.id ORDER BY df, t) AS r FROM sk JOIN sd USING (country, t)) WHERE r <= 2)"
)


@query("SELECT DISTINCT a.id AS qi, b.id AS pj FROM k2 a JOIN k2 b USING (bk) WHERE a.id % 5 = 0 AND b.id % 5 <> 0 AND bk IN (SELECT bk FROM k2 WHERE id % 5 <> 0 GROUP BY bk HAVING count(*) <= 200)", "", f"{ns.record_ctes()}, {RARE}")
def key_rarest_token(v):
    q, p = features.records(v.txt_s1), features.records(v.txt_pool)
    both = q.select("country", "nname").unionByName(p.select("country", "nname"))
    df = blocking.token_df(both, blocking.name_skeletons(F.col("nname")))
    return blocking.key_join(blocking.block_keys(q, "qi", "rarest_name_tok", df), blocking.block_keys(p, "pj", "rarest_name_tok", df))


NRA = (
    "ak AS (SELECT DISTINCT id, country, t FROM (SELECT id, country, unnest(list_filter(aw, lambda c: length(c) >= 3 AND NOT regexp_full_match(c, '[0-9]+'))) AS t FROM rec)), ad AS (SELECT country, t, count(*) AS df FROM ak GROUP BY country, t), "
    "ar AS (SELECT id, t FROM (SELECT ak.id, t, row_number() OVER (PARTITION BY ak.id ORDER BY df, t) AS r FROM ak JOIN ad USING (country, t)) WHERE r = 1), k3 AS (SELECT rec.id, rec.country || '|' || n || '|' || ar.t AS bk FROM rec JOIN ar USING (id), unnest(rec.nums) u(n))"
)


@query("SELECT DISTINCT a.id AS qi, b.id AS pj FROM k3 a JOIN k3 b USING (bk) WHERE a.id % 5 = 0 AND b.id % 5 <> 0 AND bk IN (SELECT bk FROM k3 WHERE id % 5 <> 0 GROUP BY bk HAVING count(*) <= 200)", "", f"{ns.record_ctes()}, {NRA}")
def key_num_rarest_addr(v):
    q, p = features.records(v.txt_s1), features.records(v.txt_pool)
    both = q.select("country", "naddr").unionByName(p.select("country", "naddr"))
    df = blocking.token_df(both, blocking.address_words(F.col("naddr")))
    return blocking.key_join(blocking.block_keys(q, "qi", "num_x_rarest_addr_tok", df), blocking.block_keys(p, "pj", "num_x_rarest_addr_tok", df))


#: The same vectors and scores over addresses: atq, atd, atn, atw, atu, ats.
ADDRESS_TF = re.sub(r"\bt([qdnwus])\b", r"at\1", TF.replace("unnest(nw)", "unnest(aw)"))
TOP5 = "SELECT qi, pj FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, pj) AS r FROM {scores}) WHERE r <= 5"


@query(f"{TOP5.format(scores='ts')} UNION {TOP5.format(scores='ats')}", "", f"{ns.record_ctes()}, {TF}, {ADDRESS_TF}")
def separate_index_union(v):
    """Name and address indexes searched apart, pairs united."""
    out, rows = None, kept(all_records(v).select("id", "country", "nname", "naddr"))
    for column in ("nname", "naddr"):
        top = search(rows, tx.words(F.col(column)), 5).select("qi", "pj")
        out = top if out is None else out.unionByName(top)
    return out.dropDuplicates(["qi", "pj"])


@query()
def normalization_experiment(v):
    """Recall of the nearest neighbour with an equal normal name, by level."""
    out = None
    for level in (0, 1, 4):
        rows = kept(v.txt_all.select(F.col("doc_id").alias("id"), "country", tx.normalize(F.col("name"), level, "name").alias("t")))
        top = search(rows, tx.words(F.col("t")), 10)
        x, y = rows.select(F.col("id").alias("qi"), F.col("t").alias("x")), rows.select(F.col("id").alias("pj"), F.col("t").alias("y"))
        labelled = top.join(x, "qi").join(y, "pj").select("qi", "pj", "rank", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("tp"))
        names = rows.groupBy("t").agg(F.sum((F.col("id") % 5 == 0).cast("long")).alias("q"), F.sum((F.col("id") % 5 != 0).cast("long")).alias("p")).filter("t is not null")
        true = names.agg(F.greatest(F.coalesce(F.sum(F.col("q") * F.col("p")), F.lit(0)), F.lit(1)).alias("n"))
        row = metrics.recall_at(labelled, true, [1, 5, 10]).select(F.lit(level).alias("level"), "topk", r6("recall").alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "SELECT topk, round(avg(ok), 6) AS agree, count(*) AS n FROM (SELECT topk, qi, avg(CASE WHEN len(list_intersect(q.n, p.n)) > 0 THEN 1.0 ELSE 0.0 END) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, pj) - 1 AS rank FROM ts) t "
    "JOIN digits q ON q.id = t.qi JOIN digits p ON p.id = t.pj JOIN (VALUES (1), (5)) g(topk) ON rank < topk WHERE len(q.n) > 0 GROUP BY topk, qi) GROUP BY topk",
    "",
    f"{ns.record_ctes()}, {TF}, digits AS (SELECT doc_id AS id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda t: CASE WHEN regexp_full_match(t, '0+') THEN '0' ELSE ltrim(t, '0') END)) AS n FROM documents)",
)
def pseudo_precision(v):
    top = search(kept(all_records(v).select("id", "country", "nname")), tx.words(F.col("nname")), 5)
    nums = v.documents.select(F.col("doc_id"), tx.numbers(F.col("text")).alias("n"))
    d = top.join(nums.select(F.col("doc_id").alias("qi"), F.col("n").alias("qn")), "qi").join(nums.select(F.col("doc_id").alias("pj"), F.col("n").alias("pn")), "pj")
    return diagnostics.pseudo_precision(d, [1, 5]).withColumn("agree", r6("agree"))


@query(
    "SELECT option, topk, round(count(lost.qi) / greatest((SELECT count(*) FROM lost), 1), 6) AS recovered, round(count(*) / 100, 6) AS cost FROM deep "
    "JOIN (VALUES ('forward', 10), ('forward', 20), ('reverse', 3), ('reverse', 5)) g(option, topk) USING (option) LEFT JOIN lost USING (qi, pj) "
    "WHERE rank < topk AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.qi = deep.qi AND c.pj = deep.pj) GROUP BY option, topk",
    VEC,
    f"{SCORED}, deep AS (SELECT 'forward' AS option, qi, pj, row_number() OVER (PARTITION BY qi ORDER BY cos DESC, pj) - 1 AS rank FROM sc UNION ALL SELECT 'reverse', qi, pj, row_number() OVER (PARTITION BY pj ORDER BY cos DESC, qi) - 1 FROM sc), "
    "cands AS (SELECT DISTINCT qi, pj FROM deep WHERE rank < CASE option WHEN 'forward' THEN 5 ELSE 1 END), "
    "lost AS (SELECT qi, pj FROM deep WHERE option = 'forward' AND rank < 20 AND pj % 3 = 0 EXCEPT SELECT qi, pj FROM cands)",
)
def recovery_options(v):
    scored = blocking.pair_scores(v.vec_q, v.vec_p)
    fwd, rev = blocking.ranked(scored, "qi", "pj", 20), blocking.ranked(scored, "pj", "qi", 5)
    cands = blocking.union_candidates(blocking.ranked(scored, "qi", "pj", 5), blocking.ranked(scored, "pj", "qi", 1))
    truth = fwd.filter("pj % 3 = 0").select("qi", "pj")
    d = diagnostics.recovery(truth, cands, fwd, rev, [10, 20], [3, 5], 100)
    return d.select("option", "topk", r6("recovered").alias("recovered"), r6("cost").alias("cost"))


ASSOC = (
    "an AS (SELECT id, unnest(ntok) AS native FROM rec), al AS (SELECT id, unnest(atok) AS latin FROM rec), "
    "ap AS (SELECT native, latin, CAST(c AS DOUBLE) / cn AS p, CAST(cl AS DOUBLE) / (SELECT count(*) FROM rec) AS base FROM (SELECT native, latin, count(*) AS c FROM an JOIN al USING (id) GROUP BY native, latin HAVING count(*) >= 3) "
    "JOIN (SELECT native, count(*) AS cn FROM an GROUP BY native) USING (native) JOIN (SELECT latin, count(*) AS cl FROM al GROUP BY latin) USING (latin))"
)


@query("SELECT native, latin, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY native ORDER BY score DESC, latin) AS r FROM (SELECT native, latin, p * (p / base) AS score FROM ap WHERE p >= 0.5 AND p > base)) WHERE r = 1", "", f"{ns.record_ctes()}, {ASSOC}")
def dictionary_association(v):
    """Tokens of a text's address that go with tokens of its name, on Latin text."""
    r = features.records(v.txt_all.select(F.col("doc_id").alias("id"), "name", "addr", "country"))
    d = stats.learn_association(r, F.col("ntok"), F.col("atok"), None, 3, 0.5)
    return d.select("native", "latin", r6("score").alias("score"))


@query(
    "SELECT native, latin, c FROM (SELECT native, latin, c, row_number() OVER (PARTITION BY native ORDER BY c DESC, latin) AS r FROM (SELECT native, latin, count(*) AS c, sum(count(*)) OVER (PARTITION BY native) AS n FROM (SELECT nw[1] AS native, nw[2] AS latin FROM rec WHERE len(nw) >= 2) GROUP BY native, latin) WHERE c >= 3 AND CAST(c AS DOUBLE) / n >= 0.1) WHERE r = 1",
    "",
    ns.record_ctes(),
)
def dictionary_share(v):
    w = tx.words(tx.normalize(F.col("name")))
    each = v.txt_all.select(w.alias("w")).filter("size(w) >= 2").select(F.get("w", F.lit(0)).alias("native"), F.get("w", F.lit(1)).alias("latin"))
    return stats.best_share(each, 3, 0.1)


@query()
def dictionary_coverage(v):
    """Native tokens of generated records that the dictionary learned from true pairs knows."""
    from ..sources import toy

    e = toy.entities(v._spark, v.customer.count())
    pool = toy.copies(e).filter("owned")
    s1 = toy.source1(e)
    pairs = pool.select("entity_id", F.concat(F.lit("S1-"), F.col("e")).alias("s"), F.col("business_name").alias("c_name"), F.col("business_address").alias("c_addr"))
    pairs = pairs.join(s1.select(F.col("entity_id").alias("s"), F.col("business_name").alias("q_name"), F.col("business_address").alias("q_addr")), "s").withColumnRenamed("entity_id", "id")
    learned = stats.dictionary(pairs)
    return stats.coverage(pool, learned, "business_name").withColumn("coverage", r6("coverage"))


VIEW_SQL = with_views("txt_all")

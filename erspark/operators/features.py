"""Similarity features of candidate pairs.

``records`` prepares a side once per record (tokens, trigrams, numbers), before the join
multiplies rows; ``pair_frame`` joins both sides to the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, sets
from ..functions import text as tx

COLUMNS = ["country", "nname", "naddr", "core", "ctok", "ntok", "atok", "skels", "ntri", "atri", "nums", "num1", "zips", "empty_addr", "indic"]

#: Feature names by group.
GROUPS = {
    "ctx": ["cos", "fwd_rank", "rev_rank", "gap_q", "rev_margin", "mutual", "n_cand_q", "is_s3"],
    "name": ["name_tri_j", "name_tok_j", "core_tok_j", "core_contain", "core_exact", "skel_j", "nospace_eq", "nospace_contain", "name_jw", "name_tsr", "name_tsort", "name_partial", "core_idf_q", "core_idf_c", "name_ntok_q", "name_ntok_c", "c_indic"],
    "addr": ["addr_tri_j", "addr_tok_j", "addr_contain", "addr_empty_c", "addr_ntok_q", "addr_ntok_c", "addr_idf_q", "addr_idf_c", "addr_tsr"],
    "num": ["num_n_q", "num_n_c", "num_j", "num_share", "num_contain_c", "num_conflict", "first_eq", "zip_eq"],
    "v2": ["name_tri_idfcos", "name_tri_idfcont", "addr_tri_idfcos", "addr_tri_idfcont", "core_info_q", "core_info_c", "shared_max_idf", "unshared_max_idf_q", "unshared_max_idf_c", "addr_unshared_max_idf_q", "addr_unshared_max_idf_c", "name_ratio", "name_jw_full"],
    "v3": ["n_s1_core_q", "n_pool_core_c", "n_s1_core_c", "n_pool_core_q", "core_c_eq_unique_s1", "num_min_edit", "num_contain", "num_min_reldiff", "first_edit"],
    "comp": ["comp_n_q", "comp_n_c", "comp_mean_best", "comp_frac85", "comp_min_best"],
}


def records(rows: DataFrame, level: int = 4) -> DataFrame:
    """Rows (key, name, addr, country) with all that pair features read."""
    r = rows.withColumn("nname", tx.normalize(F.col("name"), level, "name")).withColumn("naddr", tx.normalize(F.col("addr"), level, "addr", F.col("country").cast("string")))
    r = r.withColumn("ntok", F.array_distinct(tx.words(F.col("nname")))).withColumn("atok", F.array_distinct(tx.words(F.col("naddr")))).withColumn("ctok", F.array_distinct(tx.core(F.col("nname"))))
    return r.select(
        "*", tx.core_name(F.col("nname")).alias("core"),
        F.array_distinct(F.transform("ctok", tx.skeleton)).alias("skels"),
        sets.trigrams(F.col("nname")).alias("ntri"), sets.trigrams(F.col("naddr")).alias("atri"),
        tx.numbers(F.col("addr")).alias("nums"), tx.first_number(F.col("addr")).alias("num1"), tx.zips(F.col("addr")).alias("zips"),
        (F.col("naddr") == "").alias("empty_addr"), tx.has_indic(F.coalesce("name", F.lit(""))).alias("indic"),
    )


def pair_frame(pairs: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    """Pairs with both sides as structs a (query) and b (pool)."""
    left = q.select("qi", F.struct(*[c for c in q.columns if c != "qi"]).alias("a"))
    right = p.select("pj", F.struct(*[c for c in p.columns if c != "pj"]).alias("b"))
    return pairs.join(left, "qi").join(right, "pj")


def _num(c: Column) -> Column:
    return c.cast("int").cast("double")


def name_features() -> dict[str, Column]:
    a, b = F.col("a"), F.col("b")
    flat_a, flat_b = F.replace(a["nname"], F.lit(" "), F.lit("")), F.replace(b["nname"], F.lit(" "), F.lit(""))
    inside = F.contains(flat_a, flat_b) | F.contains(flat_b, flat_a)
    return {
        "name_tri_j": sets.jaccard(a["ntri"], b["ntri"]), "name_tok_j": sets.jaccard(a["ntok"], b["ntok"]),
        "core_tok_j": sets.jaccard(a["ctok"], b["ctok"]), "core_contain": sets.containment(a["ctok"], b["ctok"]),
        "core_exact": _num((a["core"] == b["core"]) & (a["core"] != "")), "skel_j": sets.jaccard(a["skels"], b["skels"]),
        "nospace_eq": _num((flat_a == flat_b) & (flat_a != "")), "nospace_contain": _num((F.least(F.length(flat_a), F.length(flat_b)) >= 4) & inside),
        "name_ntok_q": F.size(a["ntok"]).cast("double"), "name_ntok_c": F.size(b["ntok"]).cast("double"), "c_indic": _num(b["indic"]),
    }


def address_features() -> dict[str, Column]:
    a, b = F.col("a"), F.col("b")
    both = ~a["empty_addr"] & ~b["empty_addr"]
    return {
        "addr_tri_j": F.when(both, sets.jaccard(a["atri"], b["atri"])), "addr_tok_j": F.when(both, sets.jaccard(a["atok"], b["atok"])),
        "addr_contain": F.when(both, sets.containment(a["atok"], b["atok"])), "addr_empty_c": _num(b["empty_addr"]),
        "addr_ntok_q": F.size(a["atok"]).cast("double"), "addr_ntok_c": F.size(b["atok"]).cast("double"),
    }


def number_features() -> dict[str, Column]:
    a, b = F.col("a"), F.col("b")
    common = F.size(F.array_intersect(a["nums"], b["nums"]))
    both = (F.size(a["nums"]) > 0) & (F.size(b["nums"]) > 0)
    zips = (F.size(a["zips"]) > 0) & (F.size(b["zips"]) > 0)
    return {
        "num_n_q": F.size(a["nums"]).cast("double"), "num_n_c": F.size(b["nums"]).cast("double"),
        "num_j": F.when(both, sets.jaccard(a["nums"], b["nums"])), "num_share": F.when(both, _num(common > 0)),
        "num_contain_c": F.when(both, common / F.size(b["nums"])), "num_conflict": F.when(both, _num(common == 0)),
        "first_eq": F.when((a["num1"] != "") & (b["num1"] != ""), _num(a["num1"] == b["num1"])),
        "zip_eq": F.when(zips, _num(F.arrays_overlap(a["zips"], b["zips"]))),
    }


def fuzzy_number_features() -> dict[str, Column]:
    """Closest numbers by edits, by substring, by relative difference; edits of the first numbers."""
    a, b = F.col("a"), F.col("b")
    both = (F.size(a["nums"]) > 0) & (F.size(b["nums"]) > 0)
    grid = F.flatten(F.transform(a["nums"], lambda x: F.transform(b["nums"], lambda y: F.struct(x.alias("x"), y.alias("y")))))
    digits = lambda s: F.translate(s, "०१२३४५६७८९", "0123456789").cast("double")
    part = lambda g: (g["x"] != g["y"]) & (F.least(F.length(g["x"]), F.length(g["y"])) >= 2) & (F.contains(g["x"], g["y"]) | F.contains(g["y"], g["x"]))
    gaps = F.transform(F.filter(grid, lambda g: F.greatest(F.length(g["x"]), F.length(g["y"])) <= 9), lambda g: F.abs(digits(g["x"]) - digits(g["y"])) / F.greatest(digits(g["x"]), digits(g["y"]), F.lit(1.0)))
    return {
        "num_min_edit": F.when(both, F.array_min(F.transform(grid, lambda g: F.levenshtein(g["x"], g["y"]))).cast("double")),
        "num_contain": F.when(both, _num(F.exists(grid, part))),
        "num_min_reldiff": F.when(both, F.least(F.lit(9.0), F.coalesce(F.array_min(gaps), F.lit(9.0)))),
        "first_edit": F.when((a["num1"] != "") & (b["num1"] != ""), F.levenshtein(a["num1"], b["num1"]).cast("double")),
    }


def merged(pairs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Adds the weights of both sides' tokens as one map: a column of its own, worked out once per pair."""
    a, b = F.col(left), F.col(right)
    return pairs.withColumn(out, F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))))


def weighted_features() -> dict[str, Column]:
    """Needs columns wn and wa (``merged`` weights of name and address tokens) and their defaults dn and da."""
    a, b = F.col("a"), F.col("b")
    name, addr = sets.weight(F.col("wn"), F.col("dn")), sets.weight(F.col("wa"), F.col("da"))
    both = ~a["empty_addr"] & ~b["empty_addr"]
    plain = lambda t: F.filter(t, lambda x: ~x.rlike(r"^\d+$"))
    rest = lambda x, y: F.array_except(x, y)
    return {
        "core_idf_q": sets.weighted_overlap(a["ctok"], b["ctok"], name), "core_idf_c": sets.weighted_overlap(b["ctok"], a["ctok"], name),
        "addr_idf_q": F.when(both, sets.weighted_overlap(a["atok"], b["atok"], addr)), "addr_idf_c": F.when(both, sets.weighted_overlap(b["atok"], a["atok"], addr)),
        "core_info_q": sets.total(a["ctok"], name), "core_info_c": sets.total(b["ctok"], name),
        "shared_max_idf": sets.heaviest(F.array_intersect(a["ctok"], b["ctok"]), name),
        "unshared_max_idf_q": sets.heaviest(rest(a["ctok"], b["ctok"]), name), "unshared_max_idf_c": sets.heaviest(rest(b["ctok"], a["ctok"]), name),
        "addr_unshared_max_idf_q": F.when(both, sets.heaviest(plain(rest(a["atok"], b["atok"])), addr)),
        "addr_unshared_max_idf_c": F.when(both, sets.heaviest(plain(rest(b["atok"], a["atok"])), addr)),
    }


def fuzzy_features() -> dict[str, Column]:
    a, b = F.col("a"), F.col("b")
    both = ~a["empty_addr"] & ~b["empty_addr"]
    return {
        "name_jw": fuzzy.udf("jaro_winkler")(a["core"], b["core"]), "name_jw_full": fuzzy.udf("jaro_winkler")(a["nname"], b["nname"]),
        "name_tsr": fuzzy.udf("token_set")(a["nname"], b["nname"]), "name_tsort": fuzzy.udf("token_sort")(a["nname"], b["nname"]),
        "name_partial": fuzzy.udf("partial")(a["core"], b["core"]), "name_ratio": fuzzy.udf("indel")(a["nname"], b["nname"]),
        "addr_tsr": F.when(both, fuzzy.udf("token_set")(a["naddr"], b["naddr"])),
    }


def component_features(pairs: DataFrame) -> DataFrame:
    """Adds the component features of raw addresses; null where a side has none."""
    comp = lambda s: tx.components(F.col(f"{s}.addr"), 4, F.col(f"{s}.country").cast("string"))
    d = pairs.withColumn("ca", comp("a")).withColumn("cb", comp("b")).withColumn("m", fuzzy.component_udf()("ca", "cb"))
    return d.select("*", F.size("ca").cast("double").alias("comp_n_q"), F.size("cb").cast("double").alias("comp_n_c"), F.col("m.mean_best").alias("comp_mean_best"), F.col("m.frac85").alias("comp_frac85"), F.col("m.min_best").alias("comp_min_best")).drop("ca", "cb", "m")


def namesakes(pairs: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    """Adds how many records of each side share the core names: counts by (country, core), 0 if none.

    q: the visible queries only.
    """
    s1 = q.filter("core <> ''").groupBy("country", "core").agg(F.count("*").alias("n"))
    pool = p.filter("core <> ''").groupBy("country", "core").agg(F.count("*").alias("n"))

    def look(df, table, side, out):
        t = table.select(F.col("country").alias("_c"), F.col("core").alias("_k"), F.col("n").alias(out))
        joined = df.join(t, (F.col(f"{side}.country") == F.col("_c")) & (F.col(f"{side}.core") == F.col("_k")), "left").drop("_c", "_k")
        return joined.withColumn(out, F.coalesce(out, F.lit(0)))

    d = look(look(look(look(pairs, s1, "a", "n_s1_core_q"), pool, "b", "n_pool_core_c"), s1, "b", "n_s1_core_c"), pool, "a", "n_pool_core_q")
    same = (F.col("a.core") == F.col("b.core")) & (F.col("a.core") != "")
    return d.withColumn("core_c_eq_unique_s1", _num(same & (F.col("n_s1_core_q") == 1)))


def add(df: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """Adds feature columns; NaN-free: undefined is null."""
    return df.withColumns({k: v for g in groups for k, v in g.items()})

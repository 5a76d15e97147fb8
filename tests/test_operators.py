"""Operators on small fixtures: properties, sources, decisions, search, streaming."""

from collections import Counter

import __spark_entry__ as entry
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from erspark.functions import sets, text
from erspark.operators import blocking, decide, diagnostics, features, metrics, sampling, stats
from erspark.plans.views import Views
from erspark.sources import tables, toy
from erspark.streaming.incremental import match_stream

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 8), st.integers(0, 1000)), max_size=30)


def scored(spark, rows):
    best = {}
    for q, p, s in rows:
        best[q, p] = max(best.get((q, p), 0), s)
    return spark.createDataFrame([(q, p, s / 1000, p % 6 == q) for (q, p), s in best.items()], "qi long, pj long, p double, tp boolean")


def python_f05(kept, truth):
    out = {}
    for q, k in truth.items():
        n, tp = sum(a == q for a, _ in kept), sum(a == q and b % 6 == q for a, b in kept)
        out[q] = 1.0 if k == n == 0 else 0.0 if 0 in (k, n) else 1.25 * tp / (0.25 * k + n)
    return out


@QUIET
@given(PAIRS)
def test_one_to_one_and_f05(spark, rows):
    d = scored(spark, rows)
    one = [(r.qi, r.pj, r.p) for r in decide.one_to_one(d).collect()]
    assert len({p for _, p, _ in one}) == len(one)
    best = {}
    for r in d.collect():
        if r.pj not in best or (-r.p, r.qi) < best[r.pj]:
            best[r.pj] = (-r.p, r.qi)
    assert sorted((q, p) for q, p, _ in one) == sorted((q, p) for p, (_, q) in best.items())
    truth = {q: [2, 2, 2, 1, 1, 0][q] for q in range(6)}
    t = spark.createDataFrame([(q, 0, q % 5, k) for q, k in truth.items()], "qi long, country int, fold int, k long")
    got = {r.qi: r.f05 for r in metrics.per_entity(decide.one_to_one(d), t).collect()}
    want = python_f05([(q, p) for q, p, _ in one], truth)
    assert all(abs(got[q] - want[q]) < 1e-9 for q in truth)


@QUIET
@given(PAIRS)
def test_grid_equals_one_by_one(spark, rows):
    d = scored(spark, rows)
    t = spark.createDataFrame([(q, 0, 0, [2, 2, 2, 1, 1, 0][q]) for q in range(6)], "qi long, country int, fold int, k long")
    grid = [(0.1,), (0.5,), (0.9,)]
    got = {r.x0: r.f05 for r in decide.grid_scores(d, t, "threshold", grid).collect()}
    for (x,) in grid:
        kept = decide.threshold(decide.one_to_one(d), x)
        assert got[x] == pytest.approx(metrics.per_entity(kept, t).agg(F.avg("f05")).first()[0])


@QUIET
@given(st.sets(st.sampled_from("abcdefg")), st.sets(st.sampled_from("abcdefg")))
def test_sets(spark, a, b):
    d = spark.createDataFrame([(sorted(a), sorted(b))], "a array<string>, b array<string>")
    r = d.select(sets.jaccard(F.col("a"), F.col("b")).alias("j"), sets.jaccard(F.col("b"), F.col("a")).alias("k"), sets.containment(F.col("a"), F.col("b")).alias("c"), sets.jaccard(F.col("a"), F.col("b"), None).alias("n")).first()
    assert r.j == r.k == pytest.approx(len(a & b) / len(a | b) if a | b else 0)
    assert r.c == pytest.approx(len(a & b) / min(len(a), len(b)) if a and b else 0)
    assert (r.n is None) == (not a | b)


def test_search_backends_agree(spark, data):
    v = Views(spark, data)
    exact = {(r.qi, r.pj, r["rank"]) for r in blocking.knn(v.vec_q, v.vec_p, 5).collect()}
    assert {(r.qi, r.pj, r["rank"]) for r in blocking.knn(v.vec_q, v.vec_p, 5, backend="blocks").collect()} == exact
    every = blocking.ivf(v.vec_q, v.vec_p, 5, probes=50, list_size=8)
    assert {(r.qi, r.pj, r["rank"]) for r in every.collect()} == exact
    some = {(r.qi, r.pj) for r in blocking.ivf(v.vec_q, v.vec_p, 5, probes=2, list_size=8).collect()}
    assert len(some & {(q, p) for q, p, _ in exact}) / len(exact) > 0.5
    near = {(r.qi, r.pj) for r in blocking.lsh(v.vec_q, v.vec_p, 5, 64).collect()}
    assert len(near & {(q, p) for q, p, _ in exact}) / len(exact) > 0.3


def test_approximate_recall(spark):
    """Unclustered vectors and 40 lists, where few probes are not enough."""
    rng = np.random.default_rng(5)
    e = rng.standard_normal((440, 64))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    rows = [(i, "x", x) for i, x in enumerate(e.tolist())]
    q = spark.createDataFrame(rows[:120], "qi long, country string, e array<double>")
    p = spark.createDataFrame(rows[120:], "pj long, country string, e array<double>")
    exact = {(r.qi, r.pj) for r in blocking.knn(q, p, 10).collect()}
    for found in (blocking.ivf(q, p, 10, probes=2, list_size=8, recall=0.95), blocking.lsh(q, p, 10, 64)):
        assert len({(r.qi, r.pj) for r in found.collect()} & exact) >= 0.9 * len(exact)


def test_block_holds_both_sides(spark, data):
    v = Views(spark, data)
    both = {(r.qi, r.pj): (r.fwd_rank, r.rev_rank) for r in blocking.block(v.vec_q, v.vec_p).collect()}
    fwd = {(r.qi, r.pj) for r in blocking.knn(v.vec_q, v.vec_p, 10).collect()}
    rev = {(r.qi, r.pj) for r in blocking.knn(v.vec_q, v.vec_p, 3, "pj").collect()}
    assert set(both) == fwd | rev
    assert all((both[x][0] is not None) == (x in fwd) and (both[x][1] is not None) == (x in rev) for x in both)


def test_partitions_do_not_matter(spark, data):
    v = Views(spark, data)
    a = {tuple(r) for r in decide.apply(v.er_scored, "expected_f", (0.05,)).collect()}
    b = {tuple(r) for r in decide.apply(v.er_scored.repartition(7), "expected_f", (0.05,)).collect()}
    assert a == b


def test_fixture_has_singletons(spark, data):
    v = Views(spark, data)
    assert v.er_truth.filter("k = 0").count() > 0


def test_random_negatives(spark, data):
    v = Views(spark, data)
    pool = v.er_pool.join(v.er_s1.select(F.col("qi").alias("seed"), "country"), "seed").select("pj", "country")
    truth = v.er_pool.filter("owner >= 0").select(F.col("owner").alias("qi"), "pj")
    neg = sampling.random_negatives(truth, v.er_s1, pool)
    assert neg.count() > 0
    assert neg.join(truth, ["qi", "pj"]).count() == 0
    assert neg.join(v.er_s1, "qi").join(pool.withColumnRenamed("country", "pc"), "pj").filter("country <> pc").count() == 0


def test_tsv_round_trip_and_lists(spark, tmp_path):
    made = toy.tables(spark, 40, 3)
    at = f"{tmp_path}/s1"
    tables.write_tsv(made["source1"], at)
    back = tables.read_tsv(spark, at, tables.RECORD)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made["source1"].collect()))
    audit = tables.audit_tsv(spark, f"{at}/*.csv", tables.RECORD).first()
    assert audit.n_rows == 40
    s1, pool = tables.build_split(made["source1"], made["source2"], made["source3"], made["truth"])
    assert s1.count() == 40 and {"prio", "fold", "k"} <= set(s1.columns)
    owned = pool.filter("owner <> ''").count()
    assert owned == s1.agg(F.sum("k")).first()[0] == tables.explode_truth(made["truth"]).count()
    same = toy.tables(spark, 40, 3)["source2"].repartition(5)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, made["source2"].collect()))


def test_stage_and_resume(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert tables.save_stage(df, f"{tmp_path}/s").count() == 100
    assert tables.save_stage(df.limit(5), f"{tmp_path}/s").count() == 5
    assert tables.resumable(df, f"{tmp_path}/r", "k", 3).count() == 100
    assert tables.resumable(df, f"{tmp_path}/r", "k", 3).count() == 100


def test_results_log(spark, tmp_path):
    at = f"{tmp_path}/log"
    tables.log_results(spark, at, [{"exp": "a", "time": 1, "x": 1.0}, {"exp": "a", "time": 2, "y": float("nan")}])
    tables.log_results(spark, at, [{"exp": "b", "time": 3, "x": 0.5}])
    rows = {r.exp: r for r in tables.latest(tables.read_results(spark, at), ["exp"], "time").collect()}
    assert rows["a"].time == 2 and rows["b"].x == 0.5
    assert tables.markdown(spark.createDataFrame([("a", 0.5)], "n string, v double")).splitlines()[-1] == "| a | 0.5000 |"


def test_dictionary(spark):
    rows = [(i, "lotus foods", "लोटस फूड्स", "main road tamil nadu", "main road தமிழ்நாடு") for i in range(4)] + [(9, "tiger foods", "टाइगर फूड्स", "x", "y")]
    pairs = spark.createDataFrame(rows, "id long, q_name string, c_name string, q_addr string, c_addr string")
    got = {(r.field, r.native): r.latin for r in stats.dictionary(pairs).collect()}
    assert got["name", "लोटस"] == "lotus" and got["name", "फूड्स"] == "foods"


def test_number_features(spark):
    side = "struct<nums:array<string>,num1:string>"
    d = spark.createDataFrame([(1, 1, (["6420"], "6420"), (["642"], "642")), (2, 2, (["104"], "104"), (["4"], "4")), (3, 3, ([], ""), (["4"], "4"))], f"qi long, pj long, a {side}, b {side}")
    r = {x.qi: x for x in features.add(d, features.fuzzy_number_features()).collect()}
    assert (r[1].num_min_edit, r[1].num_contain) == (1, 1)
    assert (r[2].num_min_edit, r[2].num_contain) == (2, 0) and r[2].num_min_reldiff == pytest.approx(0.961538, abs=1e-6)
    assert r[3].num_min_edit is None and r[3].first_edit is None


def test_expected_f_example(spark):
    d = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.2, False)], "qi long, pj long, p double, tp boolean")
    assert [r.pj for r in decide.apply(d, "expected_f", (0.0,)).collect()] == [1]


@pytest.mark.parametrize(("k", "n", "tp", "want"), [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (2, 0, 0, 0.0), (4, 4, 3, 0.75)])
def test_f05_examples(spark, k, n, tp, want):
    assert spark.range(1).select(metrics.f05(F.lit(k), F.lit(n), F.lit(tp)).alias("x")).first()["x"] == want


def test_cheap_threshold(spark):
    d = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.3, True), (2, 3, 0.5, False)], "qi long, pj long, p double, tp boolean")
    assert diagnostics.cheap_threshold(d, [0.1, 0.2, 0.4, 0.8]).first()["t"] == 0.2


def test_kmeans_lists():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = blocking.kmeans_lists(v, 5)
    assert c.shape == (5, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)


def test_stream_matches_each_query_once(spark, tmp_path, data):
    v = Views(spark, data)
    v.vec_q.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v.vec_q.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = match_stream(stream, lambda b: blocking.knn(b, v.vec_p, 1), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {r.qi for r in got.collect()} == {r.qi for r in blocking.knn(v.vec_q, v.vec_p, 1).collect()}


def python_grams(text, sizes):
    out = []
    for word in text.split():
        w = f" {word} "
        for s in sizes:
            out += [w[i : i + s] for i in range(len(w) - s + 1)] or ([w] if s == min(sizes) else [])
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2, 3, 4), (3,), (4, 5), (1, 2)])
def test_char_grams(spark, sizes):
    texts = ["to", "a", "", "ab cde fghij", "x y  z", "\u00e9t\u00e9 \U0001f600b c\U0001f600\U0001f600d"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", blocking.char_grams(F.col("t"), sizes).alias("g"))
    assert all(sorted(r.g) == python_grams(r.t, sizes) for r in d.collect())


def python_tfidf_topk(rows, k, min_df):
    from collections import Counter
    from math import log, sqrt

    terms = {i: Counter(t.split()) for i, c, t in rows}
    country = {i: c for i, c, _ in rows}
    n, df = Counter(country.values()), Counter((country[i], t) for i in terms for t in terms[i])
    vectors = {}
    for i, c in terms.items():
        w = {t: (1 + log(x)) * (log((1 + n[country[i]]) / (1 + df[country[i], t])) + 1) for t, x in c.items() if df[country[i], t] >= min_df}
        norm = sqrt(sum(x * x for x in w.values()))
        vectors[i] = {t: x / norm for t, x in w.items()}
    out = []
    for q in (i for i in terms if i % 5 == 0):
        found = [(-round(sum(x * vectors[p].get(t, 0.0) for t, x in vectors[q].items()), 9), p) for p in terms if p % 5 and country[p] == country[q]]
        out += [(q, p, r, -s) for r, (s, p) in enumerate(sorted(x for x in found if x[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize("entries", [2_000_000, 40])
def test_tfidf_topk_equals_brute_force(spark, monkeypatch, entries):
    """Equal texts, words that all rows have, rows without known words; in one block and in many."""
    monkeypatch.setattr(blocking, "ENTRIES", entries)
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 7 == 0), " ".join(["the"] * (i % 2) + [f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 9))) if x < 300])) for i in range(150)]
    rows += [(i, 0, "the same old words") for i in range(150, 190)]
    d = spark.createDataFrame(rows, "id long, country int, t string")
    got = blocking.tfidf_topk(d, "id", blocking.tx.words(F.col("t")), 4, F.col("id") % 5 == 0)
    want = python_tfidf_topk(rows, 4, 2)
    found = sorted((r.qi, r.pj, r["rank"], r.cos) for r in got.collect())
    assert [x[:3] for x in found] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(found, want, strict=True))
    t = blocking.tfidf(d, "id", blocking.tx.words(F.col("t")))
    both = blocking.sparse_topk(t.filter("id % 5 = 0").withColumnRenamed("id", "qi"), t.filter("id % 5 <> 0").withColumnRenamed("id", "pj"), 4)
    assert sorted((r.qi, r.pj, r["rank"]) for r in both.collect()) == [x[:3] for x in want]


def test_dense_blocks_of_one_table_equal_native(spark, monkeypatch):
    """Both sides from one table, slices of few rows, equal vectors; LSH and IVF that leave nothing are exact."""
    monkeypatch.setattr(blocking, "SCORE_BYTES", 8 * 64 * 3)
    rng = np.random.default_rng(1)
    e = rng.standard_normal((200, 8)).round(1)
    e[50:90] = e[0]
    d = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(e)], "id long, country int, e array<float>")
    q, p = d.filter("id % 5 = 0").withColumnRenamed("id", "qi"), d.filter("id % 5 <> 0").withColumnRenamed("id", "pj")
    rows = lambda df: sorted((r.qi, r.pj, r["rank"]) for r in df.collect())
    rounded = blocking.pair_scores(q, p).withColumn("cos", F.round("cos", 9))
    want = rows(blocking.ranked(rounded, "qi", "pj", 4))
    assert rows(blocking.knn(q, p, 4, backend="blocks")) == want
    assert rows(blocking.knn(q, p, 4, "pj", backend="blocks")) == rows(blocking.ranked(rounded, "pj", "qi", 4))
    assert rows(blocking.lsh(q, p, 4, 8, tables=4, bits=0)) == want
    assert rows(blocking.ivf(q, p, 4, probes=8, list_size=8)) == want


@pytest.mark.parametrize("fit_rows", [200_000, 900])
def test_dense_vectors_are_fitted_on_all_rows(spark, monkeypatch, fit_rows):
    """Inner products of the dense vectors of 21,000 rows, by one task for each core and by more, against the decomposition of the whole matrix."""
    monkeypatch.setattr(blocking, "FIT_ROWS", fit_rows)
    rng, n = np.random.default_rng(5), 21_000
    x = np.where(rng.random((n, 12)) < 0.3, rng.random((n, 12)) * np.arange(1, 13), 0).round(3)
    x[:, 0] += 0.5
    row, term = np.nonzero(x)
    cells = blocking.pd.DataFrame({"id": row, "country": row % 3, "term": [f"t{t}" for t in term], "w": x[row, term]})
    d = spark.createDataFrame(cells, "id long, country int, term string, w double").repartition(40)
    bucket = {r.term: r.b for r in d.select("term", F.pmod(F.xxhash64("term"), F.lit(2048)).alias("b")).distinct().collect()}
    assert len(set(bucket.values())) == 12
    basis = np.linalg.svd(x, full_matrices=False)[2][:4].T
    want = x @ basis / np.linalg.norm(x @ basis, axis=1, keepdims=True)
    got = sorted((r.id, r.e) for r in blocking.dense_from_sparse(d, "id", 4).collect())
    assert [i for i, _ in got] == list(range(n))
    e = np.array([v for _, v in got])
    assert np.abs(e @ e[:200].T - want @ want[:200].T).max() < 1e-5
    assert blocking.dense_from_sparse(d.limit(0), "id", 4).count() == 0


def test_lsh_asks_every_hundredth_row_against_all(spark, data):
    """Each query has the best rows of its label, a query's own row and other queries among them."""
    v = Views(spark, data)
    rows = [(r.vec_id, r.label, np.asarray(r.embedding, np.float64)) for r in v.embeddings.collect()]
    want = set()
    for i, label, e in rows:
        if i % 100 == 0:
            near = sorted((-round(float(e @ x), 9), j) for j, other, x in rows if other == label)[:10]
            want |= {(i, j) for _, j in near}
    got = {(r.qi, r.pj) for r in entry.queries()["lsh_topk"](spark, data).collect()}
    asked = {i for i, _, _ in rows if i % 100 == 0}
    assert {i for i, _ in got} == asked and asked <= {i for i, j in got if i == j}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_association_in_rounds_equals_brute_force(spark, monkeypatch, ids):
    """Many rounds and groups; repeated and null ids, null and empty lists, equal scores."""
    monkeypatch.setattr(stats, "ROUND", 1)
    monkeypatch.setattr(stats, "BUCKET", 50)
    rng = np.random.default_rng(3)
    draw = lambda n, most: [f"w{x}" for x in rng.zipf(1.3, rng.integers(0, n)) if x < most]
    rows = [(i if ids == "unique" else None if i % 31 == 0 else i - i % 40 // 37, draw(6, 40), draw(40, 300)) for i in range(400)]
    rows[7], rows[8] = (7, None, ["w1"]), (8, ["w1"], None)
    a = [(i, t) for i, n, _ in rows for t in set(n or ())]
    b = [(i, t) for i, _, l in rows for t in set(l or ())]
    cn, cl, c = Counter(t for _, t in a), Counter(t for _, t in b), Counter()
    of = {}
    for i, t in b:
        of.setdefault(i, []).append(t)
    for i, t in a:
        c.update((t, u) for u in of.get(i, ()) if i is not None)
    best = {}
    for (t, u), x in sorted(c.items()):
        p, base = x / cn[t], cl[u] / len(rows)
        if t != "w5" and x >= 3 and p >= 0.5 and p > base:
            best[t] = min(best.get(t, (0, "")), (-(p * (p / base)), u))
    got = stats.learn_association(spark.createDataFrame(rows, "id long, n array<string>, l array<string>"), F.col("n"), F.col("l"), spark.createDataFrame([("w5",)], "native string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, u, -x) for t, (x, u) in best.items()) and len(best) > 5


def test_words_end_where_the_negated_class_says(spark):
    odd = ["aé b_ÿ0", "\u0900\u0d7fक\u08ff\u0d80z", "😀a\U0010ffffb", "  x ", "\x7f\x80a|{}`/:;09"]
    d = spark.createDataFrame([(x,) for x in odd], "s string").select(F.split("s", text.BETWEEN).alias("a"), F.split("s", f"[^0-9a-z{text.INDIC}]+").alias("b"))
    assert all(r.a == r.b for r in d.collect())

"""The whole resolution: normalise, block, score in two steps, stack, decide.

``fit`` learns the models and the rule on labelled records; ``transform`` gives matches
and candidates. Stages are lazy; ``stage`` may write one (a folder per name) and read it
again, which cuts the plan and lets a later run go on from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking, decide, diagnostics, features, group, metrics, models
from ..sources import tables

CHEAP = ["cos", "gap_q", "rev_margin", "mutual", "n_cand_q", "is_s3", "name_tri_j", "name_tok_j", "core_tok_j", "core_exact", "skel_j", "nospace_eq", "addr_tri_j", "addr_contain", "num_j", "num_conflict"]
FULL = CHEAP + ["core_contain", "nospace_contain", "addr_tok_j", "addr_empty_c", "num_share", "num_contain_c", "first_eq", "zip_eq", "num_min_edit", "num_min_reldiff", "first_edit", "name_jw", "name_tsr", "name_ratio", "addr_tsr", "n_s1_core_q", "n_pool_core_c"]
STAGE2 = ["p", "s2_rank_q", "s2_prel", "s2_psum_q", "s2_nhi_q", "s2_nhi_same_src", "s2_nclaim_pj", "s2_rank_pj", "s2_pmax_other_pj", "s2_sib_name_j", "s2_sib_addr_j", "s2_sib_num"]


@dataclass
class Resolver:
    """queries: qi, name, addr, country (with truth: fold, k). pool: pj, name, addr, country, src (with truth: owner)."""

    k_fwd: int = 10
    m_rev: int = 3
    grams: int = 3
    floors: list[float] = field(default_factory=lambda: [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05])
    rules: list[str] = field(default_factory=lambda: ["threshold", "top1_plus"])
    rounds: int = 20
    folder: str | None = None

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        if self.folder is None:
            return df
        at = f"{self.folder}/{name}"
        return df.sparkSession.read.parquet(at) if tables.exists(df.sparkSession, f"{at}/_SUCCESS") else tables.save_stage(df, at)

    def candidates(self, q: DataFrame, p: DataFrame) -> DataFrame:
        """Candidates with context features from sparse character grams of name and address."""
        text = F.concat_ws(" ", "nname", "naddr")
        both = q.select(F.col("qi").alias("id"), F.lit(0).alias("side"), "country", text.alias("t")).unionByName(p.select(F.col("pj").alias("id"), F.lit(1).alias("side"), "country", text.alias("t")))
        both = both.withColumn("key", F.concat_ws(":", "side", "id"))
        vectors = stats_vectors(both, self.grams)
        vq = vectors.filter("side = 0").select(F.col("id").alias("qi"), "country", "term", "w")
        vp = vectors.filter("side = 1").select(F.col("id").alias("pj"), "country", "term", "w")
        fwd, rev = blocking.sparse_topk(vq, vp, self.k_fwd), blocking.sparse_topk(vq, vp, self.m_rev, "pj")
        cands = blocking.union_candidates(fwd, rev)
        return blocking.context(cands, fwd.select("qi", "pj", "cos").unionByName(rev.select("qi", "pj", "cos")), p)

    def cheap(self, cands: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
        d = features.pair_frame(cands, q, p)
        return features.add(d, features.name_features(), features.address_features(), features.number_features())

    def full(self, survivors: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
        d = features.namesakes(survivors, q, p)
        return features.add(d, features.fuzzy_number_features(), features.fuzzy_features())

    def second(self, scored: DataFrame, p: DataFrame) -> DataFrame:
        d = group.stage_two(scored.select("qi", "pj", "p", "cos").join(p.select("pj", "src"), "pj"))
        return group.sibling_text(d, p)

    def fit(self, queries: DataFrame, pool: DataFrame) -> Resolver:
        q, p = self.stage(features.records(queries), "fit-q"), self.stage(features.records(pool), "fit-p")
        truth = queries.select("qi", "country", "fold", "k")
        owners = pool.select("pj", "owner")
        cands = self.stage(self.candidates(q, p), "fit-cands")
        pairs = self.cheap(cands, q, p).join(owners, "pj").join(queries.select("qi", "fold"), "qi").withColumn("label", (F.col("owner") == F.col("qi")).cast("int"))
        pairs = self.stage(pairs, "fit-pairs")
        self.cheap_model = models.fit(pairs, CHEAP, rounds=self.rounds)
        first = self.cheap_model.score(pairs, "pc").withColumn("tp", F.col("label") == 1)
        best = diagnostics.cheap_threshold(first.filter("fold < 3").withColumnRenamed("pc", "p"), self.floors).first()
        self.floor = best["t"] if best else 0.0
        left = self.stage(self.full(first.filter(F.col("pc") >= self.floor), q, p), "fit-full")
        self.full_model = models.fit(left, FULL, rounds=self.rounds)
        stacked = self.stage(models.out_of_fold(left, FULL, rounds=self.rounds), "fit-oof")
        more = self.second(stacked, p).join(stacked.select("qi", "pj", "label", "fold"), ["qi", "pj"])
        more = self.stage(more, "fit-second")
        self.second_model = models.fit(more, STAGE2, rounds=self.rounds)
        final = self.stage(models.out_of_fold(more, STAGE2, out="p2", rounds=self.rounds), "fit-final")
        scored = final.select("qi", "pj", F.col("p2").alias("p"), (F.col("label") == 1).alias("tp"), "fold")
        found = []
        for rule in self.rules:
            row = decide.best(decide.grid_scores(scored.filter("fold < 3").drop("fold"), truth.filter("fold < 3"), rule)).first()
            found.append((row["f05"], rule, tuple(row[c] for c in row.asDict() if c.startswith("x"))))
        _, self.rule, self.params = max(found, key=lambda x: x[0])
        kept = decide.apply(scored, self.rule, self.params).join(scored.select("qi", "pj", "tp"), ["qi", "pj"])
        self.report = metrics.report(metrics.per_entity(kept, truth).filter("fold >= 3"))
        return self

    def transform(self, queries: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(matches, candidates): one row per query with comma lists by falling score."""
        q, p = features.records(queries), features.records(pool)
        pairs = self.cheap(self.candidates(q, p), q, p)
        left = self.stage(self.cheap_model.score(pairs, "pc").filter(F.col("pc") >= self.floor), "left")
        scored = self.stage(self.full_model.score(self.full(left, q, p)), "scored")
        final = self.second_model.score(self.second(scored, p), "p2").select("qi", "pj", F.col("p2").alias("p"))
        kept = decide.apply(final, self.rule, self.params)
        return tables.with_lists(queries, kept, "qi", "pj", "p", "list"), tables.with_lists(queries, scored, "qi", "pj", "cos", "list")


def stats_vectors(both: DataFrame, size: int) -> DataFrame:
    """(side, id, country, term, w) with statistics over queries and pool together."""
    made = blocking.tfidf(both, "key", blocking.char_grams(F.col("t"), (size,)))
    parts = F.split("key", ":")
    return made.select(parts[0].cast("int").alias("side"), parts[1].cast("long").alias("id"), "country", "term", "w")

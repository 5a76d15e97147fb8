"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of documents. Stages are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm import decontaminate, language, lines, packing, simhash
from erspark.llm.store import Workspace
from erspark.llm.tokens import vocabulary_path

#: Near copies: shingles of five words, a similarity of 0.8, on 256-bit fingerprints.
NEAR = {"shingle": 5, "words": 4, "similarity": 0.8}


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that none of their names can meet a stage's own, with id, text and a key of both."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected ones go.

    Null and empty texts, and texts without a letter, are rejected; null labels are not
    learned; rows that repeat an id or a text are judged one by one.
    """
    found = language.predict(_rows(docs), language.fit(docs.select("text", "lang")))
    return found.filter("not rejected").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a text that is all copies goes.

    The order is that of ids, null ids last; null and empty texts stay; rows with equal id
    and text keep the same lines. n_chars follows the text where lines went.
    """
    kept = lines.dedup_lines(_rows(docs).drop("_key")).filter("n_lines = 0 or n_removed < n_lines")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("kept")}
    return kept.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last.

    Rows are told apart by a 64-bit key of id and text: of rows that repeat both, one
    stays; rows that share an id but not the text are members of their own. Null and empty
    texts are one group.
    """
    rows = _rows(docs)
    groups = simhash.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), **NEAR).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct()
    ids = rows.select("_key", "doc_id").distinct().join(groups.hint("merge"), "_key")
    stay = ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first")).select(F.col("first._key").alias("_key"))
    return rows.select("_row", "_key").join(stay.hint("merge"), "_key").dropDuplicates(["_key"]).select("_row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have no words and stay; an empty benchmark hits nothing; rows that
    repeat id and text go or stay together.
    """
    rows = _rows(docs)
    found = decontaminate.decontaminate(rows.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(hit, "_key", "left_anti").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024; null and empty texts have the end id alone, rows that repeat are packed each."""
    return packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), 2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: No SQL: k-means, fingerprints with random bands and BPE have none; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs

"""Tab-separated record files, match lists, result logs and Parquet stages.

All paths go through Spark or the Hadoop file system, so any store works.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file with a header: all strings, trimmed, empty instead of null; no quoting.

    With a schema the scan is lazy; without, the header line is read for the names.
    """
    if schema is None:
        head = spark.read.text(path).first()
        schema = ", ".join(f"`{c.strip()}` string" for c in head[0].split("\t")) if head else "value string"
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("enforceSchema", True).schema(schema).csv(path)
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in raw.columns])


def audit_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row: non-blank lines but the header, rows read, and whether they agree."""
    lines = spark.read.text(path).filter(F.trim("value") != "").agg((F.count("*") - 1).alias("n_lines"))
    rows = read_tsv(spark, path, schema).agg(F.count("*").alias("n_rows"))
    return lines.join(F.broadcast(rows)).withColumn("ok", F.col("n_lines") == F.col("n_rows"))


def records(raw: DataFrame, source: str | None = None) -> DataFrame:
    out = raw.select("entity_id", F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")
    return out.withColumn("src", F.lit(source)) if source else out


def explode_truth(truth: DataFrame) -> DataFrame:
    """(s1, id) of every listed match; empty lists have none."""
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1"), F.explode(ids).alias("id"))


def build_split(source1: DataFrame, source2: DataFrame, source3: DataFrame, truth: DataFrame | None = None, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(entities, pool) of raw tables. With truth: prio, fold and k, and each pool row's owner ('' if none).

    k counts every listed id, whether or not the pool has it.
    """
    from ..functions.text import fold_of
    from ..operators.sampling import priority

    s1 = records(source1)
    pool = records(source2, "S2").unionByName(records(source3, "S3"))
    if truth is None:
        return s1, pool
    pairs = explode_truth(truth)
    k = pairs.groupBy("s1").agg(F.count("*").cast("int").alias("k"))
    s1 = s1.join(k, s1.entity_id == k.s1, "left").drop("s1").withColumn("k", F.coalesce("k", F.lit(0)))
    s1 = s1.withColumn("prio", priority(F.col("entity_id"))).withColumn("fold", fold_of(F.col("entity_id"), folds))
    owner = pairs.groupBy("id").agg(F.min("s1").alias("owner"))
    pool = pool.join(owner, pool.entity_id == owner.id, "left").drop("id").withColumn("owner", F.coalesce("owner", F.lit("")))
    return s1, pool


def with_lists(entities: DataFrame, pairs: DataFrame, key: str, item: str, score: str, out: str) -> DataFrame:
    """One row per entity: its items comma-joined by falling score, then item; '' if none.

    An entity has a few candidates, so each list is short.
    """
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))), lambda x: x["i"].cast("string")), ",")
    lists = pairs.groupBy(key).agg(ordered.alias(out))
    return entities.select(key).join(lists, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of part files with headers."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def read_lists(lists: DataFrame, key: str, column: str) -> DataFrame:
    """(key, item) of comma lists; empty ones have none."""
    return lists.filter(F.col(column) != "").select(key, F.explode(F.split(column, ",")).alias("item"))


def candidate_file(cands: DataFrame, score: str = "cos") -> DataFrame:
    """Candidates (with tp) with their label and the best score of each side."""
    top = lambda key: F.max(score).over(Window.partitionBy(key))
    return cands.withColumn("label", F.col("tp").cast("int")).withColumn("q_top1", top("qi")).withColumn("p_top1", top("pj"))


def write_candidates(cands: DataFrame, path: str, meta: dict, score: str = "cos") -> DataFrame:
    """The candidate file as Parquet, with its settings as JSON beside it."""
    write_text(cands.sparkSession, f"{path}-meta", json.dumps(meta))
    return save_stage(candidate_file(cands, score), path)


def check_submission(entities: DataFrame, pool: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of violations: entities missing or repeated, unknown ids, ids claimed twice, matches outside the candidates.

    matches and candidates: (qi, list) as ``with_lists`` makes them; ids are pool keys.
    """
    m, c = read_lists(matches, "qi", "list"), read_lists(candidates, "qi", "list")
    known = pool.select(F.col("pj").cast("string").alias("item"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(entities.join(matches, "qi", "left_anti"), "missing"),
        one(matches.groupBy("qi").count().filter("count > 1"), "repeated"),
        one(m.join(known, "item", "left_anti"), "unknown"),
        one(m.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1"), "claimed_twice"),
        one(m.join(c, ["qi", "item"], "left_anti"), "outside"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names; on a local master a temporary one."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="erspark-")
    return f"{shared.rstrip('/')}/erspark-{uuid.uuid4().hex[:12]}"


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """Writes beside the target, then swaps it in: readers see the old table or the new one."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".tmp")
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".tmp"), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not move {path}.tmp to {path}")
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def resumable(df: DataFrame, path: str, key: str, chunks: int = 8) -> DataFrame:
    """Writes a table in chunks by a hash of the key; a later call goes on where one stopped."""
    spark = df.sparkSession
    for i in range(chunks):
        at = f"{path}/chunk={i}"
        if not exists(spark, f"{at}/_SUCCESS"):
            df.filter(F.pmod(F.xxhash64(key), F.lit(chunks)) == i).write.mode("overwrite").parquet(at)
    return spark.read.parquet(path).drop("chunk")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def log_results(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Appends result rows of any columns as JSON lines; NaN becomes null."""
    clean = [json.dumps({k: (None if isinstance(v, float) and v != v else v) for k, v in r.items()}) for r in rows]
    spark.createDataFrame([(x,) for x in clean], "value string").coalesce(1).write.mode("append").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with the union of their columns."""
    return spark.read.json(path)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small result (a report) as a table in text."""
    rows = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *rows])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

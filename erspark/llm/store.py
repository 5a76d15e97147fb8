"""Shared storage, deterministic range buckets and worker set-up for the operators.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``. Lineage is cut by writing Parquet there, so a lost
executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import gc
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once; the operators work in slices of about this size.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when only the driver's path has it, and keep their batches small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one is made up only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="erspark-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Workspace:
    """Named Parquet tables in a folder of their own, removed when Python ends.

    ``drop`` frees a table early once no later step reads it.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/erspark-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        schema = df.schema
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # lets Spark remove shuffle files that no plan needs any more
        return self.load(name, schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def close(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # noqa: BLE001  the JVM may have gone first at interpreter exit
            pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a constant of the plan."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1, numPartitions=1).select(F.inline(made))


def apart(df: DataFrame) -> DataFrame:
    """A small aggregate dealt anew before a join with the rows it sums up.

    Left as it is, it is joined in the partitions of its own keys, where the skew join
    cannot split a hot one.
    """
    return df.repartition(partitions(df.sparkSession))


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending cut points of an integer column, from one aggregate.

    They are constants in every later plan, so each use deals rows out alike; the list
    is bounded by ``n`` (the shuffle partitions), not by the rows.
    """
    if n <= 1:
        return []
    at = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(column, at, 10000).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_bucket(column, bounds: list[int]):
    """0 for values up to the first bound, and so on; null goes to bucket -1."""
    c = F.col(column) if isinstance(column, str) else column
    if not bounds:
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.lit(0))
    cuts = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) <= 4 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
    return F.when(c.isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda b: b < c.cast("bigint"))))

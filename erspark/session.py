"""Session settings that the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that matter for results or plans; a cluster's own sizes stay as they are.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "erspark", local: str | None = None, **conf: str) -> SparkSession:
    """A session; ``local`` gives a local master with as many shuffle partitions as cores."""
    builder = SparkSession.builder.appName(name)
    settings = dict(CONF)
    if local:
        cores = str(os.cpu_count() or 4) if local == "*" else local
        builder = builder.master(f"local[{local}]")
        settings |= {"spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

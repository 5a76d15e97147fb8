"""Matching of arriving queries against a fixed pool, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def match_stream(queries: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends ``match(batch)`` to a Parquet folder, a subfolder per batch.

    A batch that runs again after a failure overwrites its own folder, so every query is
    answered once.
    """

    def run(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

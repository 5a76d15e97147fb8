"""The registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", ctes: str = ""):
    """Registers a function of ``Views``; views and ctes go before its SQL."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            parts = [p for p in (with_views(*views.split()) if views else "", ctes) if p]
            ORACLES[fn.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return fn

    return add

"""Runs a query in Spark and its SQL in DuckDB, and tells how the results differ."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "__float__") and not isinstance(x, (str, int)):
        return round(float(x), 5)
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool) else (False, "", x) for x in t))


def difference(spark_df, con, sql: str) -> str:
    """'' if both results are equal as bags of rows."""
    got = rows(spark_df.columns, spark_df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(rel.columns)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
        return f"{len(got)} and {len(want)} rows; first differences {bad}"
    return ""

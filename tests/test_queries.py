"""Every registered query with SQL gives what DuckDB gives; the others run."""

import __spark_entry__ as entry
import harness
import pytest

SLOW = {"resolver_end_to_end", "feature_ladder", "leave_one_out", "oof_stack"}
OWN = [n for n in entry.queries() if n in entry.registry.QUERIES]


@pytest.fixture(scope="module")
def con(data):
    return harness.duck(data)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.registry.ORACLES])
def test_equals_sql(spark, data, con, name):
    assert harness.difference(entry.queries()[name](spark, data), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.registry.ORACLES and n not in SLOW])
def test_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    row = entry.entry(spark).first()
    assert 0 <= row["f05"] <= 1 and row["n_s1"] > 0

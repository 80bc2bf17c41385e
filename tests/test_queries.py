"""Every registered query with SQL equals its SQL on the smallest tables; every other one runs with a stable schema."""

import pytest
from oracles import SF, connection, rows_of, rows_of_sql

import timberline.plans.cohort_queries
import timberline.plans.data_queries
import timberline.plans.late_queries
import timberline.plans.model_queries
import timberline.plans.record_queries
import timberline.plans.replicate_queries  # noqa: F401
from timberline.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    columns, want = rows_of_sql(con, SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert rows_of(df, columns) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark).collect()
    assert len(out) == 6 and all(abs(r["survival"] + r["cif1"] + r["cif2"] + r["cif3"] - 1) < 1e-5 for r in out)
    assert set(e.oracle_sql()) <= set(e.queries())

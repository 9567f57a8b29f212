"""Every registered query with SQL gives the rows of that SQL; the others hold against loops in test_operators."""

import os

import duckdb
import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    return c


def rows(df):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    assert rows(got) == rows(want)


def test_no_python_in_native_plans(spark):
    plan = catalog.QUERIES["density_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

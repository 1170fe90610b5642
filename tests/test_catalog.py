"""Every query with a SQL twin gives the same rows, names and types as DuckDB."""

import os

import duckdb
import pytest

from gridloom import catalog

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or v != v else (v + 0.0 if isinstance(v, float) else v)
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_as_duckdb(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    want = db.sql(catalog.oracles()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    types = {c: "TIMESTAMP" if str(t).startswith("TIMESTAMP") else str(t) for c, t in zip(want.columns, want.types, strict=True)}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_runs_the_same_twice(spark, sf, name):
    f = catalog.queries()[name]
    first = f(spark, sf)
    assert rows(first.columns, first.collect()) == rows(first.columns, f(spark, sf).collect())


def test_no_query_scans_what_it_does_not_need(spark, sf):
    plan = catalog.queries()["flt1_depth_range"](spark, sf)._jdf.queryExecution().toString()
    assert "l_discount" in plan and "ReadSchema" in plan and "l_shipdate" not in plan.split("Physical Plan")[-1]
    assert "PushedFilters" in plan

"""Each query against its SQL in DuckDB, on the smallest tables; none may be vacuous."""

import math
import os

import duckdb
import pytest

from sparkevid.plans import registry

from .conftest import SMALL


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got or name == "benchmark_passages"
    if name in registry.ORACLE:
        want = db.sql(registry.ORACLE[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)

"""Every registered query against the SQL that states it, on the smallest tables; the rest against their schemas."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from brookloom.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    want = duck.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x, names: sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in x), key=repr)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0

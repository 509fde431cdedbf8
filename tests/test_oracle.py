"""Every registered core query against its SQL on the smallest tables."""

import os

import pytest

from weft.plans import registered

QUERIES, ORACLE = registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(norm(x) for x in value)
    return value


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

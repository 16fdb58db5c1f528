"""Each query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparsemill import oracle
from sparsemill import queries as engine

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = con.sql(oracle.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, x if not isinstance(x, float) else round(x, 4), str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    order = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(oracle.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

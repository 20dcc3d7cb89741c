"""Every registered sensor query that has SQL, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from kinetrace.plans import queries as own

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple("~" if v is None else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    got = own.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(map(key, got.select(*columns).collect()))
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    assert rows == sorted(map(key, rel.select(*[f'"{c}"' for c in columns]).fetchall()))

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def level(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = Counter(tuple(map(level, r)) for r in df.select(*columns).collect())
    other = Counter(tuple(map(level, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
CORE = __import__("quarry.plans.registry", fromlist=["x"])
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(CORE.queries()))
def test_query_against_sql(spark, duck, name):
    df = CORE.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = CORE.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "doc_id", "score", "chunk_id", "start", "end"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

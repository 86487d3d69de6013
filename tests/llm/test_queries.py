import os

import duckdb
import pytest

from quarry.llm.oracles import oracle_sql
from quarry.llm.queries import queries

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {"p1_found": ["doc_id", "term"], "p2_found": ["term", "mark"], "p3_found": ["chunk_id"], "p4_found": ["doc_id_a", "doc_id_b"], "p5_found": ["qid", "doc_id"], "p6_found": ["doc_id_a", "doc_id_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["source"], "p9_found": ["doc_id_a", "doc_id_b"]}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=repr)
    if sql := oracle_sql().get(name):
        rel = duck.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_splitter_keeps_its_contract(spark):
    assert queries()["p3_audit"](spark, DATA).count() == 0


def test_nothing_else_imports_the_subpackage():
    import pathlib

    import quarry

    root = pathlib.Path(quarry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quarry.llm" not in p.read_text(), p

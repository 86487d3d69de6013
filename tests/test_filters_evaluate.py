import math

import pytest

from quarry.operators import evaluate as ev
from quarry.operators.filters import FilterError, compile_filter

METAS = ['{"ano": 2024, "tipo": "lei", "uf": "SP", "tags": "a%b,c_d"}', '{"ano": 2019, "tipo": "Decreto", "x": {"y": "z"}}', '{"ano": "2024", "ok": true}', '{"ano": null}', "{}", None, '{"ano": 20', "[1]"]


@pytest.mark.parametrize(
    "where, rows",
    [
        (None, range(8)), ({}, range(8)), ({"ano": 2024}, [0]), ({"ano": "2024"}, [2]), ({"ano": {"$ne": 2024}}, range(1, 8)),
        ({"ano": {"$gt": 2019}}, [0]), ({"ano": {"$gte": 2019, "$lt": 2024}}, [1]), ({"tipo": {"$in": ["lei", "x"]}}, [0]), ({"tipo": {"$in": []}}, []),
        ({"tipo": {"$nin": ["lei"]}}, range(1, 8)), ({"tipo": {"$nin": []}}, range(8)), ({"ano": {"$exists": True}}, [0, 1, 2]), ({"ano": {"$exists": False}}, range(3, 8)),
        ({"tags": {"$contains": "%b"}}, [0]), ({"tags": {"$contains": "c_d"}}, [0]), ({"tags": {"$contains": "cXd"}}, []), ({"tipo": {"$startswith": "dec"}}, []), ({"tipo": {"$endswith": "to"}}, [1]),
        ({"x.y": "z"}, [1]), ({"ok": True}, [2]), ({"ok": 1}, []), ({"ano": None}, []), ({"$and": []}, range(8)), ({"$or": []}, []),
        ({"$or": [{"tipo": "lei"}, {"x.y": "z"}]}, [0, 1]), ({"$and": [{"uf": "SP"}, {"ano": {"$gt": 1}}]}, [0]), ({"ano": {"$contains": 2}}, [2]),
    ],
)
def test_filters(spark, where, rows):
    df = spark.createDataFrame(list(enumerate(METAS)), "i int, meta string")
    assert [r.i for r in df.where(compile_filter(where)).orderBy("i").collect()] == list(rows)


@pytest.mark.parametrize("where", [{"a b": 1}, {"a": {"$regex": "x"}}, {"$nor": []}, {"a'); drop": 1}, {"a": {"$gt": None}}, {"a": {"$eq": [1]}}])
def test_bad_filters(where):
    with pytest.raises(FilterError):
        compile_filter(where)


QRELS = [("q1", "a", 2), ("q1", "b", 1), ("q1", "c", 0), ("q2", "x", 0), ("q3", "n", 1)]
RANKS = [("q1", "z", 1), ("q1", "b", 2), ("q1", "a", 3), ("q2", "x", 1), ("q9", "a", 1)]


@pytest.fixture(scope="module")
def judged(spark):
    return spark.createDataFrame(RANKS, "qid string, doc_id string, rank int"), spark.createDataFrame(QRELS, "qid string, doc_id string, rel int")


def values(df):
    return {r.qid: r.value for r in df.collect()}


def test_measures_by_hand(judged):
    r, q = judged
    ideal = 2 / math.log2(2) + 1 / math.log2(3)
    assert values(ev.ndcg(r, q, 10)) == pytest.approx({"q1": (1 / math.log2(3) + 2 / math.log2(4)) / ideal, "q2": 0, "q3": 0})
    assert values(ev.recall(r, q, 2)) == pytest.approx({"q1": 0.5, "q2": 0, "q3": 0})
    assert values(ev.mrr(r, q, 10)) == pytest.approx({"q1": 0.5, "q2": 0, "q3": 0})
    assert values(ev.mrr(r, q, 1)) == pytest.approx({"q1": 0, "q2": 0, "q3": 0})
    assert values(ev.average_precision(r, q, 1000)) == pytest.approx({"q1": (1 / 2 + 2 / 3) / 2, "q2": 0, "q3": 0})


def test_summary(judged):
    r, q = judged
    got = {x.metric: (x.queries, x.value) for x in ev.evaluate(r, q, (10,)).collect()}
    assert got["mrr_at_10"] == (3, pytest.approx(0.5 / 3))
    assert ev.evaluate(r, q.where("false")).count() == 0
    assert {x.metric for x in ev.evaluate_reranking(r, q).collect()} == {"map_at_1000", "ndcg_at_10", "mrr_at_10"}


def test_qrels_latency_leaderboard(spark):
    dirty = spark.createDataFrame([("q", "d", 1), ("q", "d", 3), (None, "d", 1), ("q", "e", None)], "qid string, doc_id string, rel int")
    assert [tuple(r) for r in ev.clean_qrels(dirty).collect()] == [("q", "d", 3)]
    times = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "mode string, ms double")
    assert [tuple(r) for r in ev.latency_percentiles(times, "mode", "ms").collect()] == [("a", 10, 5.5, pytest.approx(9.55))]
    ours = spark.createDataFrame([("t", "m1", 0.5), ("t", "m2", 0.5), ("u", "m1", 1.0)], "task string, mode string, score double")
    others = spark.createDataFrame([("t", x, s) for x, s in (("a", 0.1), ("b", 0.5), ("c", 0.7), ("d", 0.9))], "task string, model string, score double")
    assert [tuple(r) for r in ev.leaderboard(ours, others).collect()] == [("t", 0.5, "m1", 0.9, 0.7, 4, 25.0)]

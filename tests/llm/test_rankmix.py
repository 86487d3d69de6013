import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quarry.llm import rankmix as rm

HITS = "qid string, source string, chunk_id string, doc_id string, score double, start int, end int, run_ts timestamp_ntz, rank int, n int, place int"


def hits(spark, items):
    import datetime

    return spark.createDataFrame([(q, s, c, d, x, 0, 1, None if day is None else datetime.datetime(2024, 1, day), 1, 2, 3) for q, s, c, d, x, day in items], HITS)


ITEMS = [
    ("q", "big", "a#0", "a", 1e6, 1), ("q", "big", "b#0", "b", 9e5, 1), ("q", "big", "c#0", "c", 1.0, 1), ("q", "big", "c#1", "c", 2.0, 1),
    ("q", "small", "b#0", "b", 0.9, 1), ("q", "small", "a#0", "a", 0.5, 1), ("q", "small", "d#0", "d", 0.5, 1), ("q", "small", "c#0", "c", 0.9, 1), ("q", "small", "c#0", "c", float("nan"), 2),
    ("q", "small", "a#0", "a", 0.5, 1), ("q", "empty", "a#0", "a", None, 1), ("q", "empty", "b#0", "b", float("nan"), 1),
    ("r", "big", "x#0", "x", 5.0, None), ("r", "big", "x#0", "x", 1.0, 3), (None, "big", "x", "x", 1.0, 1), ("r", None, "x", "x", 1.0, 1), ("r", "big", "y", None, 1.0, 1), ("r", "big", None, "z", 0.5, 1),
]


def test_normal_quantile(spark):
    ps = [1e-300, 1e-12, 1e-5, 0.02, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", rm.normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12)


def test_list_scores(spark, rows):
    assert rows(rm.list_scores(hits(spark, ITEMS))) == sorted(
        [("q", "big", "a", 1e6), ("q", "big", "b", 9e5), ("q", "big", "c", 2.0), ("q", "small", "b", 0.9), ("q", "small", "a", 0.5), ("q", "small", "d", 0.5), ("r", "big", "x", 1.0), ("r", "big", "z", 0.5)], key=repr
    )


def expected(lists, weights=None):
    """{doc: value} of one query by the definition."""
    z = NormalDist().inv_cdf
    docs = {d for x in lists.values() for d in x}
    total = sum((weights or {}).get(s, 1.0) for s in lists)
    out = {}
    for d in docs:
        v = 0.0
        for s, x in lists.items():
            n = len(x)
            p = 0.5 / (n + 1) if d not in x else (sum(y < x[d] for y in x.values()) + (sum(y == x[d] for y in x.values()) + 1) / 2) / (n + 1)
            v += (weights or {}).get(s, 1.0) * z(p)
        out[d] = v / total
    return out


@pytest.mark.parametrize("weights", [None, {"big": 3.0}])
def test_order(spark, weights):
    df = hits(spark, ITEMS)
    want = expected({"big": {"a": 1e6, "b": 9e5, "c": 2.0}, "small": {"b": 0.9, "a": 0.5, "d": 0.5}}, weights)
    got = {r.doc_id: r for r in rm.fused_order(df, weights).where("qid = 'q'").collect()}
    assert {d: r.fused for d, r in got.items()} == pytest.approx(want, abs=1e-8)
    assert sorted(got, key=lambda d: got[d]["rank"]) == sorted(want, key=lambda d: (-round(want[d], 9), d))


@pytest.mark.parametrize("long_list", [100, 10**6])
def test_places_over_many_ranges(spark, long_list):
    items = [("q", "s", f"c{i}", f"d{i:04}", float(i % 40), 1) for i in range(900)] + [("p", "s", "c", "d", 1.0, 1)]
    got = rm.ranked_lists(rm.list_scores(hits(spark, items)).repartition(6), long_list).collect()
    assert len(got) == 901
    order = sorted(range(900), key=lambda i: (-(i % 40), f"d{i:04}"))
    place = {f"d{i:04}": k for k, i in enumerate(order, 1)}
    for r in got:
        if r.qid == "q":
            assert r.place == place[r.doc_id] and r.n == 900
            assert r.equal == sum(1 for i in range(900) if i % 40 == r.score) and r.below == sum(1 for i in range(900) if i % 40 < r.score)


def test_head(spark, rows):
    df = hits(spark, ITEMS)
    assert rows(rm.head_of_all_lists(df)) == [("q", "a"), ("q", "b"), ("r", "x"), ("r", "z")]
    assert rows(rm.head_of_all_lists(df, best=2)) == [("q", "a"), ("q", "b"), ("r", "x"), ("r", "z")]
    assert rows(rm.head_of_all_lists(df, best=1)) == [("r", "x")]
    assert rows(rm.head_of_all_lists(df.where("false"))) == []


def test_head_with_ties_and_short_lists(spark, rows):
    """The candidates of the one order hold every document that is at the head of all lists."""
    import random

    rng = random.Random(1)
    items = [(f"q{q}", s, f"c{d}", f"d{d:02}", float(rng.randrange(4)), 1) for q in range(6) for s in ("a", "b") for d in rng.sample(range(30), 3 + 4 * q)]
    want = []
    for q in {i[0] for i in items}:
        heads = []
        for s in ("a", "b"):
            own = sorted((-i[4], i[3]) for i in items if i[:2] == (q, s))
            heads.append({d for _, d in own[:5]})
        want += [(q, d) for d in heads[0] & heads[1]]
    assert rows(rm.head_of_all_lists(hits(spark, items), best=5)) == sorted(want)


def test_scale_does_not_prevail(spark):
    items = [("q", "a", f"c{i}", f"d{i}", float(i), 1) for i in range(9)] + [("q", "b", f"c{i}", f"d{i}", -1e9 * i, 1) for i in range(9)]
    assert all(math.isclose(r.fused, 0, abs_tol=1e-9) for r in rm.fused_ranking(hits(spark, items)).collect())

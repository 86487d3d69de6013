import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, dense, fusion, lexical, search
from quarry.plans import registry


def corpus(spark, texts):
    docs = spark.createDataFrame([(f"d{i}", i, t, "{}") for i, t in enumerate(texts)], "doc_id string, doc_ord bigint, text string, meta string")
    return docs, chunking.chunk(docs, "window", 2500)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(11)
    return [" ".join(f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 26))) for _ in range(120)]


def bm25(texts, query, k1=0.8, b=0.8):
    docs = [re.findall(r"\w+", t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        tf, s = Counter(d), 0.0
        for t in set(re.findall(r"\w+", query)):
            df = sum(t in x for x in docs)
            if tf[t]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg))
        if s:
            out[i] = s
    return out


def test_bm25_against_definition(spark, random_texts):
    _, chunks = corpus(spark, random_texts)
    queries = spark.createDataFrame([("q1", "t1 t2 t3 t3 zz"), ("q2", "T7"), ("q3", "nothing"), ("q4", None)], "qid string, text string")
    got = {(r.qid, r.slot // chunking.SLOTS): r.score for r in lexical.bm25_scores(chunks, queries).collect()}
    want = {(q, i): s for q, t in (("q1", "t1 t2 t3"), ("q2", "t7")) for i, s in bm25(random_texts, t).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scores_need_no_shuffle_by_query(spark, random_texts, monkeypatch):
    """Postings are dealt by chunk once; scores leave their task in batches, over several blocks of queries too."""
    _, chunks = corpus(spark, random_texts)
    asked = {f"q{i}": f"t{i} t{i + 3} t{2 * i}" for i in range(9)}
    queries = spark.createDataFrame(list(asked.items()), "qid string, text string")
    plan = lexical.bm25_scores(chunks, queries)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and "hashpartitioning(slot" in plan
    want = {(q, i): s for q, t in asked.items() for i, s in bm25(random_texts, t).items()}
    for name, value in (("TERM_ROWS", 8), ("OUT_ROWS", 7), ("FULL_ROWS", 2)):
        monkeypatch.setattr(lexical, name, value)
    rows = lexical.bm25_scores(chunks, queries).collect()
    got = {(r.qid, r.slot // chunking.SLOTS): r.score for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = {(r.qid, r["rank"]): r.slot // chunking.SLOTS for r in lexical.bm25_topk(chunks, queries, 2).collect()}
    for q in asked:
        assert [best[q, 1], best[q, 2]] == sorted((i for x, i in want if x == q), key=lambda i: (-round(want[q, i], 6), i))[:2]


def test_a_task_holds_numbers_of_its_postings():
    """A posting takes a place and a weight; its document is held once for a slot."""
    rows = [(slot, f"d{slot}", t, slot + t / 10) for slot in (7, 3, 5) for t in (2, 0, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["slot", "doc_id", "t", "w"])
    held = lexical._Held(iter([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)]), 6)
    assert held.slots.tolist() == [3, 5, 7] and held.docs.to_pylist() == ["d3", "d5", "d7"]
    assert held.at.nbytes + held.weight.nbytes == 12 * len(rows)
    hit, value = held.scores(np.array([0, 1, 4]), np.array([1.0, 1.0, 2.0]))
    assert hit.tolist() == [0, 1, 2] and value == pytest.approx([9.8, 15.8, 21.8])
    assert [x.tolist() for x in held.best(np.array([2]), np.array([1.0]), 1)] == [[2], [7.2]]


def test_a_task_holds_one_part_at_a_time(spark, random_texts, monkeypatch):
    """Parts have no more tokens than HELD_TOKENS; a task takes several and keeps k rows of a query over all of them."""
    _, chunks = corpus(spark, random_texts)
    asked = {f"q{i}": f"t{i} t{i + 3} t{2 * i}" for i in range(9)}
    queries = spark.createDataFrame(list(asked.items()), "qid string, text string")
    monkeypatch.setattr(lexical, "HELD_TOKENS", 60)
    cores = spark.sparkContext.defaultParallelism
    tokens = sum(len(t.split()) for t in random_texts)
    best = lexical.bm25_topk(chunks, queries, 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(slot#\d+L?, {tokens // 60 + 1}\)", plan) and f"Coalesce {cores}" in plan
    got = {(r.qid, r["rank"]): r.slot // chunking.SLOTS for r in best.collect()}
    for q, t in asked.items():
        want = bm25(random_texts, t)
        assert [got.get((q, i)) for i in (1, 2, 3)] == (sorted(want, key=lambda i: (-round(want[i], 6), i)) + [None] * 3)[:3]
    assert lexical._scored(chunks, queries, 3, lexical.BM25(), None, lexical.postings(chunks), None).count() <= cores * 3 * len(asked)


def test_parts_are_merged_with_ties_by_slot():
    """A later part's row of an equal score and a smaller slot goes first; rows below the floor are left."""
    rows = [(9, "d9", 0, 2.0, 4), (4, "d4", 0, 1.0, 4), (8, "d8", 0, 2.0, 4), (2, "d2", 0, 2.0, 7), (1, "d1", 0, 0.5, 7), (5, "d5", 1, 3.0, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["slot", "doc_id", "t", "w", "_part"])
    parts = [[b.column(0).to_pylist() for b in own] for own in lexical._by_part(iter([batch.slice(0, 2), batch.slice(2), batch.slice(0, 0)]))]
    assert parts == [[[9, 4], [8]], [[2, 1]], [[5]]]
    asked = [("a", np.array([0]), np.array([1.0])), ("b", np.array([1]), np.array([2.0]))]
    kept = lexical._Kept(2, 2)
    for own in lexical._by_part(iter([batch])):
        kept.add(lexical._Held(own, 2), asked)
    slots, docs = kept.rows()
    assert kept.slot[0].tolist() == [2, 8] and kept.size.tolist() == [2, 1] and kept.floor.tolist() == [2.0, 0.0]
    assert dict(zip(slots.tolist(), docs.to_pylist())) == {2: "d2", 5: "d5", 8: "d8", 9: "d9"}
    with pytest.raises(ValueError):
        list(map(list, lexical._by_part(iter([batch, batch]))))


def test_terms_of_many_texts_and_their_counts(spark):
    """Texts are counted some at a time; of postings only their counts are shuffled."""
    n = 2 * lexical.TEXTS + 7
    chunks = spark.range(n, numPartitions=1).selectExpr("id as slot", "cast(id as string) as doc_id", "concat('a a x', id % 5) as text")
    rows = lexical.term_rows(chunks, ("slot",)).collect()
    assert {(r.slot, r.term, r.tf, r.dl) for r in rows} == {x for i in range(n) for x in ((i, "a", 2, 3), (i, f"x{i % 5}", 1, 3))} and len(rows) == 2 * n
    told = lexical.weighed_terms(lexical.postings(chunks), chunks, spark.createDataFrame([("q", "a x1 zz")], "qid string, text string"))
    assert "LeftSemi" not in told._jdf.queryExecution().optimizedPlan().toString()
    df = {"a": n, "x1": len(range(1, n, 5))}
    assert {r.term: r.idf for r in told.collect()} == pytest.approx({t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()})


def test_statistics_agree_however_made(spark, random_texts):
    _, chunks = corpus(spark, [*random_texts, "-"])
    post = lexical.postings(chunks)
    a, b = lexical.corpus_stats(chunks).first(), lexical.postings_stats(post, chunks).first()
    assert a.n == b.n == 121 and abs(a.avgdl - b.avgdl) < 1e-12


def test_ties_and_padding(spark):
    _, chunks = corpus(spark, ["igual texto", "igual texto", "outro", "mais um", "e outro"])
    queries = spark.createDataFrame([("q", "igual"), ("n", "xyz")], "qid string, text string")
    best = lexical.top(lexical.bm25_scores(chunks, queries), 3)
    assert [(r.doc_id, r["rank"]) for r in best.orderBy("rank").collect()] == [("d0", 1), ("d1", 2)]
    full = lexical.padded(best, chunks, queries, 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r["rank"], r.score > 0) for r in full] == [("n", "d0", 1, False), ("n", "d1", 2, False), ("n", "d2", 3, False), ("q", "d0", 1, True), ("q", "d1", 2, True), ("q", "d2", 3, False)]


def test_dense_topk_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(60, 8)), 3, axis=0)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "slot bigint, v array<double>").repartition(5)
    queries = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(4)], "qid int, v array<double>")
    got = {}
    for r in dense.topk(vectors, queries, 7).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.slot))
    for q in queries.collect():
        s = np.round(v @ np.array(q.v), 6)
        want = sorted(range(len(v)), key=lambda i: (-s[i], i))[:7]
        assert [x for _, x in sorted(got[q.qid])] == want
    assert dense.topk(vectors, queries.where("false"), 3).count() == 0
    assert dense.topk(vectors.where("false"), queries, 3).count() == 0


def test_dense_task_keeps_no_more_than_k(spark, monkeypatch):
    """Ties, a query without a direction too, and many queries take no room beyond k rows of each."""
    rng = np.random.default_rng(5)
    v, q = rng.integers(-2, 3, (400, 4)).astype(float), rng.integers(-2, 3, (70, 4)).astype(float)
    q[0] = 0
    keys = [f"k{i}" for i in rng.permutation(400)]
    vectors = spark.createDataFrame([(key, x.tolist()) for key, x in zip(keys, v)], "slot string, v array<double>").coalesce(1)
    kept = dense._best_of_block(vectors, (list(range(70)), q), 3, "qid bigint, slot string, score double", pa.int64())
    assert {(r.qid, r["count"]) for r in kept.groupBy("qid").count().collect()} == {(i, 3) for i in range(70)}
    for name, value in (("TILE_QUERIES", 16), ("TILE_ROWS", 32), ("STORED_ROWS", 50)):
        monkeypatch.setattr(dense, name, value)
    found = dense._Found(q, 3)
    for i in range(0, 400, 90):
        found.add(pa.RecordBatch.from_arrays([pa.array(keys[i : i + 90])], ["slot"]), v[i : i + 90])
    got = [tuple(r.values()) for b in found.batches(pa.array(range(70))) for r in b.to_pylist()]
    s = v @ q.T
    assert got == [(j, keys[i], s[i, j]) for j in range(70) for i in sorted(range(400), key=lambda i: (-s[i, j], keys[i]))[:3]]
    assert found.rows.num_rows <= 400 and all(len(best.held) == 1 for _, best in found.parts)


def test_encoder_contract(spark):
    e = dense.build_encoder("hashing", dim=32)
    v = e.encode(["Ação judicial", "acao JUDICIAL", "", "x"])
    assert v.shape == (4, 32) and np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v, axis=1), [1, 1, 0, 1])
    with pytest.raises(ValueError):
        dense.build_encoder("none")
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.v for r in df.select(dense.l2_normalize("v").alias("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_rrf(spark):
    lists = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 2, 2), ("q", "a", 3, 3), ("q", "b", 3, 1), ("q", "b", 1, 2)], "qid string, source string, slot int, rank int")
    got = {r.slot: r.score for r in fusion.rrf(lists).collect()}
    assert got == pytest.approx({1: 1 / 61 + 1 / 62, 2: 1 / 62, 3: 1 / 63 + 1 / 61})
    got = {r.slot: r.score for r in fusion.rrf(lists, k=0, weights={"b": 3.0}).collect()}
    assert got == pytest.approx({1: 1 + 1.5, 2: 0.5, 3: 1 / 3 + 3})


def test_counting_hits(spark):
    nan = float("nan")
    hits = spark.createDataFrame(
        [("q", "s", "c1", "d1", 1.0, 0, 1, "2024-01-01"), ("q", "s", "c1", "d1", nan, 0, 1, "2024-01-02"), ("q", "s", "c2", "d1", 2.0, 0, 1, None), ("q", "s", "c2", "d1", 2.0, 0, 1, None), ("q", "s", "c3", "d2", None, 0, 1, "2024-01-01"), (None, "s", "c", "d", 1.0, 0, 1, None), ("q", "t", "c1", "d1", 1.0, 0, 1, "2024-01-01"), ("q", "t", "c1", "d1", 5.0, 0, 1, "2024-01-01")],
        "qid string, source string, chunk_id string, doc_id string, score double, start int, end int, run_ts string",
    ).withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))
    assert sorted((r.source, r.chunk_id, r.score) for r in fusion.counting_hits(hits).collect()) == [("s", "c2", 2.0), ("t", "c1", 5.0)]
    assert fusion.counting_hits(hits.where("false")).count() == 0


@pytest.fixture(scope="module")
def small(spark):
    texts = ["A alíquota do imposto de renda é progressiva.", "O prazo de recurso administrativo é de trinta dias.", "Licença ambiental exige estudo de impacto.", "Imposto sobre serviços e alíquota municipal.", ""]
    docs, chunks = corpus(spark, texts)
    docs = docs.withColumn("meta", F.when(F.col("doc_id") == "d3", '{"uf": "SP"}').otherwise('{"uf": "RJ"}'))
    return search.Collection(chunks, docs, reranker=search.ngram_reranker())


@pytest.mark.parametrize("mode", search.MODES)
def test_search_modes(spark, small, mode):
    q = spark.createDataFrame([("q", "alíquota do imposto")], "qid string, text string")
    hits = search.search(small, q, 3, mode).orderBy("rank").collect()
    assert hits[0].doc_id == "d0" and hits[0].text.startswith("A alíquota")
    only = search.search(small, q, 3, mode, {"uf": "SP"}).collect()
    assert {h.doc_id for h in only} == {"d3"}
    assert search.search(small, q, 3, mode, {"uf": "XX"}).count() == 0


def test_search_chunks_and_errors(spark, small):
    q = spark.createDataFrame([("q", "imposto")], "qid string, text string")
    got = search.search_chunks(small, q, 2, "lexical").orderBy("rank").collect()
    assert [round(h.score, 6) for h in got] == [round(1 / 61, 6), round(1 / 62, 6)]
    with pytest.raises(ValueError):
        search.search(small, q, mode="other")
    with pytest.raises(ValueError):
        search.search(search.Collection(small.chunks, small.docs), q, mode="hybrid_rerank")


def test_hybrid_lists_are_written_one_by_one(spark, small):
    """What one retriever shuffles is gone before the other begins."""
    q = spark.createDataFrame([("q", "imposto alíquota")], "qid string, text string")
    lists = search.candidates(small, q, "hybrid", 3)
    assert "Window" not in lists._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.source, r["rank"], r.doc_id) for r in lists.where("rank = 1").collect()} <= {(s, 1, d) for s in ("dense", "lexical") for d in ("d0", "d3")}


def test_hybrid_rerank_where_joins_shuffle(spark, small):
    """Partitions fit where no side of a join is broadcast by its size, and candidates are retrieved once."""
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["alíquota do imposto", "prazo", "licença", "", "xyz"])], "qid string, text string")
    before = {key: spark.conf.get(key) for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"), spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        hits = search.search(small, q, 3, "hybrid_rerank")
        assert hits._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
        assert {r.qid: r.doc_id for r in hits.where("rank = 1").collect() if r.qid < "q3"} == {"q0": "d0", "q1": "d1", "q2": "d2"}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("mode", ["lexical", "dense", "hybrid", "rerank"])
def test_rerank_is_a_permutation(spark, small, mode):
    q = spark.createDataFrame([("q", "imposto alíquota")], "qid string, text string")
    want = spark.createDataFrame([("q", d, i) for i, d in enumerate(["zz", "d2", "d0", "d0", "d4", "d3"])], "qid string, doc_id string, pos int")
    got = search.rerank(small, q, want, mode).orderBy("rank").collect()
    assert sorted(r.doc_id for r in got) == ["d0", "d2", "d3", "d4", "zz"]
    assert [r.doc_id for r in got][-2:] == ["d4", "zz"] and got[-1].score is None
    assert {got[0].doc_id, got[1].doc_id} == {"d0", "d3"}
    assert search.rerank(small, q, want, mode, 2).count() == 2


def test_partitions_do_not_change_results(spark, small):
    q = spark.createDataFrame([("a", "imposto"), ("b", "prazo de recurso")], "qid string, text string")
    one = sorted(map(tuple, search.search(small, q, 3).collect()))
    moved = search.Collection(small.chunks.repartition(7), small.docs.repartition(3))
    assert sorted(map(tuple, search.search(moved, q, 3).collect())) == one


def test_stored_lists_are_fused_whole(spark, tmp_path):
    """A list of more rows than any retriever's depth counts to its last row."""
    hits = [("q1", source, f"d{i % 7}#{i:03}", f"d{i % 7}", float(-i if source == "dense" else i)) for source in ("dense", "lexical") for i in range(130)]
    hits += [("q1", "dense", "far#000", "far", -1000.0)]
    frame = spark.createDataFrame(hits, "qid string, source string, chunk_id string, doc_id string, score double")
    frame.selectExpr("*", "0 as start", "1 as end", "timestamp_ntz'2024-01-01' as run_ts").write.parquet(f"{tmp_path}/hits.parquet")
    want = {f"d{i % 7}#{i:03}": (1 / (61 + i), 1 / (190 - i)) for i in range(130)} | {"far#000": (1 / 191, 0.0)}
    for name, weight in (("rrf_fuse", 1.0), ("rrf_weighted", 3.0)):
        got = {r.chunk_id: r.score for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == pytest.approx({k: d + weight * x for k, (d, x) in want.items()}, abs=2e-9)
    assert {r.doc_id for r in registry.queries()["doc_maxpool"](spark, str(tmp_path)).collect()} == {*(f"d{i}" for i in range(7)), "far"}

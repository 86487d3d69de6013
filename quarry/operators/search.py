"""Retrieval over a collection: candidates, fusion, pooling, reranking.

Queries always come as a table (qid, text); one query is a table of one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import _folds
from quarry.operators import dense, fusion, lexical
from quarry.operators.chunking import SLOTS
from quarry.operators.filters import compile_filter
from quarry.operators.lexical import BM25, DIGITS
from quarry.session import BROADCAST_ROWS, staged

MODES = ("dense", "lexical", "hybrid", "hybrid_rerank")
#: candidates(qid, slot, doc_id, text), queries(qid, text), collection -> (qid, slot, score)
Reranker = Callable[[DataFrame, DataFrame, "Collection"], DataFrame]


@dataclass(frozen=True)
class Collection:
    """chunks: slot, doc_id, doc_ord, chunk_id, start, end, text. docs: doc_id,
    doc_ord, meta. vectors (slot, v) and stored_postings (term, slot, doc_id,
    tf, dl) are made from the chunks where not given, known is counted."""

    chunks: DataFrame
    docs: DataFrame
    vectors: DataFrame | None = None
    encoder: Callable[[], dense.Encoder] = dense.HashingEncoder
    candidate_k: int = 100
    rrf_k: int = 60
    weights: Mapping[str, float] = field(default_factory=lambda: {"dense": 1.0, "lexical": 1.0})
    bm25: BM25 = BM25()
    reranker: Reranker | None = None
    stored_postings: DataFrame | None = None
    known: lexical.Known | None = None

    def chunk_vectors(self) -> DataFrame:
        if self.vectors is not None:
            return self.vectors
        return dense.encode(self.chunks.select("slot", "doc_id", "text"), self.encoder).select("slot", "doc_id", "v")

    def allowed(self, where: Mapping[str, Any] | None) -> DataFrame | None:
        """Documents that the filter accepts; None: all."""
        return self.docs.where(compile_filter(where)).select("doc_id") if where else None


def _check(mode: str, modes: tuple[str, ...] = MODES) -> None:
    if mode not in modes:
        raise ValueError(f"unknown mode: {mode!r}")


def candidates(c: Collection, queries: DataFrame, mode: str, k: int, where: Mapping[str, Any] | None = None) -> DataFrame:
    """(qid, source, slot, doc_id, score, rank): the lists of each retriever. A
    filter acts before the ranking, so it never shortens a list below k while
    there are k chunks to take."""
    _check(mode)
    allowed = c.allowed(where)
    lists = []
    columns = ["qid", "source", "slot", "doc_id", "score", "rank"]
    if mode != "lexical":
        vectors = c.chunk_vectors()
        if "doc_id" not in vectors.columns:
            vectors = vectors.join(c.chunks.select("slot", "doc_id"), "slot")
        if allowed is not None:
            vectors = vectors.join(allowed, "doc_id", "left_semi")
        q = dense.encode(queries, c.encoder, query=True).select("qid", "v")
        found = dense.topk(vectors, q, k, keep=("doc_id",)).withColumn("source", F.lit("dense")).select(columns)
        # of two lists each is written, so that only one retriever's rows are on the disks at a time
        lists.append(found if mode == "dense" else staged(found, "list", tidy=True))
    if mode != "dense":
        found = lexical.bm25_topk(c.chunks, queries, k, c.bm25, allowed, c.stored_postings, c.known)
        lists.append(found.withColumn("source", F.lit("lexical")).select(columns))
    return lists[0] if len(lists) == 1 else lists[0].unionByName(staged(lists[1], "list", tidy=True))


def chunk_scores(c: Collection, queries: DataFrame, mode: str, where: Mapping[str, Any] | None = None) -> DataFrame:
    """(qid, slot, doc_id, score): raw scores for one retriever, fused ones for
    both. hybrid_rerank replaces the scores of the best candidate_k fused
    chunks by those of the collection's reranker."""
    _check(mode)
    if mode == "hybrid_rerank" and c.reranker is None:
        raise ValueError("hybrid_rerank needs a collection with a reranker")
    if mode == "hybrid_rerank" and c.stored_postings is None:  # read by the lexical list and by the reranker
        c = replace(c, stored_postings=staged(lexical.postings(c.chunks, tokenizer=c.bm25.tokenizer), "postings"))
    lists = candidates(c, queries, mode, c.candidate_k, where)
    if mode in ("dense", "lexical"):
        return lists.select("qid", "slot", "doc_id", "score")
    fused = fusion.rrf(lists, ["slot", "doc_id"], c.rrf_k, c.weights)
    if mode == "hybrid":
        return fused
    # written: both sides of the join read it, which else are retrieved twice and may be planned with partitions that do not fit
    best = staged(fusion.ranked(fused, "slot", c.candidate_k).select("qid", "slot", "doc_id"), "best")
    scored = c.reranker(best.join(c.chunks.select("slot", "text"), "slot"), queries, c)
    return best.join(scored.select("qid", "slot", "score"), ["qid", "slot"])


def _documents(scores: DataFrame, k: int) -> DataFrame:
    # a slot begins with the document's place in the order of arrival
    arrival = F.floor(F.col("slot") / SLOTS)
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), arrival)
    return fusion.pool_documents(scores).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _payload(c: Collection, hits: DataFrame) -> DataFrame:
    """Texts are fetched for the winners only."""
    chunks = c.chunks.select("slot", "chunk_id", "start", "end", "text")
    return hits.join(chunks, "slot").select("qid", "rank", "doc_id", "score", "chunk_id", "start", "end", "text")


def search(c: Collection, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", where: Mapping[str, Any] | None = None) -> DataFrame:
    """(qid, rank, doc_id, score, chunk_id, start, end, text): the best
    documents, each by its best chunk, equal scores in the order of arrival."""
    return _payload(c, _documents(chunk_scores(c, queries, mode, where), top_k))


def retrieve_ranking(c: Collection, queries: DataFrame, depth: int = 100, mode: str = "hybrid", where: Mapping[str, Any] | None = None) -> DataFrame:
    """(qid, doc_id, rank): search without what is shown."""
    return _documents(chunk_scores(c, queries, mode, where), depth).select("qid", "doc_id", "rank")


def search_chunks(c: Collection, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", where: Mapping[str, Any] | None = None, weights: Mapping[str, float] | None = None, candidate_k: int | None = None) -> DataFrame:
    """As search, for chunks: scores are always sums of 1 / (k + rank) over the
    lists, which are top_k long unless candidate_k says otherwise."""
    lists = candidates(c, queries, "hybrid" if mode == "hybrid_rerank" else mode, candidate_k or top_k, where)
    fused = fusion.rrf(lists, ["slot", "doc_id"], c.rrf_k, weights)
    return _payload(c, fusion.ranked(fused, "slot", top_k))


def score_documents(c: Collection, queries: DataFrame, wanted: DataFrame, mode: str = "lexical") -> DataFrame:
    """(qid, doc_id, pos, score): scores of given documents wanted(qid, doc_id,
    pos). A repeated document counts at its first position. Documents that are
    unknown or have no chunk have the score null, the place of minus infinity.

    A document has its best chunk's score; hybrid sums weight / (k + rank) over
    both retrievers with ranks among the query's documents, equal scores in the
    order of pos. Only chunks of wanted documents are scored; term statistics
    are those of the whole collection.
    """
    _check(mode, ("lexical", "dense", "hybrid", "rerank"))
    want = wanted.groupBy("qid", "doc_id").agg(F.min("pos").alias("pos"))
    present = c.chunks.select("slot", "doc_id").join(want, "doc_id")
    if mode == "rerank":
        if c.reranker is None:
            raise ValueError("mode 'rerank' needs a collection with a reranker")
        best = c.reranker(present.join(c.chunks.select("slot", "text"), "slot").select("qid", "slot", "doc_id", "text"), queries, c).join(present, ["qid", "slot"])
        by_doc = best.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
        return want.join(by_doc, ["qid", "doc_id"], "left")
    parts: dict[str, DataFrame] = {}
    if mode in ("lexical", "hybrid"):
        found = lexical.pair_scores(c.chunks, queries, present, c.bm25, c.stored_postings).select("qid", "slot", F.col("score").alias("s"))
        parts["lexical"] = present.join(found, ["qid", "slot"], "left").groupBy("qid", "doc_id").agg(F.max(F.coalesce("s", F.lit(0.0))).alias("score"))
    if mode in ("dense", "hybrid"):
        q = dense.encode(queries, c.encoder, query=True).select("qid", F.col("v").alias("_q"))
        pairs = present.join(c.chunk_vectors().select("slot", "v"), "slot").join(q, "qid")
        parts["dense"] = pairs.groupBy("qid", "doc_id").agg(F.max(dense.dot(F.col("v"), F.col("_q"))).alias("score"))
    if mode != "hybrid":
        return want.join(parts[mode], ["qid", "doc_id"], "left")
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), "pos")
    lists = [
        p.join(want, ["qid", "doc_id"]).withColumn("rank", F.row_number().over(order)).select("qid", "doc_id", F.lit(source).alias("source"), "rank")
        for source, p in parts.items()
    ]
    fused = fusion.rrf(lists[0].unionByName(lists[1]), "doc_id", c.rrf_k, c.weights)
    return want.join(fused, ["qid", "doc_id"], "left")


def rerank(c: Collection, queries: DataFrame, wanted: DataFrame, mode: str = "lexical", top_k: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the wanted documents anew ordered, those
    without a score last, equal ones by doc_id as text. top_k None or 0: all."""
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc_nulls_last(), F.col("doc_id").cast("string"))
    out = score_documents(c, queries, wanted, mode).withColumn("rank", F.row_number().over(order)).select("qid", "doc_id", "score", "rank")
    return out.where(F.col("rank") <= top_k) if top_k else out


def ngram_reranker(n: int = 3) -> Reranker:
    """A reranker without a model: the mean of the idf-weighted share of the
    query's terms that a chunk holds and of the share of its character n-grams."""

    def run(pairs: DataFrame, queries: DataFrame, c: Collection) -> DataFrame:
        stored = c.stored_postings if c.stored_postings is not None else lexical.postings(c.chunks, tokenizer=c.bm25.tokenizer)
        told = lexical.weighed_terms(stored, c.chunks, queries, tokenizer=c.bm25.tokenizer)
        terms = told.groupBy("qid").agg(F.collect_list("term").alias("_terms"), F.collect_list("idf").alias("_idf"))
        asked = queries.select("qid", F.col("text").alias("_query")).join(terms, "qid", "left")
        # where the query set is small it comes to the pairs, which stay as they are, ordered by slot; else texts move to their queries
        few = queries.count() <= BROADCAST_ROWS
        rows = pairs.select("qid", "slot", "text").join(F.broadcast(asked) if few else asked, "qid")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold = dict(zip(map(ord, _folds()[0]), _folds()[1]))
            find = re.compile(r"[^\W_]+").findall

            def parts(text: str | None) -> tuple[set[str], set[str]]:
                own = [t.lower().translate(fold) for t in find(text or "")]
                line = " ".join(own)
                return set(own), {line[i : i + n] for i in range(max(1, len(line) - n + 1))}

            for batch in batches:
                asked_parts: dict[object, set[str]] = {}
                held: dict[int, tuple[set[str], set[str]]] = {}
                values = []
                for qid, slot, text, query, terms_, idf in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if qid not in asked_parts:
                        asked_parts[qid] = parts(query)[1]
                    if slot not in held:
                        if len(held) > 200:
                            held.clear()
                        held[slot] = parts(text)
                    own, grams = held[slot]
                    weight = dict(zip(terms_ or (), idf or ()))
                    word = sum(w for t, w in weight.items() if t in own) / sum(weight.values()) if weight else 0.0
                    values.append((word + len(asked_parts[qid] & grams) / max(1, len(asked_parts[qid]))) / 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["qid", "slot", "score"])

        kind = queries.schema["qid"].dataType.simpleString()
        return rows.select("qid", "slot", "text", "_query", "_terms", "_idf").mapInArrow(score, f"qid {kind}, slot bigint, score double")

    return run

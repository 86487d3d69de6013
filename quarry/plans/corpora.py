"""The collections that the registered queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, crud, dense, evaluate, fusion, search
from quarry.session import staged
from quarry.sources.tables import table

MAX_CHARS = 2500


def docs(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc_ord, text, meta): the current row of each doc_id that has a text."""
    rows = table(s, d, "docs").select("doc_id", "doc_ord", "text", "meta", "updated")
    newest = crud.latest(rows.withColumn("_order", F.struct(F.coalesce(F.unix_micros(F.col("updated").cast("timestamp")), F.lit(-(2**63))).alias("u"), "doc_ord")), "doc_id", "_order")
    return newest.where("text is not null").select("doc_id", "doc_ord", "text", "meta")


def queries(s: SparkSession, d: str) -> DataFrame:
    """(qid, text): each query once. A null text is no query."""
    rows = table(s, d, "queries").where("_id is not null and text is not null")
    return rows.groupBy(F.col("_id").alias("qid")).agg(F.max("text").alias("text"))


def qrels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "qrels").select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("rel"))
    return evaluate.clean_qrels(rows)


def wanted(s: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, pos): candidate lists; a query with several lists has the longest."""
    lists = table(s, d, "top_ranked").select(F.col("query-id").alias("qid"), F.col("corpus-ids").alias("ids")).where("qid is not null and ids is not null")
    one = lists.groupBy("qid").agg(F.max_by("ids", F.size("ids")).alias("ids"))
    return one.select("qid", F.posexplode("ids").alias("pos", "doc_id")).where("doc_id is not null")


def chunks(s: SparkSession, d: str, mode: str = "window") -> DataFrame:
    return chunking.chunk(docs(s, d), mode, MAX_CHARS)


def collection(s: SparkSession, d: str, mode: str = "window", vectors: bool = False) -> search.Collection:
    """Chunks are written once: term counts, statistics and payload all read them."""
    texts = docs(s, d)
    cut = staged(chunking.chunk(texts, mode, MAX_CHARS), "chunks", tidy=vectors)
    made = staged(dense.encode(cut.select("slot", "doc_id", "text"), dense.HashingEncoder).select("slot", "doc_id", "v"), "vectors") if vectors else None
    return search.Collection(cut, texts.select("doc_id", "doc_ord", "meta"), made)


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").alias("v"))


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    return vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "v")


def lists(s: SparkSession, d: str, k: int | None = None) -> DataFrame:
    """(qid, source, doc_id, chunk_id, score, rank): the stored lists of all sources."""
    return fusion.ranked(fusion.counting_hits(table(s, d, "hits")), "chunk_id", k, ["qid", "source"])


def list_ranking(s: SparkSession, d: str, source: str) -> DataFrame:
    """(qid, doc_id, rank): documents of one stored list, by their best chunk."""
    own = fusion.counting_hits(table(s, d, "hits").where(F.col("source") == source))
    return fusion.ranked(fusion.pool_documents(own, "chunk_id"), "doc_id").select("qid", "doc_id", "rank")

"""Rankings: from scores, fused by reciprocal ranks, pooled to documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lexical import DIGITS


def ranked(scores: DataFrame, tie: str, k: int | None = None, by: str | list[str] = "qid") -> DataFrame:
    """``rank`` from 1, best first, equal (rounded) scores by ``tie``."""
    order = Window.partitionBy(by).orderBy(F.round("score", DIGITS).desc(), tie)
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def _weight(weights: Mapping[str, float] | None) -> Column:
    w = F.lit(1.0)
    for source, value in (weights or {}).items():
        w = F.when(F.col("source") == source, F.lit(float(value))).otherwise(w)
    return w


def rrf(rankings: DataFrame, key: str | list[str] = "slot", k: int = 60, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(qid, key, score): the sum of weight / (k + rank) over the lists
    (``source``) of rankings(qid, source, rank, key). A list without an id adds
    nothing. One aggregate with a map-side part instead of an outer join."""
    keys = [key] if isinstance(key, str) else key
    return rankings.groupBy("qid", *keys).agg(F.sum(_weight(weights) / (k + F.col("rank"))).alias("score"))


def pool_documents(scores: DataFrame, tie: str = "slot") -> DataFrame:
    """The best chunk of each (qid, doc_id), of equal ones the first by ``tie``."""
    order = Window.partitionBy("qid", "doc_id").orderBy(F.round("score", DIGITS).desc(), tie)
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def counting_hits(hits: DataFrame) -> DataFrame:
    """Of a table of scored chunks, with repeats and several runs, the rows that
    count: of each (qid, source, chunk_id) the latest run (of equal times the
    greatest score), if its score is a number. Rows without qid, source,
    chunk_id or doc_id do not count. An aggregate, so repeats meet map-side."""
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    pick = F.struct(F.coalesce(F.col("run_ts").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("t"), score.alias("score"), "start", "end")
    rows = hits.where("qid is not null and source is not null and chunk_id is not null and doc_id is not null")
    last = rows.groupBy("qid", "source", "doc_id", "chunk_id").agg(F.max(pick).alias("last"))
    return last.where("last.score is not null").select("qid", "source", "doc_id", "chunk_id", "last.score", "last.start", "last.end")

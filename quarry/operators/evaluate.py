"""Measures of rankings against graded judgments.

rankings(qid, doc_id, rank), rank from 1; qrels(qid, doc_id, rel). Queries
without judgments are not measured; judged queries without a ranking have 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_qrels(qrels: DataFrame) -> DataFrame:
    """One row for each (qid, doc_id): of several judgments the highest. Rows without a qid, doc_id or rel are left out."""
    return qrels.where("qid is not null and doc_id is not null and rel is not null").groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))


def _gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + 1.0)


def _judged(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """rankings of judged queries with rel, 0 where a document is not judged."""
    inside = rankings.join(qrels.select("qid").distinct(), "qid", "left_semi")
    return inside.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _per_query(values: DataFrame, qrels: DataFrame) -> DataFrame:
    return qrels.select("qid").distinct().join(values, "qid", "left").select("qid", F.coalesce("value", F.lit(0.0)).alias("value"))


def ndcg(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, value): discounted gain (linear in rel) over that of the ideal order of all judged documents; 0 where that is 0."""
    dcg = _judged(rankings.where(F.col("rank") <= k), qrels).groupBy("qid").agg(F.sum(_gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    ideal = qrels.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k).groupBy("qid").agg(F.sum(_gain(F.col("rel"), F.col("_i"))).alias("idcg"))
    return ideal.join(dcg, "qid", "left").select("qid", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("value"))


def recall(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, value): share of the relevant documents (rel > 0) within k; 0 where there is none."""
    all_ = qrels.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("relevant"))
    got = _judged(rankings.where(F.col("rank") <= k), qrels).where("rel > 0").groupBy("qid").agg(F.countDistinct("doc_id").alias("found"))
    return all_.join(got, "qid", "left").select("qid", F.when(F.col("relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("value"))


def mrr(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, value): 1 / rank of the first relevant document within k, else 0."""
    first = _judged(rankings.where(F.col("rank") <= k), qrels).where("rel > 0").groupBy("qid").agg((1.0 / F.min("rank")).alias("value"))
    return _per_query(first, qrels)


def average_precision(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, value): sum of precision at each relevant rank within k over the number of all relevant documents."""
    running = F.count_if(F.col("rel") > 0).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    summed = _judged(rankings.where(F.col("rank") <= k), qrels).withColumn("_hits", running).where("rel > 0").groupBy("qid").agg(F.sum(F.col("_hits") / F.col("rank")).alias("_p"))
    relevant = qrels.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("_n"))
    return relevant.join(summed, "qid", "left").select("qid", F.when(F.col("_n") > 0, F.coalesce("_p", F.lit(0.0)) / F.col("_n")).otherwise(0.0).alias("value"))


def _summary(parts: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, values in parts.items():
        row = values.agg(F.count("*").alias("queries"), F.avg("value").alias("value")).where("queries > 0").select(F.lit(name).alias("metric"), "queries", "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def evaluate(rankings: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = (10, 100)) -> DataFrame:
    """(metric, queries, value): means over judged queries; no judged query, no row."""
    parts = {}
    for k in k_values:
        parts |= {f"ndcg_at_{k}": ndcg(rankings, qrels, k), f"recall_at_{k}": recall(rankings, qrels, k), f"mrr_at_{k}": mrr(rankings, qrels, k)}
    return _summary(parts)


def evaluate_reranking(rankings: DataFrame, qrels: DataFrame, k: int = 1000) -> DataFrame:
    """(metric, queries, value): map_at_k, ndcg_at_10 and mrr_at_10 over judged queries."""
    return _summary({f"map_at_{k}": average_precision(rankings, qrels, k), "ndcg_at_10": ndcg(rankings, qrels, 10), "mrr_at_10": mrr(rankings, qrels, 10)})


def latency_percentiles(times: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95): exact percentiles, interpolated linearly."""
    return times.groupBy(by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def leaderboard(ours: DataFrame, others: DataFrame) -> DataFrame:
    """(task, best, mode, best_other, median, models, below): ours(task, mode,
    score) against others(task, model, score), for tasks that both have. median
    is the upper one; below is the percentage of models under our best score.
    Of equal scores the first by name is best."""
    mine = ours.groupBy("task").agg(F.max("score").alias("best"), F.min_by("mode", F.struct(-F.col("score"), "mode")).alias("mode"))
    joined = others.join(mine, "task")
    return joined.groupBy("task", "best", "mode").agg(
        F.max("score").alias("best_other"),
        F.element_at(F.array_sort(F.collect_list("score")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"),
        F.count("*").alias("models"),
        (100.0 * F.avg(F.when(F.col("score") < F.col("best"), 1.0).otherwise(0.0))).alias("below"),
    )

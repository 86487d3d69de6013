"""Results as JSON and as tables for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits_json(hits: DataFrame) -> DataFrame:
    """(qid, hits): one JSON array for each query, in the order of rank."""
    row = F.struct("rank", F.struct("doc_id", "score", "chunk_id", "start", "end", "text").alias("hit"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["hit"])
    return hits.groupBy("qid").agg(F.to_json(ordered).alias("hits"))


def write_results(rows: DataFrame, path: str) -> None:
    """Experiment records as JSON lines."""
    rows.write.mode("overwrite").json(path)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A report of at most ``limit`` rows as a Markdown table; doubles with four decimals."""

    def cell(v: object) -> str:
        return f"{v:.4f}" if isinstance(v, float) else "-" if v is None else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines)


def best_experiments(records: DataFrame, score: str = "score") -> DataFrame:
    """(task, experiment, score): the best record of each task, of equal ones the first by name."""
    best = F.min_by(F.struct("experiment", F.col(score).alias("score")), F.struct(-F.col(score), "experiment"))
    return records.groupBy("task").agg(best.alias("_b")).select("task", "_b.experiment", "_b.score")

"""One question over texts in hand, as rows to show.

``shown`` is what the command line prints and what a page would fill a table
with; it keeps no index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import preview
from quarry.index import Index
from quarry.operators.search import ngram_reranker
from quarry.session import remove, scratch
from quarry.sources.files import split_delimited

#: Characters of a text that a row shows.
SHOWN = 400
ROW = "rank int, score double, doc_id string, span string, preview string"


def shown(hits: DataFrame, most: int = SHOWN) -> DataFrame:
    """(qid, rank, score, doc_id, span, preview): hits for the eye. score has
    four decimals, span is 'start-end', preview one line of ``most`` characters."""
    span = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    return hits.select("qid", "rank", F.round("score", 4).alias("score"), "doc_id", span.alias("span"), preview("text", most).alias("preview"))


def ask(spark: SparkSession, question: str, blob: str | None, mode: str = "hybrid", top_k: int = 3, chunk_mode: str = "structure") -> tuple[list[tuple], str]:
    """(rows, note): the best documents of a delimited text (``=== name ===``
    lines) for a question. rows: (rank, score, doc_id, 'start-end', preview).
    Without documents or without a question there are no rows and the note
    says which is missing."""
    docs = split_delimited(spark.createDataFrame([(blob or "",)], "text string"))
    if docs.isEmpty():
        return [], "No document given."
    if not question.strip():
        return [], "No question given."
    path = scratch(spark, "ask")
    try:
        index = Index(spark, path, chunk_mode, reranker=ngram_reranker())
        index.add_documents(docs)
        rows = shown(index.search(question, top_k, mode)).orderBy("rank").drop("qid").collect()
        s = index.stats().first()
    finally:
        remove(spark, path)
    return [tuple(r) for r in rows], f"{s.documents} documents in {s.chunks} chunks, mode {mode}, chunk mode {s.chunk_mode}, {s.bytes / 1e6:.1f} MB of index"

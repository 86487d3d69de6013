"""Retrieval and reranking tasks: documents, queries, judgments, candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import char_cap, strip, strip_html, without_suffix
from quarry.operators.evaluate import clean_qrels


@dataclass(frozen=True)
class Task:
    """docs(doc_id, doc_ord?, text, title?), queries(qid, text), qrels(qid,
    doc_id, rel), candidates(qid, doc_id, pos) of a reranking task."""

    name: str
    docs: DataFrame
    queries: DataFrame
    qrels: DataFrame
    candidates: DataFrame | None = None
    main_score: str = "ndcg_at_10"

    def judged(self) -> Task:
        """Only queries with judgments and, in a reranking task, with candidates."""
        keep = self.queries.join(self.qrels.select("qid").distinct(), "qid", "left_semi")
        cand = self.candidates
        if cand is not None:
            keep = keep.join(cand.select("qid").distinct(), "qid", "left_semi")
            cand = cand.join(keep.select("qid"), "qid", "left_semi")
        return Task(self.name, self.docs, keep, self.qrels.join(keep.select("qid"), "qid", "left_semi"), cand, self.main_score)


def from_tables(name: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, top_ranked: DataFrame | None = None) -> Task:
    """A task in the usual exchange format: corpus(_id, text, title?),
    queries(_id, text), qrels(query-id, corpus-id, score), top_ranked(query-id,
    corpus-ids). Of several judgments of a pair the highest counts."""
    title = F.col("title") if "title" in corpus.columns else F.lit(None).cast("string")
    docs = corpus.where("_id is not null and text is not null").select(F.col("_id").cast("string").alias("doc_id"), "text", F.coalesce(title, F.lit("")).alias("title"))
    q = queries.where("_id is not null and text is not null").groupBy(F.col("_id").cast("string").alias("qid")).agg(F.max("text").alias("text"))
    rels = clean_qrels(qrels.select(F.col("query-id").cast("string").alias("qid"), F.col("corpus-id").cast("string").alias("doc_id"), F.col("score").cast("int").alias("rel")))
    cand = None
    if top_ranked is not None:
        lists = top_ranked.where(F.size("corpus-ids") > 0).select(F.col("query-id").cast("string").alias("qid"), F.posexplode("corpus-ids").alias("pos", "doc_id"))
        cand = lists.where("doc_id is not null").groupBy("qid", F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("pos").alias("pos"))
    return Task(name, docs, q, rels, cand, "map_at_1000" if cand is not None else "ndcg_at_10").judged()


def from_csv(spark: SparkSession, name: str, docs: str, queries: str, qrels: str) -> Task:
    """Three CSV files: KEY, ENUNCIADO; ID, TEXT; QUERY_ID, DOC_ID, SCORE.
    Tags are stripped from documents; those without text are left out."""

    def read(path: str) -> DataFrame:
        return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')

    corpus = read(docs).select(F.col("KEY").alias("_id"), strip_html("ENUNCIADO").alias("text")).where("text <> ''")
    asked = read(queries).select(F.col("ID").alias("_id"), strip("TEXT").alias("text"))
    judged = read(qrels).select(F.col("QUERY_ID").alias("query-id"), F.col("DOC_ID").alias("corpus-id"), F.col("SCORE").cast("double").cast("int").alias("score"))
    return from_tables(name, corpus, asked, judged)


_DOCUMENT = "filename string, filedata string"
_REFS = "array<struct<file: string>>"
_QUESTION = f"question_number string, question_text string, formatted_references {_REFS}, formatted_embedded_references {_REFS}"


def from_json(spark: SparkSession, name: str, docs: str, questions: str, doc_char_cap: int | None = None) -> Task:
    """Two JSON files: documents (filename, filedata) and questions with their
    references. A direct reference is judged 2, an embedded one 1, the first
    of both holds; '.txt' at the end of a name is dropped; references to
    unknown documents and questions without any are left out."""
    raw = spark.read.schema(_DOCUMENT).json(docs, multiLine=True)
    text = strip("filedata")
    capped = text if doc_char_cap is None else char_cap(text, doc_char_cap)
    named = raw.select(without_suffix(strip("filename"), ".txt").alias("_id"), capped.alias("text")).where("_id <> '' and text <> ''")
    corpus = named.groupBy("_id").agg(F.max("text").alias("text")).withColumn("title", F.col("_id"))
    asked = spark.read.schema(_QUESTION).json(questions, multiLine=True).select(strip(F.col("question_number")).alias("_id"), strip("question_text").alias("text"), "formatted_references", "formatted_embedded_references").where("_id <> '' and text <> ''")
    refs = None
    for column, rel in (("formatted_references", 2), ("formatted_embedded_references", 1)):
        part = asked.select("_id", F.explode(column).alias("ref")).select(F.col("_id").alias("query-id"), without_suffix(strip("ref.file"), ".txt").alias("corpus-id"), F.lit(rel).alias("score"))
        refs = part if refs is None else refs.unionByName(part)
    known = refs.where(F.col("corpus-id") != "").join(corpus.select(F.col("_id").alias("corpus-id")), "corpus-id", "left_semi")
    return from_tables(name, corpus, asked.select("_id", "text"), known)

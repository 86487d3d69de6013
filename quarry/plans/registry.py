"""Queries over the library's own operators, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.index import Index
from quarry.operators import chunking, crud, dense, evaluate, filters, fusion, lexical, search
from quarry.plans import corpora as c
from quarry.plans.oracles import FILTERS, OWN_LISTS, SOURCE_WEIGHTS, WHERE, oracle_sql
from quarry.session import scratch, staged
from quarry.sources import files, sinks, tasks
from quarry.sources.tables import table
from quarry.streaming.ingest import ingest

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]
_SPAN = ["doc_id", "chunk_ord", "start", "end"]


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _staged_chunks(s: SparkSession, d: str) -> DataFrame:
    return staged(c.chunks(s, d), "chunks")


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Rounded as SQL rounds doubles; F.round goes by decimal numbers, which is slow for a row of every query and chunk."""
    return lexical.bm25_scores(_staged_chunks(s, d), c.queries(s, d)).select("qid", "slot", (F.rint(F.col("score") * 1e6) / 1e6).alias("score"))


def _padded(s: SparkSession, d: str) -> DataFrame:
    cut, q = _staged_chunks(s, d), c.queries(s, d)
    best = staged(lexical.bm25_topk(cut, q, 100), "best")
    return lexical.padded(best, cut, q, 100).select("qid", "slot", _r("score"), "rank")


def _idf(s: SparkSession, d: str) -> DataFrame:
    cut = _staged_chunks(s, d)
    return lexical.terms_table(lexical.term_freq(cut), lexical.corpus_stats(cut)).select("term", "df", _r("idf"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    cut = _staged_chunks(s, d)
    tf = lexical.term_freq(cut).agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    counts = c.docs(s, d).agg(F.count("*").alias("documents")).join(cut.agg(F.count("*").alias("chunks")))
    return counts.join(tf)


def _upsert(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "docs")
    first = crud.latest(rows.withColumn("_order", -F.col("doc_ord")), "doc_id", "_order").drop("_order")
    return crud.upsert(first, rows).select("doc_id", "doc_ord", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _delete(s: SparkSession, d: str) -> DataFrame:
    rows = c.docs(s, d)
    return crud.delete(rows, rows.where(filters.compile_filter({"ano": {"$lt": 2005}})).select("doc_id")).select("doc_id", "doc_ord")


def _update(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "docs")
    first = crud.latest(rows.withColumn("_order", -F.col("doc_ord")), "doc_id", "_order").drop("_order")
    last = crud.latest(rows)
    merged = crud.update_metadata(first, last.select("doc_id", "meta"))
    return merged.select("doc_id", *[F.get_json_object("meta", f"$.{f}").alias(f) for f in ("ano", "tipo", "uf", "tags")])


def _measured_lists(s: SparkSession, d: str) -> DataFrame:
    """(task, model, score): means over the judged queries of each stored list, a task being a measure."""
    by_list = F.struct("source", "qid")
    own = fusion.counting_hits(table(s, d, "hits")).select(by_list.alias("qid"), "doc_id", "chunk_id", "score")
    ranking = fusion.ranked(fusion.pool_documents(own, "chunk_id"), "doc_id").select("qid", "doc_id", "rank")
    names = own.agg(F.collect_set("qid.source").alias("_names"))
    judged = c.qrels(s, d).join(F.broadcast(names)).select(F.explode("_names").alias("source"), "qid", "doc_id", "rel")
    judged = judged.select(by_list.alias("qid"), "doc_id", "rel")
    parts = None
    for task, measure, k in (("ndcg_at_10", evaluate.ndcg, 10), ("recall_at_100", evaluate.recall, 100), ("mrr_at_10", evaluate.mrr, 10)):
        rows = measure(ranking, judged, k).groupBy(F.col("qid.source").alias("model")).agg(F.avg("value").alias("score")).select(F.lit(task).alias("task"), "model", _r("score"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _leaderboard(s: SparkSession, d: str) -> DataFrame:
    """Our modes are the lists of the two retrievers, the other models all other lists."""
    every = _measured_lists(s, d)
    own = F.col("model").isin(*OWN_LISTS)
    return evaluate.leaderboard(every.where(own).withColumnRenamed("model", "mode"), every.where(~own)).select("task", _r("best"), "mode", _r("best_other"), _r("median"), "models", _r("below"))


def _best_lists(s: SparkSession, d: str) -> DataFrame:
    """Measures written as records and read again, then the best of each task."""
    path = scratch(s, "results")
    sinks.write_results(_measured_lists(s, d).withColumnRenamed("model", "experiment"), path)
    return sinks.best_experiments(s.read.schema("task string, experiment string, score double").json(path)).select("task", "experiment", _r("score"))


_HIT = "array<struct<doc_id: string, score: double, chunk_id: string, start: int, end: int, text: string>>"


def _hits_as_json(s: SparkSession, d: str) -> DataFrame:
    """Hits as one JSON array for each query, read back."""
    found = search.search(c.collection(s, d), c.queries(s, d), 10, "lexical")
    rows = sinks.hits_json(found).select("qid", F.posexplode(F.from_json("hits", _HIT)).alias("_at", "h"))
    return rows.select("qid", (F.col("_at") + 1).alias("rank"), "h.doc_id", F.round("h.score", 6).alias("score"), "h.chunk_id", "h.start", "h.end")


def _delimited(s: SparkSession, d: str) -> DataFrame:
    """Each document as a delimited text: a repeated name, a header without a name, empty sections."""
    parts = ("lost\n=== texto ===\n", F.col("text"), "\n=== ===\n", F.coalesce("title", F.lit("")), "\n=== texto ===\n", F.coalesce("norma", F.lit("")), "\n==== fim====\n", F.coalesce("lang", F.lit("")))
    blobs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("k"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("blob"))
    return files.split_delimited(blobs, "blob", "k").select("k", "doc_id", "doc_ord", F.char_length("text").alias("n"), F.md5("text").alias("text_md5"))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Documents written as one text file for each language (with line ends as \\n) and read as whole files."""
    path = scratch(s, "files")
    lines = table(s, d, "documents").where("text is not null").select(F.coalesce("uf", F.lit("none")).alias("uf"), F.regexp_replace("title", r"[\r\n]", " ").alias("value"))
    lines.where("value is not null").write.partitionBy("uf").option("compression", "none").text(path)
    whole = files.read_files(s, [path.removeprefix("file://")])
    return whole.groupBy(F.regexp_extract("doc_id", "uf=([^/]*)/", 1).alias("uf")).agg(F.sum(F.char_length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))


def _task(s: SparkSession, d: str) -> tasks.Task:
    corpus = c.docs(s, d).select(F.col("doc_id").alias("_id"), "text")
    return tasks.from_tables("stored", corpus, table(s, d, "queries"), table(s, d, "qrels"), table(s, d, "top_ranked"))


def _csv_task(s: SparkSession, d: str) -> tasks.Task:
    """The collection written as CSV files and read as a task."""
    path = scratch(s, "csv")
    parts = {
        "docs": c.docs(s, d).select(F.col("doc_id").alias("KEY"), F.col("text").alias("ENUNCIADO")),
        "queries": table(s, d, "queries").select(F.col("_id").alias("ID"), F.col("text").alias("TEXT")),
        "qrels": table(s, d, "qrels").select(F.col("query-id").alias("QUERY_ID"), F.col("corpus-id").alias("DOC_ID"), F.col("score").alias("SCORE")),
    }
    for name, rows in parts.items():
        rows.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(f"{path}/{name}")
    return tasks.from_csv(s, "csv", *(f"{path}/{name}" for name in parts))


def _json_task(s: SparkSession, d: str) -> tasks.Task:
    """The collection written as JSON files, each one array or object, and read as a task."""
    path = scratch(s, "json")
    c.docs(s, d).select(F.to_json(F.struct(F.concat("doc_id", F.lit(".txt")).alias("filename"), F.col("text").alias("filedata"))).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/docs")
    refs = c.qrels(s, d).groupBy("qid").agg(*[F.collect_list(F.when(own, F.struct(F.concat("doc_id", F.lit(end)).alias("file")))).alias(name) for name, own, end in (("formatted_references", F.col("rel") > 1, ".txt"), ("formatted_embedded_references", F.col("rel") <= 1, ""))])
    asked = c.queries(s, d).select(F.col("qid").alias("question_number"), F.col("text").alias("question_text"), "qid").join(refs, "qid").drop("qid")
    asked.select(F.to_json(F.struct("*")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/questions")
    return tasks.from_json(s, "json", f"{path}/docs", f"{path}/questions", 500)


def _from_stream(s: SparkSession, d: str) -> DataFrame:
    """Rows of docs as a stream into an index; of repeated ids the last that has a text counts."""
    index = Index(s, scratch(s, "stream"), "window", c.MAX_CHARS)
    rows = table(s, d, "docs").select("doc_id", "doc_ord", "text", "meta")
    path = scratch(s, "arriving")
    rows.write.parquet(path)
    ingest(s.readStream.schema(rows.schema).parquet(path), index, scratch(s, "offsets")).awaitTermination()
    return index.table("docs").select("doc_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _metadata(s: SparkSession, d: str) -> DataFrame:
    """Metadata for the documents of one kind from a table, a shared text for all others."""
    rows = c.docs(s, d)
    told = filters.matching(rows, {"tipo": "lei"}).select("doc_id", F.to_json(F.struct(F.char_length("text").alias("n"))).alias("meta"))
    return crud.assign_metadata(rows, told, '{"n": 0}').select("doc_id", "meta")


def _searched(mode: str, where: dict | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = search.search(c.collection(s, d, vectors=mode != "lexical"), c.queries(s, d), 10, mode, where)
        return found.select("qid", "rank", "doc_id", _r("score"), "chunk_id", "start", "end")

    return run


def _reranked(mode: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = search.rerank(c.collection(s, d, vectors=mode != "lexical"), c.queries(s, d), c.wanted(s, d), mode)
        return found.select("qid", "doc_id", _r("score"), "rank")

    return run


def _unknown_last(s: SparkSession, d: str) -> DataFrame:
    found = search.rerank(c.collection(s, d), c.queries(s, d), c.wanted(s, d), "lexical")
    return found.groupBy("qid").agg(F.count_if(F.col("score").isNull()).alias("unknown"), F.min(F.when(F.col("score").isNull(), F.col("rank"))).alias("first_unknown"), F.max(F.when(F.col("score").isNotNull(), F.col("rank"))).alias("last_known"))


def _filter(where: dict) -> Query:
    return lambda s, d: filters.matching(c.docs(s, d), where).select("doc_id")


def _measured(measure: Callable[..., DataFrame], k: int) -> Query:
    return lambda s, d: measure(c.list_ranking(s, d, "lexical"), c.qrels(s, d), k).select("qid", _r("value"))


def _chunked(mode: str) -> Query:
    return lambda s, d: c.chunks(s, d, mode).select(_SPAN)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "hits").select("doc_id", "start", "end").distinct()
    return chunking.resolve(spans, c.docs(s, d)).select("doc_id", "start", "end", F.char_length("text").alias("n"), F.md5("text").alias("text_md5"))


def _contract(s: SparkSession, d: str) -> DataFrame:
    return chunking.contract_violations(c.chunks(s, d), c.docs(s, d), c.MAX_CHARS)


def _task_stats(s: SparkSession, d: str) -> DataFrame:
    judged = c.qrels(s, d).groupBy("qid").agg(F.count("*").alias("judged"), F.count_if(F.col("rel") > 0).alias("relevant"))
    listed = c.wanted(s, d).groupBy("qid").agg(F.count("*").alias("candidates"))
    rows = c.queries(s, d).select("qid").join(judged, "qid").join(listed, "qid", "left")
    return rows.agg(F.count("*").alias("queries"), F.avg("judged").alias("judged"), F.avg("relevant").alias("relevant"), F.avg(F.coalesce("candidates", F.lit(0))).alias("candidates")).select("queries", _r("judged"), _r("relevant"), _r("candidates"))


def _from_index(s: SparkSession, d: str) -> DataFrame:
    """The index end to end: add, delete, put back, compact, search."""
    index = Index(s, scratch(s, "index"), "window", c.MAX_CHARS)
    rows = c.docs(s, d)
    index.add_documents(rows)
    index.delete_documents(rows.where(filters.compile_filter(WHERE)).select("doc_id"))
    index.add_documents(rows)
    index.compact()
    found = index.search(c.queries(s, d), 10, "lexical")
    return found.select("qid", "rank", "doc_id", _r("score"), "chunk_id", "start", "end")


def _index(s: SparkSession, d: str) -> Index:
    index = Index(s, scratch(s, "index"), "window", c.MAX_CHARS)
    index.add_documents(c.docs(s, d))
    return index


def _stored_stats(s: SparkSession, d: str) -> DataFrame:
    """What an index says of itself after metadata were changed and some documents put in again."""
    index = _index(s, d)
    some = c.docs(s, d).where(filters.compile_filter(WHERE))
    index.update_metadata(some.select("doc_id", F.lit('{"seen": true}').alias("meta")))
    index.add_documents(some)
    seen = index.table("docs").agg(F.count_if(F.get_json_object("meta", "$.seen") == "true").alias("seen"))
    return index.stats().join(seen).select("documents", "chunks", "terms", "postings", "dim", "chunk_mode", F.lit(index.max_ordinal()).alias("max_ordinal"), F.lit(index.n_chunks).alias("n_chunks"), "seen")


def _with_reranker(s: SparkSession, d: str) -> search.Collection:
    return replace(c.collection(s, d, vectors=True), reranker=search.ngram_reranker())


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        # text
        "canonicalize": lambda s, d: table(s, d, "docs").where("text is not null").select("doc_ord", F.md5(tx.canonicalize("text")).alias("text_md5"), F.char_length(tx.canonicalize("text")).alias("n")),
        "tokenize": lambda s, d: c.docs(s, d).select("doc_id", F.posexplode(tx.tokens("text")).alias("pos", "term")),
        "token_counts": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.size(tx.tokens("text")).alias("n_tokens"), F.size(F.array_distinct(tx.tokens("text"))).alias("n_terms")),
        "strip_html": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.md5(tx.strip_html("text")).alias("text_md5"), F.char_length(tx.strip_html("text")).alias("n")),
        "doc_char_cap": lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.char_length(tx.char_cap("text", 32000)).alias("n"), (F.char_length("text") > 32000).alias("cut")),
        "hit_preview": lambda s, d: table(s, d, "chunks").where("text is not null").select("chunk_id", tx.preview("text").alias("preview")).distinct(),
        # chunking
        "chunk_document": _chunked("document"),
        "chunk_hard_window": _chunked("hard"),
        "chunk_paragraph": _chunked("paragraph"),
        "chunk_window": _chunked("window"),
        "chunk_structure": _chunked("structure"),
        "chunk_contract": _contract,
        "chunk_gaps": lambda s, d: chunking.gaps(c.chunks(s, d)),
        "resolve_offsets": _resolved,
        # index
        "term_freq": lambda s, d: lexical.term_freq(c.chunks(s, d)),
        "doc_freq": lambda s, d: lexical.doc_freq(lexical.term_freq(c.chunks(s, d))),
        "corpus_stats": lambda s, d: lexical.corpus_stats(c.chunks(s, d)).select("n", _r("avgdl")),
        "idf": _idf,
        "bm25_postings": lambda s, d: lexical.postings(c.chunks(s, d), lexical.query_terms(c.queries(s, d))).select("term", "slot", "tf", "dl"),
        "index_stats": _stats,
        "join_chunks_docs": lambda s, d: table(s, d, "chunks").select("chunk_id", "doc_id", "start", "end").distinct().join(c.docs(s, d).select("doc_id", "doc_ord"), "doc_id"),
        # lexical
        "bm25_scores": _scores,
        "bm25_topk": lambda s, d: lexical.bm25_topk(_staged_chunks(s, d), c.queries(s, d), 100).select("qid", "slot", _r("score"), "rank"),
        "bm25_topk_padded": _padded,
        "search_lexical": _searched("lexical"),
        # dense
        "l2_normalize": lambda s, d: c.vectors(s, d).select("vec_id", F.posexplode(dense.l2_normalize(F.transform("v", lambda x: x * F.lit(3.0)))).alias("i", "x")).select("vec_id", "i", _r("x")),
        "dense_scores": lambda s, d: dense.scores(c.vectors(s, d), c.vector_queries(s, d), "vec_id").select("qid", "vec_id", _r("score")),
        "dense_topk": lambda s, d: dense.topk(c.vectors(s, d), c.vector_queries(s, d), 10, "vec_id"),
        "search_dense": _searched("dense"),
        # fusion
        "rrf_fuse": lambda s, d: fusion.rrf(c.lists(s, d), "chunk_id").select("qid", "chunk_id", _r("score", 9)),
        "rrf_weighted": lambda s, d: fusion.rrf(c.lists(s, d), "chunk_id", 60, SOURCE_WEIGHTS).select("qid", "chunk_id", _r("score", 9)),
        "doc_maxpool": lambda s, d: fusion.pool_documents(fusion.rrf(c.lists(s, d), ["chunk_id", "doc_id"]), "chunk_id").select("qid", "doc_id", "chunk_id", _r("score")),
        "search_hybrid": _searched("hybrid"),
        "search_chunks": lambda s, d: search.search_chunks(c.collection(s, d, vectors=True), c.queries(s, d), 10).select("qid", "rank", "chunk_id", _r("score"), "start", "end"),
        "retrieve_ranking": lambda s, d: search.retrieve_ranking(c.collection(s, d), c.queries(s, d), 100, "lexical"),
        # rerank
        "score_documents": lambda s, d: search.score_documents(c.collection(s, d), c.queries(s, d), c.wanted(s, d)).select("qid", "doc_id", _r("score")),
        "rerank_lexical": _reranked("lexical"),
        "rerank_dense": _reranked("dense"),
        "rerank_hybrid": _reranked("hybrid"),
        "rerank_unknown_last": _unknown_last,
        "filtered_search": _searched("lexical", WHERE),
        "json_filter": lambda s, d: table(s, d, "events").where(filters.compile_filter({"k": {"$gte": 50}}, "props")).select("event_id"),
        "search_hybrid_rerank": lambda s, d: search.search(_with_reranker(s, d), c.queries(s, d), 10, "hybrid_rerank").select("qid", "rank", "doc_id", _r("score"), "chunk_id"),
        "rerank_ngram": lambda s, d: search.rerank(_with_reranker(s, d), c.queries(s, d), c.wanted(s, d), "rerank").select("qid", "doc_id", _r("score"), "rank"),
        "index_search": _from_index,
        "index_documents": lambda s, d: _index(s, d).document_ids(),
        "index_chunks": lambda s, d: _index(s, d).scan_chunks(),
        "index_stored_stats": _stored_stats,
        # evaluation
        "task_stats": _task_stats,
        "eval_reranking": lambda s, d: evaluate.evaluate_reranking(c.list_ranking(s, d, "lexical"), c.qrels(s, d)).select("metric", "queries", _r("value")),
        "task_queries": lambda s, d: c.queries(s, d).join(c.qrels(s, d).select("qid").distinct(), "qid", "left_semi"),
        "task_candidates": lambda s, d: c.wanted(s, d).join(c.queries(s, d), "qid", "left_semi").join(c.qrels(s, d).select("qid").distinct(), "qid", "left_semi"),
        "eval_ndcg": _measured(evaluate.ndcg, 10),
        "eval_recall": _measured(evaluate.recall, 100),
        "eval_mrr": _measured(evaluate.mrr, 10),
        "eval_map": _measured(evaluate.average_precision, 1000),
        "eval_summary": lambda s, d: evaluate.evaluate(c.list_ranking(s, d, "lexical"), c.qrels(s, d)).select("metric", "queries", _r("value")),
        "latency_percentiles": lambda s, d: evaluate.latency_percentiles(table(s, d, "events"), "event_type", "value").select("event_type", "n", _r("p50"), _r("p95")),
        "leaderboard_pct": _leaderboard,
        "best_experiments": _best_lists,
        # sources and sinks
        "source_delimited": _delimited,
        "source_files": _files,
        "task_judged": lambda s, d: _task(s, d).queries.select("qid", F.md5("text").alias("text_md5")),
        "task_csv_docs": lambda s, d: _csv_task(s, d).docs.select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("n")),
        "task_csv_qrels": lambda s, d: _csv_task(s, d).qrels.select("qid", "doc_id", "rel"),
        "task_json_docs": lambda s, d: _json_task(s, d).docs.select("doc_id", "title", F.md5("text").alias("text_md5")),
        "task_json_qrels": lambda s, d: _json_task(s, d).qrels.select("qid", "doc_id", "rel"),
        "hits_json": _hits_as_json,
        "stream_ingest": _from_stream,
        "assign_metadata": _metadata,
        # changes
        "upsert_docs": _upsert,
        "delete_docs": _delete,
        "update_metadata": _update,
    }
    return found | {name: _filter(where) for name, where in FILTERS.items()}

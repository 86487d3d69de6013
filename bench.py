"""Headline queries over one data folder, as one JSON line.

Every query runs once to warm up and then REPEAT times; the median counts.
``index_build`` writes a persistent index of all documents; the *_indexed
queries answer all queries of the collection from it in one batch.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.index import Index  # noqa: E402
from quarry.plans import corpora, registry  # noqa: E402
from quarry.session import local_session, release  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))
HEADLINES = ("chunk_window", "term_freq", "bm25_topk", "search_lexical", "search_dense", "search_hybrid", "filtered_search", "rerank_hybrid", "dense_topk", "rrf_fuse", "eval_summary", "upsert_docs")


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session("bench", cores=CPUS, **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: q for n, q in registry.queries().items() if n in HEADLINES}
    try:
        from quarry.llm.queries import queries as more

        queries |= {n: q for n, q in more().items() if n.endswith("_found") or n == "p7_ids"}
    except ImportError:
        pass
    seconds: dict[str, float] = {}
    extra: dict[str, float] = {}

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    for name, query in queries.items():
        times = [timed(lambda q=query: sink(q(spark, FOLDER))) for _ in range(1 + REPEAT)][1:]
        seconds[name] = round(statistics.median(times), 3)
        release(spark)
    with tempfile.TemporaryDirectory() as folder:
        docs = corpora.docs(spark, FOLDER)
        n = docs.count()
        index = Index(spark, f"{folder}/index", "window")
        seconds["index_build"] = round(timed(lambda: index.add_documents(docs)), 3)
        extra["index_docs_per_sec"] = round(n / seconds["index_build"], 1)
        asked = corpora.queries(spark, FOLDER).cache()
        many = asked.count()
        one = spark.createDataFrame([asked.first()], asked.schema)
        for mode in ("lexical", "dense", "hybrid"):
            sink(index.search(asked, 10, mode))
            seconds[f"{mode}_indexed"] = round(statistics.median(timed(lambda: sink(index.search(asked, 10, mode))) for _ in range(REPEAT)), 3)
            extra[f"{mode}_ms_per_query"] = round(1000 * seconds[f"{mode}_indexed"] / max(1, many), 2)
            singles = sorted(timed(lambda: index.search(one, 10, mode).collect()) for _ in range(5))
            extra[f"{mode}_one_query_p50_ms"] = round(1000 * singles[len(singles) // 2], 1)
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": int(CPUS), **extra}))


if __name__ == "__main__":
    main()

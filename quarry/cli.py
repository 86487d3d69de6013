"""Command line: index files and answer one query.

    python -m quarry.cli search "query" paths... [-k 5] [--mode hybrid] [--chunk structure] [--json]

The answer is a table of rank, score, document, span and a line of text, or,
with --json, the array that ``sinks.hits_json`` makes. Exit code 2: none of
the paths has a text.
"""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from pyspark.sql import DataFrame

from quarry.demo import shown
from quarry.index import Index
from quarry.operators.chunking import SPLITTERS
from quarry.operators.search import MODES, ngram_reranker
from quarry.session import local_session, release, remove, scratch
from quarry.sources.files import read_files
from quarry.sources.sinks import hits_json

#: Options that are more than a flag: name, default, allowed values, help.
OPTIONS = (
    ("--mode", "hybrid", MODES, "which retrievers are asked"),
    ("--chunk", "structure", tuple(m for m in SPLITTERS if m != "hard"), "how documents are cut"),
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Hybrid document retrieval on Spark.")
    one = top.add_subparsers(dest="command", required=True).add_parser("search", help="one query over files and folders")
    one.add_argument("query")
    one.add_argument("paths", nargs="+", metavar="PATH")
    for name, default, allowed, text in OPTIONS:
        one.add_argument(name, default=default, choices=allowed, help=text)
    for names, default, text in ((("-k",), 5, "documents to show"), (("--max-chunk-chars",), 2500, "longest chunk"), (("--jobs",), 0, "cores; 0: all")):
        one.add_argument(*names, type=int, default=default, help=text)
    for name, text in (("--json", "print JSON"), ("--quiet", "no counts on the error stream")):
        one.add_argument(name, action="store_true", help=text)
    return top


def as_json(hits: DataFrame) -> str:
    """The one query's hits as a JSON array, [] where there are none."""
    row = hits_json(hits).first()
    return json.dumps(json.loads(row.hits if row else "[]"), ensure_ascii=False, indent=2)


def as_table(hits: DataFrame) -> str:
    width = max(40, shutil.get_terminal_size().columns - 60)
    rows = shown(hits, width).orderBy("rank").collect()
    return "\n".join(f"{r['rank']:>3}  {r.score:>8.4f}  {r.span:>13}  {r.doc_id}\n     {r.preview}" for r in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session(cores=args.jobs if args.jobs > 0 else "*")
    spark.sparkContext.setLogLevel("ERROR")
    path = scratch(spark, "cli")
    try:
        with Index(spark, path, args.chunk, args.max_chunk_chars, reranker=ngram_reranker()) as index:
            if not index.add_documents(read_files(spark, args.paths)) and not len(index):
                sys.stderr.write("nothing to search: the paths hold no text files\n")
                return 2
            if not args.quiet and not args.json:
                counts = index.stats().first()
                sys.stderr.write(f"documents: {counts.documents}, chunks: {counts.chunks}, cut by: {counts.chunk_mode}, asked: {args.mode}\n")
            hits = index.search(args.query, args.k, args.mode)
            print(as_json(hits) if args.json else as_table(hits))
            return 0
    finally:
        release(spark)
        remove(spark, path)


if __name__ == "__main__":
    raise SystemExit(main())

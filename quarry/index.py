"""A persistent index: Parquet parts and a manifest of the current ones.

Every change writes one part with just what is new: ``docs``, ``chunks``,
``vectors`` and ``postings`` of added documents, ``docs`` alone where only
metadata change, and in ``gone`` the ids whose rows in earlier parts no longer
count. Rows carry the number of their part, so a row is live if no later part
lists its document as gone. The manifest is replaced last, so readers see
whole changes and a failed job leaves the index as it was; of two writers at a
time the later one wins. ``compact`` merges all parts into one.

The manifest holds the options that chunks and vectors depend on; an index is
opened with these, and other ones raise an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import canonicalize
from quarry.operators import chunking, crud, dense, lexical, search
from quarry.operators.lexical import BM25
from quarry.session import numbered, ship_package
from quarry.sources.files import from_memory

_TABLES = {
    "docs": "doc_id string, doc_ord bigint, text string, meta string, updated timestamp",
    "chunks": "doc_id string, doc_ord bigint, chunk_ord int, chunk_id string, slot bigint, start int, end int, text string",
    "vectors": "slot bigint, doc_id string, v array<double>",
    "postings": "term string, slot bigint, doc_id string, tf bigint, dl bigint",
}
_TERMS = "term string, df bigint, cf bigint"
_GONE = "doc_id string, part bigint"
#: Bytes of a file that compact writes.
FILE_BYTES = 128 << 20


def _name_of(make: Callable[..., Any]) -> str:
    return getattr(make, "__qualname__", type(make).__qualname__)


class Index:
    """Documents, their chunks, vectors and postings under ``path``. Options
    that are not given are those that the index was made with, or ``structure``,
    2500 and 100 for a new one."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        mode: str | None = None,
        max_chars: int | None = None,
        min_chars: int | None = None,
        encoder: Callable[[], dense.Encoder] = dense.HashingEncoder,
        bm25: BM25 = BM25(),
        reranker: search.Reranker | None = None,
    ) -> None:
        if mode is not None and mode not in chunking.SPLITTERS:
            raise ValueError(f"unknown chunk mode: {mode!r}")
        ship_package(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.encoder, self.bm25, self.reranker = encoder, bm25, reranker
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        asked = {"mode": mode, "max_chars": max_chars, "min_chars": min_chars, "encoder": _name_of(encoder), "tokenizer": bm25.tokenizer}
        held = self._manifest().get("options", {})
        for name, value in asked.items():
            if held and value is not None and value != held[name]:
                raise ValueError(f"the index was made with {name}={held[name]!r}, not {value!r}")
        defaults = {"mode": "structure", "max_chars": 2500, "min_chars": 100}
        self.options = held or {k: defaults[k] if v is None else v for k, v in asked.items()}
        self.mode, self.max_chars, self.min_chars = (self.options[k] for k in defaults)

    # files

    def _at(self, *parts: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _manifest(self) -> dict:
        """options, parts (number, folder, tables, gone: tables in which it has
        ids gone) and the next number and doc_ord; empty for a new index."""
        if not self._fs.exists(self._at("CURRENT")):
            return {}
        stream = self._fs.open(self._at("CURRENT"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        """Put the manifest in place by a rename: there is always a whole one."""
        draft = self._at(f"CURRENT.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if self._fs.getScheme() != "file" else self._jvm.java.net.URI("file:///"))
        array = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(context.makeQualified(draft), context.makeQualified(self._at("CURRENT")), array)

    def _parts(self, manifest: dict, name: str) -> list[dict]:
        """The parts that count for a table: from the last on that holds it whole."""
        parts = manifest.get("parts", [])
        whole = [i for i, p in enumerate(parts) if name in p["whole"]]
        return parts[whole[-1] :] if whole else parts

    def _paths(self, parts: Iterable[dict], name: str) -> list[str]:
        return [self._at(p["folder"], name).toString() for p in parts]

    def table(self, name: str) -> DataFrame:
        """The live rows of docs, chunks, vectors or postings."""
        parts = self._parts(self._manifest(), name)
        own = [p for p in parts if name in p["tables"]]
        if not own:
            return self.spark.createDataFrame([], _TABLES[name])
        rows = self.spark.read.schema(_TABLES[name] + ", part bigint").parquet(*self._paths(own, name))
        gone = [p for p in parts if name in p["gone"]]
        if gone:
            last = self.spark.read.schema(_GONE).parquet(*self._paths(gone, "gone")).groupBy("doc_id").agg(F.max("part").alias("_gone"))
            rows = rows.join(last.withColumnRenamed("doc_id", "_id"), (F.col("doc_id") == F.col("_id")) & (F.col("part") < F.col("_gone")), "left_anti")
        return rows.drop("part")

    def _write(self, tables: Mapping[str, DataFrame], gone: DataFrame | None = None, gone_from: Iterable[str] = (), whole: Iterable[str] = (), instead: bool = False) -> None:
        """One more part, or with ``instead`` one for all. gone: (doc_id) whose
        rows in earlier parts of the tables gone_from no longer count. whole:
        tables of which no earlier part counts any more."""
        manifest = self._manifest() or {"options": self.options, "next": 0, "doc_ord": 0, "parts": []}
        number, folder = manifest["next"], f"p-{uuid.uuid4().hex}"
        part: dict[str, Any] = {"number": number, "folder": folder, "tables": sorted(tables), "gone": sorted(gone_from) if gone is not None else [], "whole": sorted(whole)}
        for name, df in tables.items():
            out = df.sort("term") if name == "postings" else df  # equal terms together: row groups of other terms are skipped
            out.withColumn("part", F.lit(number).cast("bigint")).write.option("compression", "zstd").parquet(self._at(folder, name).toString())
        if "postings" in tables:
            written = self.spark.read.schema(_TABLES["postings"]).parquet(self._at(folder, "postings").toString())
            written.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(self._at(folder, "terms").toString())
            part["tokens"] = self.spark.read.schema(_TERMS).parquet(self._at(folder, "terms").toString()).agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
        if "chunks" in tables:
            part["chunks"] = self.spark.read.schema(_TABLES["chunks"]).parquet(self._at(folder, "chunks").toString()).count()
        if gone is not None:
            gone.select("doc_id", F.lit(number).cast("bigint").alias("part")).write.parquet(self._at(folder, "gone").toString())
        top = self.spark.read.schema(_TABLES["docs"]).parquet(self._at(folder, "docs").toString()).agg(F.max("doc_ord")).first()[0] if "docs" in tables else None
        following = manifest["doc_ord"] if top is None else max(manifest["doc_ord"], top + 1)
        self._put(manifest | {"next": number + 1, "doc_ord": following, "parts": [part] if instead else [*manifest["parts"], part]})

    def _known(self) -> lexical.Known | None:
        """Counts of terms and lengths as stored, while no row of theirs is gone."""
        manifest = self._manifest()
        parts, chunks = self._parts(manifest, "postings"), self._parts(manifest, "chunks")
        own = [p for p in parts if "postings" in p["tables"]]
        if not own or any("postings" in p["gone"] for p in parts[1:]) or any("chunks" in p["gone"] for p in chunks[1:]):
            return None
        n, tokens = sum(p.get("chunks", 0) for p in chunks), sum(p["tokens"] for p in own)
        terms = self.spark.read.schema(_TERMS).parquet(*self._paths(own, "terms"))
        terms = terms.select("term", "df") if len(own) == 1 else terms.groupBy("term").agg(F.sum("df").alias("df"))
        return lexical.Known(n, tokens / n if n else 0.0, terms)

    # changes

    def _analysed(self, docs: DataFrame) -> dict[str, DataFrame]:
        chunks = chunking.chunk(docs, self.mode, self.max_chars, self.min_chars)
        chunks = chunks.select([f.name for f in self.spark.createDataFrame([], _TABLES["chunks"]).schema])
        return {
            "chunks": chunks,
            "vectors": dense.encode(chunks.select("slot", "doc_id", "text"), self.encoder).select("slot", "doc_id", "v"),
            "postings": lexical.postings(chunks, tokenizer=self.bm25.tokenizer),
        }

    def _present(self, ids: DataFrame) -> DataFrame | None:
        """Those of ids(doc_id) that the index has, None where it has none."""
        known = self.table("docs").select("doc_id").join(ids.select("doc_id"), "doc_id", "left_semi")
        return None if known.isEmpty() else known

    def add_documents(self, docs: DataFrame | Mapping[object, str | None] | Iterable, metadata: Mapping[str, Any] | DataFrame | None = None) -> int:
        """Put documents in, over those of the same id, and return the number
        of their chunks. docs: (doc_id, text, doc_ord?, meta?) or what
        ``from_memory`` takes. Null texts are left out; empty ones are kept
        without chunks; of repeated ids the last counts. metadata: one mapping
        for all documents, or a table (doc_id, meta)."""
        new = docs if isinstance(docs, DataFrame) else from_memory(self.spark, docs)
        new = new.withColumn("doc_id", F.col("doc_id").cast("string")).where("doc_id is not null and text is not null")
        if "doc_ord" not in new.columns:
            new = new.withColumn("doc_ord", F.lit(0).cast("bigint"))
        if metadata is not None:
            by_doc = metadata if isinstance(metadata, DataFrame) else None
            new = crud.assign_metadata(new, by_doc, None if by_doc is not None else json.dumps(dict(metadata), ensure_ascii=False))
        elif "meta" not in new.columns:
            new = new.withColumn("meta", F.lit("{}"))
        # the last of equal ids by doc_ord, then as the rows come
        new = crud.latest(new.withColumn("_come", F.struct("doc_ord", F.monotonically_increasing_id())), "doc_id", "_come")
        rows = new.select("doc_id", "doc_ord", canonicalize("text").alias("text"), F.coalesce("meta", F.lit("{}")).alias("meta"), F.current_timestamp().alias("updated"))
        # positions follow those in the index without gaps
        draft = self._at(f"in-{uuid.uuid4().hex}")
        try:
            held = rows.withColumnRenamed("doc_ord", "_came")
            rows = numbered(held, ["_came", "doc_id"], "doc_ord", self._manifest().get("doc_ord", 0), draft.toString()).select("doc_id", "doc_ord", "text", "meta", "updated")
            if rows.isEmpty():
                return 0
            self._write({"docs": rows, **self._analysed(rows)}, self._present(rows), _TABLES)
            return self._manifest()["parts"][-1]["chunks"]
        finally:
            self._fs.delete(draft, True)

    def delete_documents(self, ids: DataFrame | Iterable[str]) -> int:
        """Take documents out; returns how many were there."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], "doc_id string")
        known = self._present(gone)
        if known is None:
            return 0
        self._write({}, known, _TABLES)
        newest = self._manifest()["parts"][-1]["folder"]
        return self.spark.read.schema(_GONE).parquet(self._at(newest, "gone").toString()).count()

    def update_metadata(self, changes: Mapping[str, Mapping[str, Any]] | DataFrame, merge: bool = True) -> int:
        """Merge or replace metadata; texts are not cut or encoded again, only
        rows of ``docs`` are written. Returns how many documents were there."""
        told = changes if isinstance(changes, DataFrame) else self.spark.createDataFrame([(str(k), json.dumps(dict(v), ensure_ascii=False)) for k, v in changes.items()], "doc_id string, meta string")
        old = self.table("docs").join(told.select("doc_id"), "doc_id", "left_semi")
        found = old.count()
        if found:
            self._write({"docs": crud.update_metadata(old, told, merge)}, old, ("docs",))
        return found

    def finalize(self) -> int:
        """Count the postings of all live chunks anew, as one table sorted by
        term; returns the number of chunks. Searches need no such step: adding
        documents counts theirs. It saves them the reading of many parts."""
        if not self._manifest():
            return 0
        self._write({"postings": lexical.postings(self.table("chunks"), tokenizer=self.bm25.tokenizer)}, whole=("postings",))
        return self.n_chunks

    def compact(self) -> int:
        """Merge all parts into one, in files of about FILE_BYTES, and remove
        the old ones; returns the number of chunks. Readers of older parts
        must have ended."""
        manifest = self._manifest()
        if not manifest:
            return 0
        whole = {}
        for name in _TABLES:
            paths = [self._at(p["folder"], name) for p in self._parts(manifest, name) if name in p["tables"]]
            size = sum(self._fs.getContentSummary(p).getLength() for p in paths)
            whole[name] = self.table(name).coalesce(max(1, -(-size // FILE_BYTES)))
        self._write(whole, instead=True)
        current = self._manifest()["parts"][0]["folder"]
        for status in self._fs.listStatus(self._at()):
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith("p-") and name != current:
                self._fs.delete(status.getPath(), True)
        return self.n_chunks

    def flush(self) -> None:
        """Nothing waits: every change is written before its call returns."""

    def close(self) -> None:
        """An index holds no open file; it can be used or opened again."""

    # reading

    def get_document(self, doc_id: str) -> tuple[str, dict] | None:
        row = self.table("docs").where(F.col("doc_id") == doc_id).select("text", "meta").first()
        return None if row is None else (row.text, json.loads(row.meta or "{}"))

    def has_document(self, doc_id: str) -> bool:
        return not self.table("docs").where(F.col("doc_id") == doc_id).isEmpty()

    def text_of(self, doc_id: str) -> str:
        """The canonical text that offsets count in. KeyError where there is no such document."""
        found = self.get_document(doc_id)
        if found is None:
            raise KeyError(doc_id)
        return found[0]

    def document_ids(self) -> DataFrame:
        """(doc_ord, doc_id) in the order of arrival, sorted over all partitions."""
        return self.table("docs").select("doc_ord", "doc_id").orderBy("doc_ord")

    def scan_chunks(self) -> DataFrame:
        """All chunks in the order of their slots, without their texts."""
        return self.table("chunks").select("slot", "chunk_id", "doc_id", "doc_ord", "start", "end").orderBy("slot")

    def max_ordinal(self) -> int:
        """The greatest doc_ord of a live document, -1 where there is none."""
        top = self.table("docs").agg(F.max("doc_ord")).first()[0]
        return -1 if top is None else top

    def chunks_of(self, doc_id: str) -> DataFrame:
        return self.table("chunks").where(F.col("doc_id") == doc_id).orderBy("chunk_ord")

    def collection(self) -> search.Collection:
        return search.Collection(self.table("chunks"), self.table("docs"), self.table("vectors"), self.encoder, bm25=self.bm25, reranker=self.reranker, stored_postings=self.table("postings"), known=self._known())

    def _queries(self, queries: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([("q", queries)], "qid string, text string") if isinstance(queries, str) else queries

    def search(self, queries: DataFrame | str, top_k: int = 10, mode: str = "hybrid", where: Mapping[str, Any] | None = None) -> DataFrame:
        return search.search(self.collection(), self._queries(queries), top_k, mode, where)

    def search_chunks(self, queries: DataFrame | str, top_k: int = 10, mode: str = "hybrid", where: Mapping[str, Any] | None = None) -> DataFrame:
        return search.search_chunks(self.collection(), self._queries(queries), top_k, mode, where)

    def retrieve_ranking(self, queries: DataFrame | str, depth: int = 100, mode: str = "hybrid", where: Mapping[str, Any] | None = None) -> DataFrame:
        return search.retrieve_ranking(self.collection(), self._queries(queries), depth, mode, where)

    def rerank(self, queries: DataFrame | str, wanted: DataFrame, mode: str = "lexical", top_k: int | None = None) -> DataFrame:
        return search.rerank(self.collection(), self._queries(queries), wanted, mode, top_k)

    def stats(self) -> DataFrame:
        """One row: documents, chunks, terms, postings, dim, bytes, mode."""
        size = sum(self._fs.getContentSummary(self._at(p["folder"])).getLength() for p in self._manifest().get("parts", ()))
        counts = self.table("docs").agg(F.count("*").alias("documents")).join(self.table("chunks").agg(F.count("*").alias("chunks")))
        terms = self.table("postings").agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"))
        dim = self.table("vectors").agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"))
        return counts.join(terms).join(dim).withColumn("bytes", F.lit(size)).withColumn("chunk_mode", F.lit(self.mode))

    def __len__(self) -> int:
        return self.table("docs").count()

    @property
    def n_chunks(self) -> int:
        return self.table("chunks").count()

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

"""Documents from text files, delimited texts and in-memory collections."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.functions.text import WHITE_SPACE
from quarry.session import numbered

#: Endings of files that are taken from folders; files named themselves may have any.
TEXT_SUFFIXES = (".txt", ".md", ".json", ".csv", ".html", ".xml", ".rst")
_DOCS = "doc_id string, doc_ord bigint, text string"


def from_memory(spark: SparkSession, docs: Mapping[object, str | None] | Iterable) -> DataFrame:
    """(doc_id, doc_ord, text) of a mapping, of (id, text) pairs or of texts,
    whose ids are then their positions. Null texts are left out; of repeated
    ids the last counts."""
    pairs = docs.items() if isinstance(docs, Mapping) else (x if isinstance(x, tuple) else (i, x) for i, x in enumerate(docs))
    last: dict[str, tuple[int, str]] = {}
    for order, (key, text) in enumerate(pairs):
        if text is not None:
            last[str(key)] = (order, str(text))
    return spark.createDataFrame([(k, o, t) for k, (o, t) in last.items()], _DOCS)


def read_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(doc_id, doc_ord, text): whole files, doc_id being the path. Bytes that
    are no UTF-8 become replacement characters; contents are not parsed.
    doc_ord follows the order of paths. Paths that do not exist are left out."""
    from pathlib import Path

    folders, single = [], []
    for p in map(Path, paths):
        (folders if p.is_dir() else single).append(str(p)) if p.exists() else None
    parts = []
    if folders:
        every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        ending = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
        parts.append(every.where(ending.isin(*TEXT_SUFFIXES)))
    if single:
        parts.append(spark.read.format("binaryFile").load(single))
    if not parts:
        return spark.createDataFrame([], _DOCS)
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    path = F.regexp_replace(F.try_url_decode("path"), "^file:/+", "/")
    rows = files.select(path.alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).dropDuplicates(["doc_id"])
    return numbered(rows, ["doc_id"], "doc_ord").select("doc_id", "doc_ord", "text")


def _sections(text: str) -> list[dict]:
    """The sections of one text, in the order in which their names first occur."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    found: dict[str, list[str]] = {}
    own: list[str] | None = None
    for line in lines:
        bare = line.strip(WHITE_SPACE)
        if bare.startswith("===") and bare.endswith("==="):
            name = bare.strip("= ").strip(WHITE_SPACE) or f"doc{len(found)}"
            own = []
            found[name] = own  # a name keeps its first place, its last lines count
        elif own is not None:
            own.append(line)
    bodies = {k: "\n".join(v).strip(WHITE_SPACE) for k, v in found.items()} if found else {"documento": "\n".join(lines).strip(WHITE_SPACE)}
    return [{"doc_id": k, "doc_ord": i, "text": v} for i, (k, v) in enumerate(bodies.items()) if v]


def split_delimited(blobs: DataFrame, blob: str = "text", key: str | None = None) -> DataFrame:
    """(key, doc_id, doc_ord, text): sections of texts that ``=== name ===``
    lines part, each text by itself. Text before the first header is dropped;
    without any header the whole text is one document, 'documento'. A header
    without a name is 'doc' and the number of different names before it; of
    repeated names the last counts, at the place of the first. Empty sections
    are dropped. One narrow stage, one pass over each text."""

    @arrow_udf("array<struct<doc_id: string, doc_ord: bigint, text: string>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("doc_id", pa.string()), ("doc_ord", pa.int64()), ("text", pa.string())]))
        for texts in batches:
            yield pa.array([_sections(t) if t else [] for t in texts.to_pylist()], kind)

    keep = [key] if key else []
    return blobs.select(*keep, F.explode(split.asNondeterministic()(F.col(blob))).alias("_s")).select(*keep, "_s.doc_id", "_s.doc_ord", "_s.text")

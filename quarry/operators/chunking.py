"""Splitting documents into chunks whose offsets are exact.

Offsets count code points of the canonical text (CRLF and CR are LF), chunk
texts are exact substrings, chunks of a document do not overlap, and only
white space lies between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.functions.text import WHITE_SPACE, canonicalize

Span = tuple[int, int]
Splitter = Callable[[str, int, int], list[Span]]
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

#: Chunks of a document take consecutive slots from doc_ord * SLOTS.
SLOTS = 1 << 20


def _stripped(text: str, start: int, end: int) -> Span | None:
    while start < end and text[start] in WHITE_SPACE:
        start += 1
    while end > start and text[end - 1] in WHITE_SPACE:
        end -= 1
    return (start, end) if end > start else None


def _words(text: str, start: int, end: int, most: int) -> Iterator[Span]:
    """[start, end) in stretches of ``most`` at most, ended at the last plain
    space unless that lies in the first half; the space opens the next stretch."""
    at = start
    while end - at > most:
        cut = text.rfind(" ", at, at + most) - at
        if cut < most // 2:
            cut = most
        if span := _stripped(text, at, at + cut):
            yield span
        at += cut
    if span := _stripped(text, at, end):
        yield span


def split_document(text: str, most: int, least: int) -> list[Span]:
    """The whole text without white space at its ends, whatever its size."""
    span = _stripped(text, 0, len(text))
    return [span] if span else []


def split_window(text: str, most: int, least: int) -> list[Span]:
    return list(_words(text, 0, len(text), most))


def split_paragraph(text: str, most: int, least: int) -> list[Span]:
    """Paragraphs end at blank lines and are not joined; without any, the whole text."""
    out: list[Span] = []
    at = 0
    for part in text.split("\n\n"):
        if part.strip():
            out += _words(text, at, at + len(part), most)
        at += len(part) + 2
    return out


def split_hard(text: str, most: int, least: int) -> list[Span]:
    """Slices of ``most`` characters, nothing stripped."""
    return [(a, min(a + most, len(text))) for a in range(0, len(text), most)]


def split_structure(text: str, most: int, least: int) -> list[Span]:
    """Paragraphs joined up to ``most`` characters, headings and short ones
    with what follows until ``least`` is reached; oversized ones by words."""
    out: list[Span] = []
    held: Span | None = None
    at = 0
    for part in text.split("\n\n"):
        span = _stripped(text, at, at + len(part))
        at += len(part) + 2
        if span is None:
            continue
        if held and span[1] - held[0] <= most and (held[1] - held[0] < least or span[1] - span[0] < least):
            held = (held[0], span[1])
            continue
        if held:
            out += _words(text, *held, most)
        held = span
    if held:
        out += _words(text, *held, most)
    return out


#: Names of the built-in modes; 'none' is 'window', 'structure' is the default.
SPLITTERS: dict[str, Splitter] = {
    "structure": split_structure,
    "window": split_window,
    "none": split_window,
    "paragraph": split_paragraph,
    "document": split_document,
    "hard": split_hard,
}


def spans(text: Column | str, mode: str | Splitter = "structure", max_chars: int = 2500, min_chars: int = 100) -> Column:
    """array<struct<start int, end int>> of a canonical text; null and empty
    texts have none. ``mode`` may be a function of the same kind as the
    built-in ones; its spans are taken in order, empty ones are dropped."""
    if max_chars < 2:
        raise ValueError("max_chars must be 2 or more")
    if isinstance(mode, str) and mode not in SPLITTERS:
        raise ValueError(f"unknown chunk mode: {mode!r}")
    splitter = SPLITTERS[mode] if isinstance(mode, str) else mode

    @arrow_udf("array<struct<start: int, end: int>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [splitter(t, max_chars, min_chars) if t else [] for t in texts.to_pylist()]
            yield pa.array([[{"start": a, "end": b} for a, b in r if b > a] for r in rows], SPANS)

    # not deterministic for the planner: else it would split each text twice, once to filter out those without spans
    return split.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def chunk(docs: DataFrame, mode: str | Splitter = "structure", max_chars: int = 2500, min_chars: int = 100) -> DataFrame:
    """(doc_id, doc_ord, chunk_ord, chunk_id, slot, start, end, text): chunks of
    docs(doc_id, doc_ord, text). One narrow stage; documents without text keep
    no row."""
    cut = docs.select("doc_id", "doc_ord", canonicalize("text").alias("_t")).withColumn("_spans", spans("_t", mode, max_chars, min_chars))
    rows = cut.select("doc_id", "doc_ord", "_t", F.posexplode("_spans").alias("chunk_ord", "_s"))
    return rows.select(
        "doc_id",
        "doc_ord",
        "chunk_ord",
        F.concat_ws("#", F.col("doc_id").cast("string"), "chunk_ord").alias("chunk_id"),
        F.when(F.col("chunk_ord") < SLOTS, F.col("doc_ord") * SLOTS + F.col("chunk_ord")).otherwise(F.raise_error(F.lit(f"a document has more than {SLOTS} chunks"))).alias("slot"),
        F.col("_s.start").alias("start"),
        F.col("_s.end").alias("end"),
        F.substring("_t", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("text"),
    )


def resolve(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits(doc_id, start, end, ...) with the text they point at. A hit without
    offsets has no text (null); neither has one of an unknown document."""
    texts = docs.select("doc_id", canonicalize("text").alias("_t"))
    return hits.drop("text").join(texts, "doc_id", "left").withColumn("text", F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_t")


def contract_violations(chunks: DataFrame, docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(rule, violations): the contract of this module, counted over all chunks."""
    texts = docs.select("doc_id", canonicalize("text").alias("_t"))
    order = Window.partitionBy("doc_id").orderBy("chunk_ord")
    rows = chunks.select("doc_id", "chunk_ord", "start", "end", "text").withColumn("_before", F.coalesce(F.lag("end").over(order), F.lit(0))).join(texts, "doc_id", "left")
    gap = F.trim(F.substring("_t", F.col("_before") + 1, F.col("start") - F.col("_before")), F.lit(WHITE_SPACE))
    rules = {
        "not_a_substring": ~F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start")).eqNullSafe(F.col("text")),
        "overlap": F.col("start") < F.col("_before"),
        "text_lost": F.char_length(gap) > 0,
        "too_long": F.lit(False) if max_chars is None else F.col("end") - F.col("start") > max_chars,
    }
    counted = rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))


def gaps(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ord, gap): characters between a chunk and the one before it."""
    order = Window.partitionBy("doc_id").orderBy("chunk_ord")
    return chunks.select("doc_id", "chunk_ord", "start", F.lag("end").over(order).alias("_before")).where("_before is not null").select("doc_id", "chunk_ord", (F.col("start") - F.col("_before")).alias("gap"))

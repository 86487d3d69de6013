"""Splitting oversized texts at natural boundaries, and an audit of stored pieces.

Method: lexical-cohesion segmentation. At every natural boundary the terms of
a block before it are compared with those of a block after it; valleys of this
similarity mark changes of topic. A piece ends at the deepest valley within
its size window, and the next piece starts some characters earlier, at the
start of a sentence or word.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm.forms import current_rows

_WORDS = re.compile(r"[^\W_]{4,}")
_NATURAL = re.compile(r"(?:[.!?;:…]+[\"'»”)\]]*(?=\s))|(?=\n|\r)")
_SPACE = re.compile(r"\s")
_START = re.compile(r"(?<=\s)\S")
_SENTENCE_START = re.compile(r"(?:[.!?;:…]+[\"'»”)\]]*\s+|[\r\n]\s*)(\S)")


@dataclass(frozen=True)
class Limits:
    """Sizes in characters. Overlaps lie in [overlap_min, overlap_max]; block: terms compared on each side."""

    limit: int = 1200
    overlap_min: int = 80
    overlap_max: int = 160
    block: int = 40

    def __post_init__(self) -> None:
        if not 0 <= self.overlap_min <= self.overlap_max or self.limit < 2 * self.overlap_max + 2:
            raise ValueError("the limit must be more than twice the greatest overlap")


class _Cohesion:
    """Depth of the similarity valley at natural boundaries of one text."""

    def __init__(self, text: str, block: int) -> None:
        found = list(_WORDS.finditer(text))
        self.words = [m.group().lower() for m in found]
        self.starts = [m.start() for m in found]
        self.block = block
        self.ends = sorted({m.end() for m in _NATURAL.finditer(text) if 0 < m.end() < len(text)})
        similar = [self._similarity(e) for e in self.ends]
        self.depths = [self._depth(similar, k) for k in range(len(similar))]

    def _similarity(self, end: int) -> float:
        at = bisect_left(self.starts, end)
        left, right = Counter(self.words[max(0, at - self.block) : at]), Counter(self.words[at : at + self.block])
        if not left or not right:
            return 0.0
        small, large = (left, right) if len(left) < len(right) else (right, left)
        both = sum(n * large[w] for w, n in small.items() if w in large)
        return both / (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5

    @staticmethod
    def _depth(similar: list[float], k: int, reach: int = 8) -> float:
        here, depth = similar[k], 0.0
        for step in (-1, 1):
            peak, j = here, k + step
            while 0 <= j < len(similar) and abs(j - k) <= reach and similar[j] >= peak:
                peak = similar[j]
                j += step
            depth += peak - here
        return depth

    def deepest(self, low: int, high: int) -> int | None:
        """The end in [low, high] of the deepest valley; of equal ones the last."""
        i, j = bisect_left(self.ends, low), bisect_right(self.ends, high)
        if i == j:
            return None
        return self.ends[max(range(i, j), key=lambda k: (self.depths[k], k))]


def _last_space(text: str, low: int, high: int) -> int | None:
    """The last end in [low, high] that stands before a space."""
    for e in range(min(high, len(text) - 1), low - 1, -1):
        if text[e].isspace():
            return e
    return None


def _natural_end(text: str, cohesion: _Cohesion, low: int, high: int) -> int | None:
    """The end in [low, high] at the deepest valley, without one before the last space, without that none."""
    return cohesion.deepest(low, high) or _last_space(text, low, high)


def _hard_end(text: str, low: int, high: int) -> int:
    """high, or a little before where a mark, joiner or line end would be torn off."""
    e = high
    while e > low and (unicodedata.combining(text[e]) or text[e] in "‍️" or text[e - 1] == "‍" or text[e - 1 : e + 1] == "\r\n"):
        e -= 1
    return e if e > low else high


def split_text(text: str | None, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text. None and "" give none; a text
    within the limit is one piece. Pieces cover the text without a gap."""
    n = len(text or "")
    if n <= limits.limit:
        return [(0, n)] if n else []
    cohesion = _Cohesion(text, limits.block)
    pieces, start = [], 0
    while n - start > limits.limit:
        low, high = start + (limits.limit + 1) // 2, start + limits.limit
        end = _natural_end(text, cohesion, low, high) or _hard_end(text, low, high)
        pieces.append((start, end))
        start = _next_start(text, end, limits)
    return [*pieces, (start, n)]


def _next_start(text: str, end: int, limits: Limits) -> int:
    low, high = end - limits.overlap_max, end - limits.overlap_min
    middle = (low + high) // 2
    window = text[max(0, low - 4) : high + 1]
    base = max(0, low - 4)
    for starts in ([m.start(1) + base for m in _SENTENCE_START.finditer(window)], [m.start() + base for m in _START.finditer(window)]):
        fit = [s for s in starts if low <= s <= high]
        if fit:
            return min(fit, key=lambda s: (abs(s - middle), s))
    return middle


def split_records(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, ordinal, start, end): pieces of every current text, each from
    the whole text, in one narrow stage after the choice of current rows.
    Null and empty texts have no piece; ordinals count from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int, int]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, k, s, e) for k, (s, e) in enumerate(split_text(text, limits))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3))], ["doc_id", "ordinal", "start", "end"])

    return current_rows(docs, "text").where("text is not null").mapInArrow(run, "doc_id string, ordinal int, start int, end int")


def coverage(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_chars, first, last, longest_kept, overlaps_kept, pieces_needed):
    the pieces of every record with a text that is not empty. first and last:
    where the first piece starts and the last ends. pieces_needed: whether there
    are at least as many as the limit and the least overlap take."""
    pieces = split_records(docs, limits)
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    overlap = F.lag("end").over(order) - F.col("start")
    rows = pieces.withColumn("_kept", F.coalesce(overlap.between(limits.overlap_min, limits.overlap_max), F.col("ordinal") == 0))
    of = rows.groupBy("doc_id").agg(F.min("start").alias("first"), F.max("end").alias("last"), (F.max(F.col("end") - F.col("start")) <= limits.limit).alias("longest_kept"), F.min("_kept").alias("overlaps_kept"), F.count("*").alias("_n"))
    step = limits.limit - limits.overlap_min
    needed = F.greatest(F.lit(1), F.ceil((F.col("last") - limits.overlap_min) / step))
    return of.select("doc_id", F.col("last").alias("n_chars"), "first", "last", "longest_kept", "overlaps_kept", (F.col("_n") >= needed).alias("pieces_needed"))


def as_chunks(pieces: DataFrame) -> DataFrame:
    """split_records as rows that the audit takes."""
    return pieces.select(F.concat_ws("#", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "start", "end")


def audit_pieces(docs: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(chunk_id, doc_id, start, end, bad_range, too_long, bad_overlap,
    torn_word): each distinct stored piece against the contract of the
    splitter. n is the length of the current text.

    bad_range: start < 0, end <= start or end > n. too_long: over the limit.
    bad_overlap: a piece with the next lower ordinal exists and its end minus
    this start is outside the overlap. torn_word: the cut stands between two
    letters or digits although a space, tab, CR or LF stands in the second
    half. A null start or end is a bad range; a piece without a record has no
    n, and only the rules that need none apply. The ordinal is what follows
    the last '#'; without a number it sorts first. Repeated rows count once.

    Whether a cut could have stood elsewhere is asked of the splitter: within
    the piece's second half it looks for a natural end of its own, the deepest
    valley of cohesion or else the last space. Where it has one, the kinds of
    space that count are checked. Only pieces cut between letters or digits
    are sent to it, not whole texts.
    """

    @arrow_udf("int")
    def better_end(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = []
            for piece in texts.to_pylist():  # with one character more than the piece
                size = len(piece or "") - 1
                ends.append(None if size < 1 else _natural_end(piece, _Cohesion(piece, limits.block), (size + 1) // 2, size - 1))
            yield pa.array(ends, pa.int32())

    pieces = chunks.select("chunk_id", "doc_id", "start", "end").distinct()
    ordinal = F.expr("try_cast(substring_index(chunk_id, '#', -1) as bigint)")
    order = Window.partitionBy("doc_id").orderBy(F.col("ordinal").asc_nulls_first(), "start", "end", "chunk_id")
    placed = pieces.withColumn("ordinal", ordinal).withColumn("before", F.lag("end").over(order)).withColumn("first", F.row_number().over(order) == 1)
    texts = current_rows(docs, "text").where("text is not null").withColumn("n", F.char_length("text"))
    joined = placed.join(texts, "doc_id", "left")
    size = F.col("end") - F.col("start")
    half = F.col("start") + F.floor((size + 1) / 2).cast("int")
    cut = F.substring("text", F.col("end"), F.lit(2))
    inside = (F.col("start") >= 0) & (size > 0) & (F.col("end") > 0) & (F.col("end") < F.col("n")) & cut.rlike(r"^[\p{L}\p{N}]{2}$")
    joined = joined.withColumn("better", better_end(F.when(inside, F.substring("text", F.col("start") + 1, size + 1))))
    torn = inside & F.col("better").isNotNull() & F.substring("text", half + 1, F.col("end") - half).rlike(r"[ \t\r\n]")
    no = F.lit(False)
    return joined.select(
        "chunk_id", "doc_id", "start", "end",
        (F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (size <= 0) | F.coalesce(F.col("end") > F.col("n"), no)).alias("bad_range"),
        F.coalesce(size > limits.limit, no).alias("too_long"),
        (~F.col("first") & ~F.coalesce((F.col("before") - F.col("start")).between(limits.overlap_min, limits.overlap_max), no)).alias("bad_overlap"),
        F.coalesce(torn, no).alias("torn_word"),
    )


def faulty_pieces(docs: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(chunk_id): stored pieces that cannot stay."""
    return audit_pieces(docs, chunks, limits).where("bad_range or too_long or bad_overlap or torn_word").select("chunk_id")

"""One consistent form for texts that look the same.

Method: union-find over strings and code points gives transitive look-alike
classes; in each class a representative is chosen, plain forms first and the
more frequent one among these; an Aho-Corasick automaton over all other
members rewrites texts greedily, leftmost and longest.

Which member is plain is settled by definition (compatibility forms are their
plain equivalents, look-alikes of Latin letters are the Latin letters), so the
frequencies decide only between several plain members of one class.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import BROADCAST_ROWS, spread, staged

# Letters of other alphabets and the Latin letters they look like.
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϳ": "j", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ү": "y",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "Ѵ": "V", "ԍ": "g",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

# Code points without a glyph besides the format characters (Cf), and format characters with one.
INVISIBLE_EXTRA = ("͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ")
INVISIBLE_RANGES = ((0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0xE0000, 0xE007F))
VISIBLE_FORMAT_RANGES = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1345F))


def is_invisible(ch: str) -> bool:
    cp = ord(ch)
    if ch in INVISIBLE_EXTRA or any(lo <= cp <= hi for lo, hi in INVISIBLE_RANGES):
        return True
    return unicodedata.category(ch) == "Cf" and not any(lo <= cp <= hi for lo, hi in VISIBLE_FORMAT_RANGES)


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def _plain(s: str) -> str:
    """The definition's plain equivalent of a short string."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not is_invisible(c))
    return unicodedata.normalize("NFKC", "".join(LOOK_ALIKES.get(c, c) for c in s))


def _invisible_points() -> Iterator[int]:
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) == "Cf" or ch in INVISIBLE_EXTRA:
            if is_invisible(ch):
                yield cp
    for lo, hi in INVISIBLE_RANGES:
        yield from range(lo, hi + 1)


def _changing_points() -> Iterator[int]:
    """Code points that a decomposition changes, Hangul syllables aside."""
    for block in range(0x80, 0x110000, 0x80):
        if 0xD800 <= block <= 0xDFFF or 0xAC00 <= block < 0xD780:
            continue
        if not unicodedata.is_normalized("NFKD", "".join(map(chr, range(block, block + 0x80)))):
            for cp in range(block, block + 0x80):
                if not unicodedata.is_normalized("NFKD", chr(cp)):
                    yield cp


@lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    """All classes with two members or more: code points, and strings of a base and a mark."""
    sets = UnionFind()
    for a, b in LOOK_ALIKES.items():
        sets.union(a, b)
    invisible = set(_invisible_points())
    for cp in sorted(invisible.union(_changing_points())):
        ch = chr(cp)
        if cp in invisible:
            sets.union(ch, "")
            continue
        plain = _plain(ch)
        if plain != ch:
            sets.union(ch, plain)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
            sets.union(parts, plain)
    return tuple(tuple(sorted(c)) for c in sets.classes().values() if len(c) > 1)


class Rewriter:
    """Rewrites texts to their consistent form.

    frequency: occurrences of strings in the collection; it decides between
    several plain members of a class. Without it the lowest code point does.
    """

    def __init__(self, frequency: Mapping[str, int] | None = None) -> None:
        freq = frequency or {}
        self.representative: dict[str, str] = {}
        self._members: dict[str, list[str]] = {}
        singles = []
        for members in look_alike_classes():
            best = min(members, key=lambda m: (_plain(m) != m, -freq.get(m, 0), m))
            for m in members:
                if m != best and m:
                    self.representative[m] = best
                    self._members.setdefault(m[-1], []).append(m)
                    if len(m) == 1:
                        singles.append(ord(m))
        # every astral character is looked at: one range is tested faster than their many
        self._search = re.compile(f"[{_ranges(p for p in {*singles, *_MARKS} if p < 0x10000)}\U00010000-\U0010ffff]").search
        self._marks = re.compile(f"[{_ranges(p for p in _MARKS if p < 0x10000)}\U00010000-\U0010ffff]").search
        self._met: set[str] = set()
        self.automaton = ahocorasick.Automaton()

    def _meet(self, chars: set[str]) -> None:
        """Extend the automaton by the members that end in newly met characters:
        its nodes are searched linearly, so members that never occur cost time."""
        self._met |= chars
        for ch in chars:
            for m in self._members.get(ch, ()):
                self.automaton.add_word(m, (len(m), self.representative[m]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        if text.isascii() or not self._search(text):
            return text
        new = set(text) - self._met
        if new:
            self._meet(new)
        out, at = [], 0
        for end, (length, to) in self.automaton.iter_long(text) if len(self.automaton) else ():
            start = end - length + 1
            if start > at:
                out.append(text[at:start])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        done = "".join(out)
        # stacks of marks, and marks whose base became plain in this pass
        return unicodedata.normalize("NFC", done) if self._marks(done) else done


def _ranges(points: Iterable[int]) -> str:
    parts: list[str] = []
    start = last = None
    for p in [*sorted(points), None]:
        if start is not None and (p is None or p != last + 1):
            parts.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        if p is not None and start is None:
            start = p
        last = p
    return "".join(parts)


def _joining_points() -> Iterator[int]:
    """Characters that compose with the one before though their combining class
    is 0: conjoining Jamo, and second parts of other canonical pairs."""
    for lo, hi in ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF)):
        yield from range(lo, hi + 1)
    for cp in _changing_points():
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and not unicodedata.combining(parts[-1]):
            yield ord(parts[-1])


_MARKS = sorted({*_joining_points(), *(cp for cp in range(0x300, 0x110000) if unicodedata.combining(chr(cp)))})


@lru_cache(maxsize=1)
def rewriter() -> Rewriter:
    """The rewriter with representatives by definition only; one per process."""
    return Rewriter()


def _newest(docs: DataFrame, keep: list[str]) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.col("updated").desc_nulls_last(), F.col("doc_ord").desc_nulls_last())
    return docs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*keep)


def current_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The current row of each doc_id: the one with the greatest ``updated``.

    Rows that tie are equal by definition; of others the latest doc_ord is
    taken. A null ``updated`` counts as the oldest. Rows without doc_id are no
    records and are left out. A current text may be null.

    Texts move only where they must: the ids of several rows are counted
    first, and while these are few, only their rows are shuffled.
    """
    keep = ["doc_id", *columns]
    rows = docs.select(*dict.fromkeys([*keep, "updated", "doc_ord"])).where("doc_id is not null")
    several = staged(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "versions")
    if several.count() > BROADCAST_ROWS:
        return _newest(rows, keep)
    rows = spread(rows)
    told = F.broadcast(several)
    return rows.join(told, "doc_id", "left_anti").select(*keep).unionAll(_newest(rows.join(told, "doc_id", "left_semi"), keep))


def record_ids(docs: DataFrame) -> DataFrame:
    """(doc_id): the records, those with a current text, without reading texts twice or moving them."""
    rows = docs.where("doc_id is not null").select("doc_id", "updated", "doc_ord", F.col("text").isNotNull().alias("_there"))
    return _newest(rows, ["doc_id", "_there"]).where("_there").select("doc_id")


def code_point_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(ch string, n bigint): occurrences of the class members that are one
    code point, over all rows. Counted per batch with one bincount, so what is
    shuffled is a few rows for each partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not text.isascii():
                    found = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
                    total[: len(found)] += found
        where = np.flatnonzero(total)
        where = where[where >= 0x80]
        yield pa.RecordBatch.from_arrays([pa.array([chr(i) for i in where], pa.string()), pa.array(total[where])], ["ch", "n"])

    return docs.select(F.col(column).alias("text")).mapInArrow(count, "ch string, n bigint").groupBy("ch").agg(F.sum("n").alias("n"))


def fit_rewriter(docs: DataFrame, column: str = "text") -> dict[str, int]:
    """Frequencies for ``Rewriter``: at most one row for each code point of a
    look-alike class (a fixed table), so collecting them is bounded."""
    members = {m for c in look_alike_classes() for m in c if len(m) == 1}
    return {r.ch: r.n for r in code_point_counts(docs, column).collect() if r.ch in members}


def consistent_form(df: DataFrame, column: str = "text", into: str = "form", frequency: Mapping[str, int] | None = None) -> DataFrame:
    """df with the consistent form of ``column`` in ``into``. Null stays null,
    an empty text stays empty; a text of invisible characters becomes empty.
    An existing column named ``into`` is replaced; all others pass unchanged."""
    from pyspark.sql.functions import arrow_udf

    freq = dict(frequency or {})

    @arrow_udf("string")
    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        form = Rewriter(freq) if freq else rewriter()
        for texts in batches:
            yield pa.array([None if t is None else form(t) for t in texts.to_pylist()], pa.string())

    return df.withColumn(into, rewrite(F.col(column)))


def same_looking_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: records whose texts differ as stored but
    have the same consistent form. Texts without a letter or digit and null
    texts are left out.

    What meets on a digest of the form are the distinct stored texts, once
    each; forms with a single one are dropped before. Only pairs of different
    texts are then expanded to their records, first on one side, then on the
    other, so no pair of equal copies is ever made."""
    freq = fit_rewriter(docs)
    records = current_rows(docs, "text").where("text is not null")
    keyed = consistent_form(records, "text", "form", freq).where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(
        "doc_id",
        F.unhex(F.md5("form")).alias("form_key"),
        F.unhex(F.md5("text")).alias("text_key"),
    )
    keyed = staged(keyed, "forms")
    # the distinct stored texts of each form: copies do not multiply here
    texts = keyed.groupBy("form_key", "text_key").agg(F.count("*").alias("n"))
    many = texts.groupBy("form_key").agg(F.count("*").alias("texts")).where("texts > 1").select("form_key")
    mixed = staged(texts.join(many, "form_key", "left_semi").select("form_key", "text_key"), "mixed")
    members = keyed.join(mixed.select("text_key"), "text_key", "left_semi").select("text_key", "doc_id")
    pairs = mixed.select("form_key", F.col("text_key").alias("ta")).join(mixed.select("form_key", F.col("text_key").alias("tb")), "form_key").where("ta < tb").select("ta", "tb")
    left = pairs.join(members.select(F.col("text_key").alias("ta"), F.col("doc_id").alias("x")), "ta").select("x", "tb")
    both = left.join(members.select(F.col("text_key").alias("tb"), F.col("doc_id").alias("y")), "tb")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

"""Long exact spans shared between records.

Method: compressed full-text indexes over shards of the collection; backward
search over their wavelet trees gives matching statistics of the texts
streamed against them, and intervals above the threshold are reported.

Which texts meet in a shard is settled by anchors. In every window of ``span``
characters of a text, the GRAM-gram with the least hash is an anchor. Two texts
that share ``span`` characters share an anchor inside them, and every shared
window that holds an anchor lies within ``span`` - GRAM characters before its
start and ``span`` after it. So only these regions are indexed, and only of
anchors that two texts have; all regions of one anchor meet in one shard. An
anchor that in every text follows the same anchor with the same text between
adds no meeting: its region is joined to that of the one before.

No task holds an unbounded group. The statistics of anchors that a sample shows
in very many texts are aggregated, not gathered. A task that meets more than
GROUP regions of one key only tells the key; these regions then meet for pairs
as a grid of blocks, each cell an index of its own, and for spans, which need
one other document and not all, by counting the documents of every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.fmindex import FMIndex
from quarry.session import BROADCAST_ROWS, spread, staged

#: Characters of an anchor. More make chance meetings rarer and anchors denser.
GRAM = 96
#: Characters of one index.
INDEX_CHARS = 1_000_000
#: Regions of an anchor from which they are split by the text beside the anchor.
HOT_REGIONS = 1000
#: Regions of a key that meet in one task.
GROUP = 2000
#: Of so many texts one is looked at to find anchors of very many, and how many of these make one.
LOOK, MANY = 64, 2000
#: Pairs that are held before they are passed on.
PAIRS = 1_000_000
#: Characters hashed at a time; below 2 ** 16, so that a place fits the low bits.
_SEGMENT = 48_000


_powers_made: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Longest text whose links are hashed; anchors of longer ones count as unlinked.
_LINK_CHARS = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1, at least, of an odd number and of its inverse modulo 2 ** 64."""
    if len(_powers_made[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        for k, x in enumerate((base, pow(base, -1, 1 << 64))):
            made = np.full(size, x, np.uint64)
            made[0] = 1
            _powers_made[k] = np.cumprod(made, dtype=np.uint64)
    return _powers_made[0], _powers_made[1]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _plane() -> np.ndarray:
    return _scatter(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _values(text: np.ndarray) -> np.ndarray:
    """A random number for each character."""
    if len(text) and text.max() >= 1 << 16:
        return _scatter(text.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return _plane()[text]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = len(x) - width + 1
    return np.minimum(out[:rest], out[width - step : width - step + rest]) if step < width else out


_LOW = np.uint64(0xFFFF)


def _places(sums: np.ndarray, begin: int, end: int, span: int, gram: int, text_of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of the windows within [begin, end), at most 2 ** 16 grams.
    text_of: number of the text at each place; windows over a border are none."""
    down = _powers(end)[1]
    grams = (sums[begin + gram : end + 1] - sums[begin : end + 1 - gram]) * down[begin : end + 1 - gram]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    # of equal hashes in a window the last place is taken
    packed = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    least = _sliding_min(packed, span - gram + 1)
    if text_of is not None:
        least = least[text_of[begin : end - span + 1] == text_of[begin + span - 1 : end]]
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    at = np.unique((_LOW - (least[np.append(0, change)] & _LOW)).astype(np.int64))
    return at + begin, grams[at].view(np.int64)


def anchors(texts: list[np.ndarray], span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, hash, first place, last place, link): anchors of texts
    of ``span`` characters or more, in order. Repetitions of one anchor with
    none between are one, from first to last. link is a hash of the text from
    the anchor before to the end of this one, -1 for the first of a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.concatenate(texts)
    n = len(joined)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values(joined) * up[:n], out=sums[1:], dtype=np.uint64)
    own = np.repeat(np.arange(len(texts)), sizes) if len(texts) > 1 else None
    found = [_places(sums, b, min(n, b + _SEGMENT + span - 1), span, gram, own) for b in range(0, max(1, n - span + 1), _SEGMENT)]
    place, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    hash_ = np.concatenate([f[1] for f in found])[first]
    text = own[place] if own is not None else np.zeros(len(place), np.int64)
    if not len(place):
        return text, hash_, place, place, hash_
    new = np.flatnonzero(np.append(True, (hash_[1:] != hash_[:-1]) | (text[1:] != text[:-1])))
    start, end, text = place[new], place[np.append(new[1:], len(place)) - 1], text[new]
    link = np.full(len(new), -1, np.int64)
    if n <= _LINK_CHARS:
        follow = np.flatnonzero(text[1:] == text[:-1]) + 1
        a, b = start[follow - 1], end[follow] + gram
        link[follow] = (_scatter((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)) >> np.uint64(1)).view(np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])[text]
    return text, hash_[new], start - offset, end - offset, link


def _packs(texts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first, texts): short texts together, so that numpy's cost for a call is shared."""
    pack: list[np.ndarray] = []
    size = first = 0
    for k, t in enumerate(texts):
        if pack and size + len(t) > _SEGMENT:
            yield first, pack
            pack, size, first = [], 0, k
        pack.append(t)
        size += len(t)
    if pack:
        yield first, pack


def _anchor_rows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for first, pack in _packs([_points(t) for t in batch.column(1).to_pylist()]):
                text, *found = anchors(pack, span)
                for column, x in zip(columns, (ids[text + first], *found)):
                    column.append(x)
            if columns[0]:
                doc, h, start, end, link = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(link)], ["anchor", "doc_id", "first", "last", "link"])

    return run


def _side_keys(text: str, key: int, first: int, last: int, half: int) -> set[int]:
    """Keys of an anchor that too many texts have, by the text beside it: a
    shared window holds ``half`` characters on one side of the anchor at least,
    so two texts that share a window through the anchor have a key in common.
    An anchor from first to last has the keys of all its places."""
    gram, sides, at = text[first : first + GRAM], set(), first
    while 0 <= at <= last:
        sides.update((("l", text[at - half : at]) if at >= half else ("", ""), ("r", text[at + GRAM : at + GRAM + half])))
        at = text.find(gram, at + 1, last + GRAM)
    digests = (hashlib.blake2b(f"{key} {side} {near}".encode("utf-8", "surrogatepass"), digest_size=8).digest() for side, near in sides if len(near) == half)
    return {int.from_bytes(d, "little", signed=True) for d in digests}


def _region_rows(span: int):
    """Texts of regions: of each text, its shared anchors in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chains: list[list] = []  # key, start, end, anchor's place, hot
                for m in sorted(marks, key=lambda m: (m["first"], m["last"])):
                    if m["linked"] and chains:
                        chains[-1][2] = m["last"] + span
                    else:
                        chains.append([m["anchor"], max(0, m["first"] - (span - GRAM)), m["last"] + span, m["first"], m["last"], m["hot"]])
                for key, start, end, first, last, hot in chains:
                    region = text[start:end]
                    for k in _side_keys(text, key, first, last, (span - GRAM) // 2) if hot else (key,):
                        out.append((k, doc_id, start, region))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.string())], ["key", "doc_id", "start", "region"])

    return run


class _Shard:
    """Collects whole groups of regions and matches them."""

    def __init__(self, span: int, index_chars: int) -> None:
        self.span, self.index_chars = span, index_chars
        self.groups: list[dict[str, list[tuple[int, int]]]] = []
        self.chars = 0

    def matched(self) -> Iterator[tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray, np.ndarray, FMIndex]]:
        """(owners of texts, pattern, start, run, index): one index for the
        collected groups; a group beyond the size of an index goes block by
        block, all its texts against each block."""
        texts = [t for g in self.groups for t in g]
        owners = [o for g in self.groups for o in g.values()]
        points = [_points(t) for t in texts]
        block: list[int] = []
        size = 0
        for k, p in enumerate([*points, None]):
            if block and (p is None or size + len(p) > 2 * self.index_chars):
                index = FMIndex([points[i] for i in block], self.span)
                index.text_of = np.array(block, np.int32)[index.text_of]
                yield owners, *index.windows(points), index
                block, size = [], 0
            if p is not None:
                block.append(k)
                size += len(p)
        self.groups, self.chars = [], 0


def _groups(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[int, dict[str, list[tuple[int, int]]] | None, int]]:
    """(key, group, size): regions by key, equal texts once with their owners
    (doc_id, start). Of a key with more than ``most`` regions only the size."""
    key, group, size = None, {}, 0
    for batch in batches:
        for k, doc_id, start, region in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if k != key:
                if size:
                    yield key, group if most is None or size <= most else None, size
                key, group, size = k, {}, 0
            size += 1
            if most is None or size <= most:
                group.setdefault(region, []).append((doc_id, start))
            else:
                group.clear()
    if size:
        yield key, group if most is None or size <= most else None, size


def _pairs_of(runs: np.ndarray, index: FMIndex) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts that have a window in common. Neighbouring windows mostly
    have the same texts, so equal runs are dropped by a hash first; then all
    runs of a size are one step."""
    runs = np.unique(runs)
    sizes = index.run_end[runs] - runs
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = index.text_of[index.sa[runs[sizes == size][:, None] + np.arange(size)]].astype(np.int64)
        mark = _scatter(own.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)).sum(axis=1, dtype=np.uint64)
        own = own[np.unique(mark, return_index=True)[1]]
        own.sort(axis=1)
        if size <= 64:
            for i in range(size - 1):
                for j in range(i + 1, size):
                    yield own[:, i], own[:, j]
        else:
            for row in own:
                texts = np.unique(row)
                for i in range(len(texts) - 1):
                    yield np.full(len(texts) - 1 - i, texts[i]), texts[i + 1 :]


def _outside_pairs(pattern: np.ndarray, runs: np.ndarray, index: FMIndex) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a text outside the index with all texts inside that have one of its windows."""
    outside = ~np.isin(pattern, index.text_of)
    code = np.unique(pattern[outside] << 32 | runs[outside])
    pattern, runs = code >> 32, code & 0xFFFFFFFF
    sizes = index.run_end[runs] - runs
    for size in np.unique(sizes).tolist():
        at = sizes == size
        for k in range(size):
            yield pattern[at], index.text_of[index.sa[runs[at] + k]].astype(np.int64)


def _within(docs: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different documents."""
    own = np.unique(np.array(docs, np.int64))
    for i in range(len(own) - 1):
        yield np.full(len(own) - 1 - i, own[i]), own[i + 1 :]


class _Owners:
    """The documents of texts, for pairs of texts to become pairs of documents."""

    def __init__(self, owners: list[list[tuple[int, int]]]) -> None:
        own = [sorted({x for x, _ in o}) for o in owners]
        self.count = np.array([len(o) for o in own], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.docs = np.array([x for o in own for x in o], np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[a] * self.count[b]
        which = np.repeat(np.arange(len(a)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = self.count[b][which]
        return self.docs[self.start[a][which] + inside // np.maximum(width, 1)], self.docs[self.start[b][which] + inside % np.maximum(width, 1)]


def _batches(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in pieces of about PAIRS, each once in its piece, the lesser first."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def piece() -> tuple[np.ndarray, np.ndarray]:
        x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        both = np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y]
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.append(True, (both[1:] != both[:-1]).any(axis=1)) if len(both) else np.zeros(0, bool)
        return both[new, 0], both[new, 1]

    for x, y in pairs:
        for k in range(0, len(x), PAIRS):
            held.append((x[k : k + PAIRS], y[k : k + PAIRS]))
            size += len(held[-1][0])
            if size >= PAIRS:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


_PAIRS = ("a", "b", "key", "n")
_SPANS = ("doc_id", "start", "end", "key", "n")


def _told(names: tuple[str, ...], key: int, size: int) -> pa.RecordBatch:
    """A row of nulls but for the key and the size of its group."""
    return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * (len(names) - 2), pa.array([key], pa.int64()), pa.array([size], pa.int64())], list(names))


def _pair_rows(span: int, index_chars: int, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(span, index_chars)

        def rows(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for x, y in _batches(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[pa.nulls(len(x), pa.int64())] * 2], list(_PAIRS))

        def emit() -> Iterator[pa.RecordBatch]:
            for owners, pattern, _, runs, index in shard.matched():
                own = _Owners(owners)
                texts = (part for source in (_pairs_of(runs, index), _outside_pairs(pattern, runs, index)) for part in _batches(source))
                yield from rows(own.pairs(a, b) for a, b in texts)

        for key, group, size in _groups(batches, most):
            if group is None:
                yield _told(_PAIRS, key, size)
                continue
            # equal regions need no search
            yield from rows(pair for text, o in group.items() if len(o) > 1 and len(text) >= span for pair in _within([x for x, _ in o]))
            if len(group) > 1:
                shard.groups.append(group)
                shard.chars += sum(map(len, group))
                if shard.chars >= shard.index_chars:
                    yield from emit()
        if shard.groups:
            yield from emit()

    return run


def _span_rows(span: int, index_chars: int, most: int | None):
    """(doc_id, start, end) of windows that another text has, neighbours joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(span, index_chars)

        def rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in found], pa.int64()) for i in range(3)), *[pa.nulls(len(found), pa.int64())] * 2], list(_SPANS))

        def emit() -> Iterator[pa.RecordBatch]:
            for owners, pattern, start, runs, index in shard.matched():
                # the one document of each text, -1 for texts of several
                docs = [{x for x, _ in o} for o in owners]
                one = np.array([next(iter(d)) if len(d) == 1 else -1 for d in docs], np.int64)
                if not len(runs):
                    continue
                each, which = np.unique(runs, return_inverse=True)
                held = one[index.text_of[index.sa]]
                bounds = np.stack([each, np.minimum(index.run_end[each], index.n - 1)], axis=1).ravel()
                # a run that ends with the array takes its last entry in
                low, high = np.minimum.reduceat(held, bounds)[::2], np.maximum.reduceat(held, bounds)[::2]
                open_end = index.run_end[each] == index.n
                low[open_end], high[open_end] = np.minimum(low[open_end], held[-1]), np.maximum(high[open_end], held[-1])
                other = (low != high) | (low < 0)
                shared = other[which] | (one[pattern] != low[which])
                p, at = pattern[shared], start[shared]
                if not len(p):
                    continue
                order = np.lexsort((at, p))
                p, at = p[order], at[order]
                new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (at[1:] > at[:-1] + span)))
                found = {(doc, own + first, own + last + span) for k, first, last in zip(p[new].tolist(), at[new].tolist(), at[np.append(new[1:], len(p)) - 1].tolist()) for doc, own in owners[k]}
                yield rows(sorted(found))

        for key, group, size in _groups(batches, most):
            if group is None:
                yield _told(_SPANS, key, size)
                continue
            whole = [(doc, own, own + len(t)) for t, o in group.items() if len(t) >= span and len({x for x, _ in o}) > 1 for doc, own in o]
            if whole:
                yield rows(whole)
            if len(group) > 1:
                shard.groups.append(group)
                shard.chars += sum(map(len, group))
                if shard.chars >= shard.index_chars:
                    yield from emit()
        if shard.groups:
            yield from emit()

    return run


def _window_rows(span: int):
    """(h, doc_id, at): every window of the regions, by a hash of its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for doc_id, start, region in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                text = _points(region)
                n = len(text) - span + 1
                if n < 1:
                    continue
                up, down = _powers(len(text) + 1)
                sums = np.zeros(len(text) + 1, np.uint64)
                np.cumsum(_values(text) * up[: len(text)], out=sums[1:], dtype=np.uint64)
                h = _scatter((sums[span:] - sums[:-span]) * down[:n])
                out.append((h.view(np.int64), np.full(n, doc_id, np.int64), np.arange(start, start + n, dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["h", "doc_id", "at"])

    return run


def text_classes(documents: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies are one: (texts, members). texts: doc_id (the least of the
    copies), text; members: (rep, doc_id), one row for each document of a text
    that has copies. Only texts of ``span`` characters or more count."""
    long = spread(documents.where(F.char_length("text") >= span).select("doc_id", "text"))
    digests = long.select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    reps = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copied = reps.where("n > 1")
    members = staged(digests.join(copied, "digest").select("rep", "doc_id"), "copies")
    others = members.where("rep <> doc_id").select("doc_id")
    return long.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, "doc_id", "left_anti"), members


def _marked(rows: DataFrame) -> DataFrame:
    """Rows of anchors with what all rows of the anchor tell: whether it is
    linked, hot, and its least and greatest document."""
    group = Window.partitionBy("anchor")
    same = (F.min("link").over(group) == F.max("link").over(group)) & (F.min("link").over(group) >= 0)
    # one shuffle: an anchor's statistics return to its rows in place
    return rows.withColumn("linked", same).withColumn("hot", F.count("*").over(group) > HOT_REGIONS).withColumn("least", F.min("doc_id").over(group)).withColumn("most", F.max("doc_id").over(group))


def _regions(texts: DataFrame, span: int, count: int) -> DataFrame:
    """(key, doc_id, start, region): rows of one key are to meet. count: texts, at most."""
    anchor_schema = "anchor bigint, doc_id bigint, first int, last int, link bigint"
    rows = texts.mapInArrow(_anchor_rows(span), anchor_schema)
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0)
    marked = None
    if count > LOOK * MANY:
        # anchors of very many texts: aggregated map-side and told to their rows; there are no more than texts' anchors / (LOOK * MANY)
        often = some.mapInArrow(_anchor_rows(span), anchor_schema).groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > MANY)
        often = staged(often.select("anchor"), "often")
        if not often.isEmpty():
            few = often.count() <= BROADCAST_ROWS
            told = F.broadcast(often) if few else often
            own = rows.join(told, "anchor", "left_semi")
            stats = own.groupBy("anchor").agg(F.min("link").alias("_l"), F.max("link").alias("_h"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
            stats = staged(stats, "oftenstats")
            joined = own.join(F.broadcast(stats) if few else stats, "anchor").withColumn("linked", (F.col("_l") == F.col("_h")) & (F.col("_l") >= 0)).withColumn("hot", F.lit(True))
            columns = ("anchor", "doc_id", "first", "last", "linked", "hot", "least", "most")
            marked = joined.select(*columns).unionAll(_marked(rows.join(told, "anchor", "left_anti")).select(*columns))
    marked = _marked(rows) if marked is None else marked
    marks = marked.where("least <> most").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "last", "linked", "hot")).alias("marks"))
    return texts.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_region_rows(span), "key bigint, doc_id bigint, start int, region string")


def _met(regions: DataFrame) -> DataFrame:
    return regions.repartition("key").sortWithinPartitions("key")


def _of_keys(regions: DataFrame, told: DataFrame) -> DataFrame:
    """Regions of the keys told(key, n), with n."""
    few = told.count() <= BROADCAST_ROWS
    return regions.join(F.broadcast(told) if few else told, "key")


def _cells(regions: DataFrame, told: DataFrame, block: int) -> DataFrame:
    """Regions of large groups as a grid: every two of a group meet in a cell of two blocks."""
    rows = _of_keys(regions, told).withColumn("_g", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("doc_id", "start"), F.col("_g")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return rows.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "doc_id", "start", "region")


def shared_pairs(documents: DataFrame, span: int = 240, index_chars: int = INDEX_CHARS, group: int = GROUP) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts have ``span``
    consecutive characters in common, as stored. Null and shorter texts share
    nothing. doc_id is unique; other columns are not read."""
    texts, copies = text_classes(documents, span)
    regions, schema = _regions(texts, span, documents.count()), "a bigint, b bigint, key bigint, n bigint"
    found = staged(_met(regions).mapInArrow(_pair_rows(span, index_chars, group), schema), "found")
    met, told = found.where("key is null"), found.where("key is not null").select("key", "n")
    if not told.isEmpty():
        met = met.unionAll(_met(_cells(regions, told, group)).mapInArrow(_pair_rows(span, index_chars, None), schema))
    met = met.select("a", "b").distinct()
    # copies back in: each text of a pair stands for all its documents
    left = met.join(copies.withColumnRenamed("rep", "a"), "a", "left").select(F.coalesce("doc_id", "a").alias("x"), "b")
    both = left.join(copies.withColumnRenamed("rep", "b"), "b", "left").select("x", F.coalesce("doc_id", "b").alias("y"))
    inside = copies.alias("p").join(copies.alias("q"), "rep").where("p.doc_id < q.doc_id").select(F.col("p.doc_id").alias("x"), F.col("q.doc_id").alias("y"))
    return both.unionAll(inside).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def _often_spans(regions: DataFrame, told: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end): the shared windows of large groups, found by counting the documents of each."""
    windows = staged(_of_keys(regions, told).select("key", "doc_id", "start", "region").mapInArrow(_window_rows(span), "h bigint, doc_id bigint, at bigint"), "windows")
    shared = windows.groupBy("h").agg(F.min("doc_id").alias("_l"), F.max("doc_id").alias("_m")).where("_l < _m").select("h")
    return windows.join(shared, "h", "left_semi").select("doc_id", F.col("at").alias("start"), (F.col("at") + span).alias("end"))


def shared_spans(documents: DataFrame, span: int = 240, index_chars: int = INDEX_CHARS, group: int = GROUP) -> DataFrame:
    """(doc_id, start, end): the stretches of each document, as long as they
    go, that consist of windows of ``span`` characters which another document
    has too. Copies are covered as a whole."""
    texts, copies = text_classes(documents, span)
    regions = _regions(texts, span, documents.count())
    found = staged(_met(regions).mapInArrow(_span_rows(span, index_chars, group), "doc_id bigint, start bigint, end bigint, key bigint, n bigint"), "found")
    told = found.where("key is not null").select("key", "n")
    found = found.where("key is null").select("doc_id", "start", "end")
    if not told.isEmpty():
        found = found.unionAll(_often_spans(regions, told, span))
    found = found.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    spread = found.join(copies.withColumnRenamed("doc_id", "member"), found.doc_id == F.col("rep"), "left").select(F.coalesce("member", "doc_id").alias("doc_id"), "start", "end")
    whole = documents.select("doc_id", F.char_length("text").alias("end")).join(copies.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(0).alias("start"), "end")
    pieces = spread.unionByName(whole)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def shared_report(documents: DataFrame, span: int = 240) -> DataFrame:
    """(doc_id, n_chars, spans, shared_chars, share): for every document. A
    null or empty text has 0 characters and no share (null)."""
    spans = shared_spans(documents, span).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    sizes = documents.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
    return sizes.join(spans, "doc_id", "left").fillna(0, ["spans", "shared_chars"]).withColumn("share", F.col("shared_chars") / F.nullif("n_chars", F.lit(0)))

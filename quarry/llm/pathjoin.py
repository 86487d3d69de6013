"""Near-duplicate records: a similarity join on sets of consecutive terms.

Method: chosen-path join. A run starts with all records in one node. In a node
each record samples tokens of its set, about 1 / threshold of them, by a hash
of the path and the token, so that records that share much sample the same
ones; each sampled token leads to a child node. Nodes that are small enough
are compared by brute force on bit sketches, larger ones are split again, and
runs are repeated until the target recall. Pairs that pass are checked exactly.

How many runs that takes follows from the level that nodes are split to. Take
a pair at the threshold whose one set holds the other (the worst one): of the
sample of a run it shares one token on average. In a node of level k, 1 + 1 / k
times as many are sampled, so that deep pairs are not lost while nodes that
share a template die out. What that gives is ``meeting``; R runs miss a pair
with a chance of exp(-R * meeting). The first runs are as many as a depth of
EXPECTED takes, and where nodes went deeper, runs are added. The runs of a round
are drawn at once: a record samples R / (threshold * size) of its tokens, so
runs sample different tokens as long as there are enough, which never misses
more than runs that may sample the same ones.

Spark holds no node: a node is a 64-bit path. At each level the records' paths
are shuffled once, with sketches instead of sets, and a task compares each node
of up to BUCKET records; of a larger node it only tells the path, and the next
level extends just these. Nodes that are huge are found on a sample before and
are not shuffled at all. A node that stays large because its records are alike,
or at the last level, is compared as a grid of blocks, each cell in a task of
its own.

Records with equal sets are one in the join; they come back with the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.forms import current_rows, record_ids
from quarry.llm.terms import _RUNS, Folder
from quarry.session import BROADCAST_ROWS, staged

#: Records of a node that are compared without further splitting.
BUCKET = 10_000
#: Level at which a node is compared whatever its size, block by block.
DEPTH = 10
#: Level that the first runs are counted for.
EXPECTED = 3
#: Large nodes whose paths go along with the pass over the sets; more are joined to the records instead.
TOLD = 500_000
#: Of so many records one is looked at to find huge nodes.
LOOK = 64
#: Rows of a large node from which the size of its largest group of similar records is judged.
JUDGED = 512
#: Pairs of a task that are held before they are passed on.
PAIRS = 500_000
#: Rows whose tokens are expanded at a time.
_SLICE = 400
SKETCH_WORDS = 4
#: Bits of a token: fewer take less room, and 48 never fall together within a pair in practice (2 ** -31 for sets of 350).
_TOKEN = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Codes(dict):
    """Run of letters and digits -> number of the term it folds to, 0 where it folds to nothing; bounded, refilled when full."""

    def __init__(self, folder: Folder) -> None:
        super().__init__()
        self.fold = folder.fold

    def __missing__(self, run: str) -> int:
        term = self.fold(run)
        code = int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1 if term else 0
        if len(self) > 1_000_000:
            self.clear()
        self[run] = code
        return code


class Shingler:
    """Hashed sets of consecutive terms."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.folder = Folder()
        self.codes = _Codes(self.folder)
        self.salts = [np.uint64(int.from_bytes(hashlib.blake2b(b"%d" % k, digest_size=8).digest(), "little") | 1) for k in range(width)]

    def of_form(self, form: str) -> np.ndarray:
        """Distinct shingles of a consistent form, ascending; none if it has fewer terms than the width."""
        runs = _RUNS(form)
        c = np.fromiter(map(self.codes.__getitem__, runs), np.uint64, len(runs))
        if not c.all():
            c = c[c != 0]
        n = len(c) - self.width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k, salt in enumerate(self.salts):
            h = _mix(h + c[k : k + n] * salt)
        h &= _TOKEN
        h.sort()
        return h[np.append(True, h[1:] != h[:-1])]

    def __call__(self, text: str) -> np.ndarray:
        return self.of_form(self.folder.form(text))


_SKETCH_SEEDS = (_mix(np.arange(1, 64 * SKETCH_WORDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits of which two sets agree in about (1 + J) / 2: for each bit, a bit
    of the least value over the set. Tokens are hashes, so multiplying by an
    odd number orders them anew; 32 bits of them are enough for that."""
    low = (tokens ^ (tokens >> np.uint64(16))).astype(np.uint32)
    least = (low[None, :] * _SKETCH_SEEDS[:, None]).min(axis=1)
    return np.packbits((_mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def most_apart(bits: int, threshold: float, miss: float) -> int:
    """Bits in which two sets at the threshold differ more often only with a chance of ``miss``."""
    p, left, n = (1 - threshold) / 2, 1.0, -1
    while left > miss:
        n += 1
        left -= math.comb(bits, n) * p**n * (1 - p) ** (bits - n)
    return n


def inner_rate(level: int) -> float:
    """Common tokens that a pair at the threshold samples on average in a node of this level, at least."""
    return 1 + 1 / level


def meeting(depth: int) -> float:
    """Least chance that a token sampled at the root by both records of a pair
    at the threshold makes them meet, if nodes of level ``depth`` are compared."""
    met = 1.0
    for level in range(depth - 1, 0, -1):
        met = -math.expm1(-inner_rate(level) * met)
    return met


class _Tokens:
    """Tokens of several sets, and the sampling of them."""

    def __init__(self, tokens: list[np.ndarray], threshold: float) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.start = np.cumsum(self.sizes) - self.sizes
        # the chance 1 / (threshold * size) of a token
        self.one = 1.0 / (threshold * np.maximum(self.sizes, 1))

    def roots(self, runs: float, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, path) of the first level. Where runs would sample more tokens
        than a set has, its tokens are sampled several times, for other paths.
        turn: number of the round, for other samples."""
        share = self.one * runs
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.arange(len(self.sizes))
        for copy in range(math.ceil(share.max(initial=0.0))):
            rows = rows[share[rows] > copy]
            found.append(self._drawn(rows, np.full(len(rows), _mix(np.full(1, (turn << 32) + copy + 1, np.uint64))[0]), _limit(share[rows] - copy)))
        return _joined(found)

    def children(self, row: np.ndarray, path: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, path) of the next level below the nodes (row, path) of this one."""
        found = []
        for k in range(0, len(row), 20_000):
            part = slice(k, k + 20_000)
            found.append(self._drawn(row[part], path[part], _limit(self.one[row[part]] * inner_rate(level))))
        return _joined(found)

    def _drawn(self, row: np.ndarray, path: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the tokens whose hash with its path is below its limit."""
        n = self.sizes[row]
        which = np.repeat(np.arange(len(row)), n)
        at = np.arange(len(which)) + np.repeat(self.start[row] - (np.cumsum(n) - n), n)
        drawn = _mix(self.flat[at] + (path * np.uint64(0x9E3779B97F4A7C15))[which])
        taken = np.flatnonzero(drawn < limit[which])
        return row[which[taken]], _mix(drawn[taken] + np.uint64(0xD1B54A32D192ED03))


def _limit(chance: np.ndarray) -> np.ndarray:
    return (np.minimum(chance, 1.0) * (2.0**64 - 2048)).astype(np.uint64)


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _among(path: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which paths stand in known, ascending."""
    if not len(known):
        return np.zeros(len(path), bool)
    at = np.searchsorted(known, path)
    at[at == len(known)] = 0
    return known[at] == path


def paths(tokens: list[np.ndarray], threshold: float, runs: float, split: list[np.ndarray], turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, path): the records' paths of level len(split) + 1. split[k] holds
    the paths of level k + 1 that are split, ascending."""
    with np.errstate(over="ignore"):
        held = _Tokens(tokens, threshold)
        row, path = held.roots(runs, turn)
        for level, known in enumerate(split, 1):
            again = _among(path, known)
            row, path = held.children(row[again], path[again], level)
    return row, path


def _token_arrays(column: pa.ListArray) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _sets(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets). members: doc_id, form_key, rep, one row per record of
    a set that several have; sets: rep, n, tokens, sketch, one row per
    distinct set. Texts are read once."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            ids, forms, keys, sets = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = shingles.folder.form(text)
                s = shingles.of_form(form)
                if len(s):
                    ids.append(doc_id)
                    forms.append(hashlib.md5(form.encode("utf-8", "surrogatepass")).digest())
                    keys.append(hashlib.md5(s.tobytes()).digest())
                    sets.append(s)
            sizes = np.array([len(s) for s in sets], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            columns = [pa.array(ids, pa.string()), pa.array(forms, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([sketch(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "form_key", "set_key", "n", "tokens", "sketch"])

    records = current_rows(docs, "text").where("text is not null")
    each = staged(records.mapInArrow(contents, "doc_id string, form_key binary, set_key binary, n int, tokens array<bigint>, sketch binary"), "sets")
    reps = each.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("set_key", "rep")
    many = staged(each.select("doc_id", "form_key", "set_key").join(reps, "set_key").select("doc_id", "form_key", "rep"), "copies")
    others = many.where("doc_id <> rep").select(F.col("doc_id").alias("rep"))
    own = each.select(F.col("doc_id").alias("rep"), "n", "tokens", "sketch")
    if others.count() <= BROADCAST_ROWS:
        return many, own.join(F.broadcast(others), "rep", "left_anti")
    return many, staged(own.join(others, "rep", "left_anti"), "distinct")


_MEMBERS = "path bigint, rep string, n int, sketch binary"


def _member_rows(threshold: float, runs: float, turn: int, split: list[np.ndarray], skip: np.ndarray):
    """Rows of the level below split, but for the paths in skip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _token_arrays(batch.column(2))
            for k in range(0, len(tokens), _SLICE):
                row, path = paths(tokens[k : k + _SLICE], threshold, runs, split, turn)
                if len(skip):
                    keep = ~_among(path, skip)
                    row, path = row[keep], path[keep]
                take = pa.array(row + k)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take)], ["path", "rep", "n", "sketch"])

    return run


def _below_rows(threshold: float, level: int):
    """Rows below the nodes of this level that stand in the records' own column of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes = _token_arrays(batch.column(2)), _token_arrays(batch.column(4))
            for k in range(0, len(tokens), _SLICE):
                some = nodes[k : k + _SLICE]
                with np.errstate(over="ignore"):
                    row, path = _Tokens(tokens[k : k + _SLICE], threshold).children(np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some), level)
                take = pa.array(row + k)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take)], ["path", "rep", "n", "sketch"])

    return run


def _alike(marks: np.ndarray, size: int, threshold: float) -> int:
    """About how many of the ``size`` records of a node are similar to each
    other, from the sketches of some of them (a row of words for each)."""
    some = marks[:: -(-len(marks) // JUDGED)]
    apart = np.bitwise_count(some[:, None] ^ some[None]).sum(axis=2, dtype=np.int32)
    pairs = len(some) * (len(some) - 1)
    near = int((apart <= 64 * SKETCH_WORDS * (1 - threshold) / 2).sum()) - len(some)
    return int(size * math.sqrt(near / pairs)) if pairs else 0


def _node_pairs(threshold: float, miss: float, limit: int | None, judge_only: bool = False):
    """(a, b, path, n, alike): of nodes of up to ``limit`` records the pairs
    whose sketches and sizes allow the threshold (none with judge_only), of
    larger ones path, size and about the size of the largest group of similar
    records. Rows come ordered by path and set size. No more than ``limit``
    rows of a node are held, and of larger ones some sketches."""
    bits = 64 * SKETCH_WORDS
    near_half, near_whole = most_apart(bits // 2, threshold, miss / 2), most_apart(bits, threshold, miss / 2)

    def near(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs (x, y) have sketches that are near, on all bits."""
        return np.bitwise_count(m[:, x] ^ m[:, y]).sum(axis=0, dtype=np.int32) <= near_whole

    def of_small(path: np.ndarray, n: np.ndarray, m: np.ndarray, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row i with row i + d for d = 1, 2, ..., in all nodes at a time."""
        d, size = 1, len(path)
        while len(live := live[live + d < size]) and len(live := live[(path[live] == path[live + d])]):
            live = live[n[live] >= threshold * n[live + d] - 1e-9]  # sizes ascend: a row is done once another is too large
            hit = live[near(m, live, live + d)]
            if len(hit):
                yield hit, hit + d
            d += 1

    def of_large(begin: int, end: int, n: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A few rows with all later ones of their node that are not too large."""
        step = 16
        for i in range(begin, end, step):
            j = min(i + step, end)
            top = begin + int(np.searchsorted(n[begin:end], n[j - 1] / threshold + 1e-9, side="right"))
            apart = np.bitwise_count(m[0, i:j, None] ^ m[0, None, i:top])
            apart += np.bitwise_count(m[1, i:j, None] ^ m[1, None, i:top])
            x, y = np.nonzero(apart <= near_half)
            later = y > x
            x, y = x[later] + i, y[later] + i
            ok = n[x] >= threshold * n[y] - 1e-9
            x, y = x[ok], y[ok]
            ok = near(m, x, y)
            if ok.any():
                yield x[ok], y[ok]

    def sketches(rows: pa.RecordBatch | pa.Table, step: int = 1) -> np.ndarray:
        column = rows.column("sketch").take(pa.array(np.arange(0, rows.num_rows, step)))
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        path = rows.column("path").to_numpy()
        if not len(path):
            return
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        size = np.diff(np.append(first, len(path)))
        for k in np.flatnonzero(size > (limit or len(path))).tolist():
            yield _told(path[first[k]], int(size[k]), sketches(rows.slice(first[k], size[k])))
        if judge_only:
            return
        keep = (size > 1) & (size <= (limit or size.max()))
        rows = rows.filter(pa.array(np.repeat(keep, size)))
        size = size[keep]
        path, n = rows.column("path").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
        m = np.ascontiguousarray(sketches(rows).T)
        rep = rows.column("rep").combine_chunks()
        begin = np.cumsum(size) - size
        small = np.flatnonzero(np.repeat(size <= 100, size))
        large = np.flatnonzero(size > 100)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = 0
        for part in (of_small(path, n, m, small), *(of_large(int(begin[k]), int(begin[k] + size[k]), n, m) for k in large)):
            for x, y in part:
                found.append((x, y))
                pairs += len(x)
                if pairs > PAIRS:
                    yield from _named(rep, found)
                    found, pairs = [], 0
        yield from _named(rep, found)

    def _named(rep: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Pairs of rows as pairs of reps; one that met in several nodes is one here."""
        x, y = _joined(found)
        a, b = rep.take(pa.array(x)), rep.take(pa.array(y))
        swap = pc.greater(a, b)
        one, two = pc.if_else(swap, b, a), pc.if_else(swap, a, b)
        named = pa.table({"a": one, "b": two}).filter(pc.not_equal(one, two)).group_by(["a", "b"]).aggregate([])
        for part in named.select(["a", "b"]).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.nulls(part.num_rows, pa.int64())] * 3], ["a", "b", "path", "n", "alike"])

    def _told(path: int, size: int, marks: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(1, pa.string())
        return pa.RecordBatch.from_arrays([none, none, *(pa.array([int(x)], pa.int64()) for x in (path, size, _alike(marks, size, threshold)))], ["a", "b", "path", "n", "alike"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the node that may go on in the next batch
        marks: list[np.ndarray] = []  # sketches of some of its rows, once it is too large
        at, size = None, 0

        def take(part: pa.RecordBatch) -> None:
            nonlocal size
            size += part.num_rows
            if marks or (limit is not None and size > limit):
                marks.extend(sketches(b, 1 + limit // JUDGED) for b in (*held, part))
                held.clear()
            else:
                held.append(part)

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if held:
                yield from compare(pa.Table.from_batches(held))
            elif marks:
                yield _told(at, size, np.concatenate(marks))
            held.clear(), marks.clear()
            size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy()
            more = int(np.searchsorted(path, at, side="right")) if at is not None and path[0] == at else 0
            if more:
                take(batch.slice(0, more))
            if more == len(path):
                continue
            yield from ended()
            at = path[-1]
            last = int(np.searchsorted(path, at))
            if last > more:
                yield from compare(pa.Table.from_batches([batch.slice(more, last - more)]))
            take(batch.slice(last))
        yield from ended()

    return run


_MET = "a string, b string, path bigint, n bigint, alike bigint"


def _met(members: DataFrame, threshold: float, miss: float, limit: int | None, judge_only: bool = False) -> DataFrame:
    return members.repartition("path").sortWithinPartitions("path", "n").mapInArrow(_node_pairs(threshold, miss, limit, judge_only), _MET)


def _huge(members: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(path, n, alike), sizes being estimates: nodes that one in LOOK records
    have more than ``limit`` times, so that their rows need not be shuffled to
    know that they are split."""
    some = members.where(F.pmod(F.xxhash64("rep"), F.lit(LOOK)) == 0)
    found = _met(some, threshold, 0.5, limit, judge_only=True).where("path is not null")
    return staged(found.select("path", (F.col("n") * LOOK).alias("n"), (F.col("alike") * LOOK).alias("alike")), "huge")


def _ascending(paths: Iterable[int]) -> np.ndarray:
    return np.sort(np.array(list(paths), np.int64).view(np.uint64))


def _grid(members: DataFrame, rest: DataFrame, block: int) -> DataFrame:
    """Members of the nodes rest(path, n), each node as a grid of cells of two
    blocks of records: every pair of its records meets in some cell."""
    sides = F.greatest(F.lit(1), F.ceil(F.col("_size") / block)).cast("int")
    rest = rest.select("path", F.col("n").alias("_size"))
    rows = members.join(F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest, "path").withColumn("_g", sides)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_g")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    cell = F.xxhash64("path", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.select(cell.alias("path"), "rep", "n", "sketch")


def _round(sets: DataFrame, count: int, threshold: float, runs: float, turn: int, miss: float, bucket: int, depth: int, told: int) -> tuple[list[DataFrame], int]:
    """(pairs found, level reached) of the runs of one round."""
    split: list[np.ndarray] = []
    below: DataFrame | None = None  # (rep, nodes) once there are too many paths to tell
    met: list[DataFrame] = []
    for level in range(1, depth + 1):

        def members(skip: Iterable[int] = ()) -> DataFrame:
            if below is None:
                return sets.mapInArrow(_member_rows(threshold, runs, turn, split, _ascending(skip)), _MEMBERS)
            return sets.join(below, "rep").mapInArrow(_below_rows(threshold, level - 1), _MEMBERS)

        # so many of one share of the rows that there are no more than 100,000 such nodes
        share = max(bucket, int(count * runs / threshold) // LOOK // 100_000)
        huge = _huge(members(), threshold, share) if below is None and count > share * LOOK else None
        found = staged(_met(members() if huge is None else members(r.path for r in huge.select("path").collect()), threshold, miss, bucket), "met")
        met.append(found.where("path is null").select("a", "b"))
        large = found.where("path is not null").select("path", "n", "alike")
        large = large if huge is None else large.unionAll(huge)
        alike = large if level == depth else large.where(F.col("alike") > bucket)
        if not alike.isEmpty():
            met.append(staged(_met(_grid(members(), alike, bucket), threshold, miss, None), "met").select("a", "b"))
        large = large.where(F.col("alike") <= bucket)
        many = large.count()
        if level == depth or not many:
            return met, level
        if below is None and many <= told:
            split = [*split, _ascending(r.path for r in large.select("path").collect())]
        else:
            own = members().select("path", "rep").join(large.select("path"), "path", "left_semi")
            below = staged(own.groupBy("rep").agg(F.collect_set("path").alias("nodes")), "below")
    return met, depth


def similar_sets(sets: DataFrame, threshold: Fraction, recall: float = 0.9999, bucket: int = BUCKET, depth: int = DEPTH, told: int = TOLD) -> DataFrame:
    """(a, b), a < b: reps whose sets have a Jaccard similarity of ``threshold``
    or more. Of pairs at the threshold, the least of them, ``recall`` are found
    at least: half of what may be missed goes to the paths, half to the sketches."""
    low, miss = float(threshold), (1 - recall) / 2
    sets = sets.select("rep", "n", "tokens", "sketch")
    count = sets.count()
    needs, turn = -math.log(miss), 0
    runs = needs / meeting(EXPECTED)
    met: list[DataFrame] = []
    while runs > 1e-6:
        found, level = _round(sets, count, low, runs, turn, miss, bucket, depth, told)
        met += found
        needs, turn = needs - runs * meeting(level), turn + 1
        # the level reached by rare nodes of a round is reached by the next one's, too
        runs = max(0.0, needs) / meeting(min(depth, level + 1))
    candidates = met[0]
    for more in met[1:]:
        candidates = candidates.unionAll(more)
    candidates = staged(candidates.distinct(), "candidates")
    needed = candidates.select(F.col("a").alias("rep")).union(candidates.select("b")).distinct()
    own = staged(sets.join(needed, "rep", "left_semi").select("rep", "tokens"), "needed")
    x = own.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    y = own.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    every = F.size("ta") + F.size("tb") - common
    return candidates.join(x, "a").join(y, "b").where(common * threshold.denominator >= every * threshold.numerator).select("a", "b")


def near_duplicate_pairs(docs: DataFrame, width: int = 3, threshold: Fraction = Fraction(3, 5), recall: float = 0.9999) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: records whose consistent forms differ and
    whose sets of ``width`` consecutive terms reach ``threshold``. Null texts
    and texts of fewer terms are left out. Other columns of docs pass unread."""
    copies, sets = _sets(docs, width)
    met = similar_sets(sets, threshold, recall)
    left = met.join(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a", "left").select(F.coalesce("x", "a").alias("x"), "b")
    both = left.join(copies.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
    # within a set, the distinct forms meet first, so no pair of equal forms is made
    forms = copies.select("rep", "form_key").distinct()
    p, q = forms.select("rep", F.col("form_key").alias("fp")), forms.select("rep", F.col("form_key").alias("fq"))
    differ = p.join(q, "rep").where("fp < fq")
    first = differ.join(copies.select("rep", F.col("form_key").alias("fp"), F.col("doc_id").alias("x")), ["rep", "fp"]).select("rep", "fq", "x")
    inside = first.join(copies.select("rep", F.col("form_key").alias("fq"), F.col("doc_id").alias("y")), ["rep", "fq"]).select("x", "y")
    return both.unionAll(inside).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def near_duplicate_groups(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), recall: float = 0.9999) -> DataFrame:
    """(doc_id, group_id, links): records that similar pairs connect have the
    least doc_id among them as group_id; links counts the other distinct sets
    that are similar to the record's. Records without enough terms are left out.

    Components by repeated minimum over neighbours and jumps; each round is
    written, so its plan stays short, and rounds end when nothing changes.
    """
    copies, sets = _sets(docs, width)
    pairs = staged(similar_sets(sets, threshold, recall), "pairs")
    edges = staged(pairs.union(pairs.select("b", "a")).toDF("rep", "other"), "edges")
    links = edges.groupBy("rep").agg(F.count("*").alias("links"))
    label = staged(edges.groupBy("rep").agg(F.least("rep", F.min("other")).alias("root")), "labels")
    while True:
        near = edges.join(label.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.min("root").alias("near"))
        closer = label.join(near, "rep").select("rep", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("rep").alias("root"), F.col("root").alias("far"))
        moved = staged(closer.join(jump, "root", "left").select("rep", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        label = moved.select("rep", "root")
        if moved.where("root <> old").isEmpty():
            break
    reps = sets.select("rep").join(label, "rep", "left").join(links, "rep", "left").select("rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    members = reps.join(copies.select("rep", "doc_id"), "rep", "left")
    return members.select(F.coalesce("doc_id", "rep").alias("doc_id"), "group_id", "links")


def record_groups(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), recall: float = 0.9999) -> DataFrame:
    """near_duplicate_groups with a row for every record: one without enough
    terms, an empty one too, is a group of its own. A null text is no record."""
    records = record_ids(docs)
    groups = near_duplicate_groups(docs, width, threshold, recall)
    return records.join(groups, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

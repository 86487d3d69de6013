"""Vectors: encoders, normalisation, exact inner-product search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import TOKEN, _folds
from quarry.operators.lexical import DIGITS, RUNS
from quarry.session import staged

#: Numbers in the block of query vectors that a pass over the vectors takes along (8 bytes each).
QUERY_NUMBERS = 4_000_000
#: Rows that a task keeps for such a block.
KEPT_ROWS = 2_000_000
#: Queries and vectors that are multiplied at a time, rows held before those that no query keeps go, rows of a batch of results.
TILE_QUERIES, TILE_ROWS, STORED_ROWS, OUT_ROWS = 256, 4096, 200_000, 50_000


class Encoder(Protocol):
    """Texts to vectors. Queries may be encoded otherwise than passages."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...

    def encode_query(self, texts: list[str]) -> np.ndarray: ...


class _Places(dict):
    """The dimension of a run of letters, ``dim`` more where its sign is negative."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim
        self.fold = dict(zip(map(ord, _folds()[0]), _folds()[1]))

    def __missing__(self, run: str) -> int:
        if len(self) > RUNS:
            self.clear()
        digest = hashlib.md5(run.lower().translate(self.fold).encode()).hexdigest()
        at = self[run] = int(digest[:4], 16) % self.dim + (0 if int(digest[4], 16) < 8 else self.dim)
        return at


class HashingEncoder:
    """Counts of terms, signed, by the digest of the term: needs no model and is
    the same everywhere. Unit length; a text without terms is the zero vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self._places = _Places(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        find = re.compile(r"[^\W_]+").findall
        place = self._places.__getitem__
        out = np.zeros((len(texts), self.dim))
        for first in range(0, len(texts), 500):
            part = texts[first : first + 500]
            places: list[int] = []
            sizes = []
            for text in part:
                runs = find(text or "")
                places += map(place, runs)
                sizes.append(len(runs))
            at = np.repeat(np.arange(len(part)) * (2 * self.dim), sizes) + np.array(places, np.int64)
            counts = np.bincount(at, minlength=len(part) * 2 * self.dim).reshape(len(part), 2, self.dim)
            out[first : first + len(part)] = counts[:, 0] - counts[:, 1]
        return unit(out)

    encode_query = encode


ENCODERS: dict[str, Callable[..., Encoder]] = {"hashing": HashingEncoder}


def build_encoder(name: str = "hashing", **options) -> Encoder:
    """An encoder of the registry ``ENCODERS``; others can be added to it."""
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder: {name!r}")
    return ENCODERS[name](**options)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def l2_normalize(v: Column | str) -> Column:
    """array<double> of unit length; a zero vector stays zero."""
    c = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(c, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def encode(df: DataFrame, make: Callable[[], Encoder], text: str = "text", into: str = "v", query: bool = False) -> DataFrame:
    """df with unit vectors of ``text`` in ``into``. The encoder is made once
    for each Python worker task, texts reach it in batches; null is as ""."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make()
        call = encoder.encode_query if query else encoder.encode
        for texts in batches:
            v = np.asarray(call([t or "" for t in texts.to_pylist()]), np.float64).reshape(len(texts), -1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))

    return df.withColumn(into, run(F.col(text)))


def scores(vectors: DataFrame, queries: DataFrame, key: str = "slot") -> DataFrame:
    """(qid, key, score): all inner products of queries(qid, v) with
    vectors(key, v). A result of that size is what is asked for; the side of
    the queries is the stated query set."""
    q = queries.select("qid", F.col("v").alias("_q"))
    return vectors.select(key, "v").crossJoin(q).select("qid", key, dot(F.col("v"), F.col("_q")).alias("score"))


class _Best:
    """The best k of each of a group of queries among the rows seen so far, equal
    scores in the order of the key; some 2k entries of a query are held at most."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))]
        self.size = 0

    def _reaching(self, scores: np.ndarray) -> np.ndarray:
        # a score is rounded only when it is taken: half a digit below the floor it may still reach it
        return scores >= (self.floor - 0.6 * 10.0**-DIGITS)[:, None]

    def add(self, scores: np.ndarray, first: int, keys: pa.Array) -> None:
        """scores: a row for each query, a column for each of the rows from ``first``."""
        taken = self._reaching(scores)
        rows = scores.shape[1]
        if rows > self.k and np.count_nonzero(taken) > self.k * len(scores):
            self.floor = np.maximum(self.floor, np.round(np.partition(scores, rows - self.k, axis=1)[:, rows - self.k], DIGITS))
            taken = self._reaching(scores)
        query, row = np.nonzero(taken)
        if not len(query):
            return
        self.held.append((query.astype(np.int32), np.round(scores[query, row], DIGITS), row + first))
        self.size += len(query)
        if self.size > 2 * self.k * len(self.floor) + 20_000:
            self.settle(keys)

    def settle(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row) of the best k of each query, by query and score; all others are dropped."""
        query, score, row = (np.concatenate(x) for x in zip(*self.held))
        order = pc.sort_indices(keys.take(pa.array(row))).to_numpy()
        order = order[np.lexsort((-score[order], query[order]))]
        query = query[order]
        begin = np.searchsorted(query, np.arange(len(self.floor) + 1))
        keep = np.arange(len(query)) - begin[query] < self.k
        query, score, row = query[keep], score[order][keep], row[order][keep]
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.floor[full] = score[np.searchsorted(query, full) + self.k - 1]
        self.held, self.size = [(query, score, row)], len(query)
        return query, score, row


class _Found:
    """The best k of each query of a block, with the columns of their rows. Queries
    are taken in groups, vectors in pieces, so what is multiplied at a time has
    TILE_QUERIES * TILE_ROWS numbers, however many queries go along."""

    def __init__(self, matrix: np.ndarray, k: int) -> None:
        self.parts = [(matrix[i : i + TILE_QUERIES], _Best(len(matrix[i : i + TILE_QUERIES]), k)) for i in range(0, len(matrix), TILE_QUERIES)]
        self.rows: pa.Table | None = None
        self.most = STORED_ROWS

    def _keys(self) -> pa.Array:
        return self.rows.column(0).chunk(0)

    def add(self, batch: pa.RecordBatch, vectors: np.ndarray) -> None:
        first = 0 if self.rows is None else self.rows.num_rows
        own = pa.Table.from_batches([batch])
        self.rows = (own if self.rows is None else pa.concat_tables([self.rows, own])).combine_chunks()
        keys = self._keys()
        for at in range(0, len(vectors), TILE_ROWS):
            piece = vectors[at : at + TILE_ROWS].T
            for queries, best in self.parts:
                best.add(queries @ piece, first + at, keys)
        if self.rows.num_rows > self.most:
            self._drop()

    def _drop(self) -> None:
        """Rows that no query keeps go."""
        used = np.zeros(self.rows.num_rows, bool)
        for _, best in self.parts:
            used[best.settle(self._keys())[2]] = True
        now = np.cumsum(used) - 1
        for _, best in self.parts:
            query, score, row = best.held[0]
            best.held = [(query, score, now[row])]
        self.rows = self.rows.take(pa.array(np.flatnonzero(used))).combine_chunks()
        self.most = max(STORED_ROWS, 2 * self.rows.num_rows)

    def batches(self, qids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            return
        first = 0
        for queries, best in self.parts:
            query, score, row = best.settle(self._keys())
            kept = self.rows.take(pa.array(row))
            own = {"qid": qids.take(pa.array(query + first)), **{c: kept.column(c) for c in kept.column_names}, "score": pa.array(score)}
            yield from pa.table(own).to_batches(max_chunksize=OUT_ROWS)
            first += len(queries)


def topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "slot", keep: tuple[str, ...] = ()) -> DataFrame:
    """(qid, key, keep..., score, rank): the best k of each query, exactly, equal
    scores in the order of the key.

    queries(qid, v) go along with the scan in blocks of QUERY_NUMBERS numbers
    and of KEPT_ROWS rows that a task keeps for them; of several blocks, each
    one's result is written before the next is read. A task keeps k rows for
    each query, so k rows for each query and task are shuffled, not all
    products; vectors are read in no more tasks than there are cores. Vectors
    of another length than the queries raise an error; null vectors are left out.
    """
    spark = vectors.sparkSession
    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in (key, *keep))
    qtype = queries.schema["qid"].dataType
    schema = f"qid {qtype.simpleString()}, {fields}, score double"
    read = vectors.where("v is not null").select(key, *keep, "v").coalesce(spark.sparkContext.defaultParallelism)
    found = None
    blocks = _vector_blocks(queries, k)
    block = next(blocks, None)
    while block is not None:
        part = _best_of_block(read, block, k, schema, to_arrow_type(qtype))
        block = next(blocks, None)
        if block is not None or found is not None:
            part = staged(part, "best")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), key)
    # shuffled here: else the planner first sorts the rows of each task to keep k of a query, which they are already
    return found.repartition("qid").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vector_blocks(queries: DataFrame, k: int) -> Iterator[tuple[list, np.ndarray]]:
    qids: list = []
    rows: list = []
    for r in queries.where("v is not null").select("qid", "v").repartition(1).toLocalIterator():
        qids.append(r.qid), rows.append(np.array(r.v, np.float64))
        if len(rows) * len(r.v) >= QUERY_NUMBERS or len(rows) * k >= KEPT_ROWS:
            yield qids, np.array(rows)
            qids, rows = [], []
    if qids:
        yield qids, np.array(rows)


def _best_of_block(vectors: DataFrame, block: tuple[list, np.ndarray], k: int, schema: str, qid_type: pa.DataType) -> DataFrame:
    told = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = told.value
        best = _Found(matrix, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            if len(flat) != batch.num_rows * matrix.shape[1]:
                raise ValueError("vectors and queries differ in length")
            best.add(batch.select(batch.schema.names[:-1]), flat.reshape(batch.num_rows, -1))
        yield from best.batches(pa.array(qids, qid_type))

    return vectors.mapInArrow(run, schema)

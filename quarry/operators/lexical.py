"""BM25 over chunks, as tables: postings, terms, lengths, corpus statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import _fold_table, build_tokenizer, tokenized, tokens
from quarry.session import staged

#: Decimals at which scores are ranked, so that the order does not hang on the order of additions.
DIGITS = 6
#: Texts whose terms are counted at a time, and folded runs that a task remembers.
TEXTS, RUNS = 500, 200_000


@dataclass(frozen=True)
class BM25:
    """tokenizer: name of one of ``text.TOKENIZERS``, for chunks and queries alike."""

    k1: float = 0.8
    b: float = 0.8
    tokenizer: str = "plain"


def term_rows(df: DataFrame, keep: tuple[str, ...], text: str = "text", tokenizer: str = "plain") -> DataFrame:
    """(keep..., term, tf, dl): one row for each distinct term of each text; dl
    is the number of all its tokens. All tokens of a text stand in its row, so
    they are counted there and nothing is shuffled; null and empty texts have
    no row."""
    split = build_tokenizer(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _fold_table()
        find = re.compile(r"[^\W_]+").findall
        memo: dict[str, str] = {}

        def plain(text: str) -> tuple[dict[str, int], int]:
            """As split does, but each distinct run is folded once."""
            counts: dict[str, int] = {}
            runs = find(text)
            for run, n in Counter(runs).items():
                term = memo.get(run)
                if term is None:
                    if len(memo) > RUNS:
                        memo.clear()
                    term = memo[run] = run.lower().translate(fold)
                counts[term] = counts.get(term, 0) + n
            return counts, len(runs)

        def other(text: str) -> tuple[dict[str, int], int]:
            found = split(text)
            return Counter(found), len(found)

        counted = plain if tokenizer == "plain" else other
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):  # a text has a hundred rows
            sizes, terms, tfs, dls = [], [], [], []
            for t in batch.column(len(keep)).to_pylist():
                counts, dl = counted(t or "")
                terms += counts
                tfs += counts.values()
                sizes.append(len(counts))
                dls.append(dl)
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [batch.column(i).take(row) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(np.repeat(np.array(dls, np.int64), sizes))], [*keep, "term", "tf", "dl"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(count, f"{kinds}, term string, tf bigint, dl bigint")


def term_freq(chunks: DataFrame, key: str = "slot") -> DataFrame:
    """(key, term, tf): occurrences of each term in each chunk. Narrow."""
    return term_rows(chunks, (key,)).select(key, "term", "tf")


def doc_freq(tf: DataFrame) -> DataFrame:
    """(term, df): chunks that hold the term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame, key: str = "slot") -> DataFrame:
    """(key, dl): tokens of each chunk, repeated ones too. Narrow: no shuffle."""
    return chunks.select(key, F.coalesce(F.size(tokens("text")), F.lit(0)).cast("bigint").alias("dl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(n, avgdl): one row. Chunks without tokens count."""
    return lengths(chunks).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf_of(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def terms_table(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf). The one row of statistics is broadcast."""
    return doc_freq(tf).join(F.broadcast(stats.select("n"))).select("term", "df", idf_of(F.col("df"), F.col("n")).alias("idf"))


def weight_of(tf: Column, dl: Column, avgdl: Column, idf: Column, p: BM25) -> Column:
    return idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * dl / avgdl))


def query_terms(queries: DataFrame, tokenizer: str = "plain") -> DataFrame:
    """(qid, term): the distinct terms of each query. Null texts have none."""
    return queries.select("qid", F.explode(F.array_distinct(tokenized("text", tokenizer))).alias("term")).distinct()


def postings(chunks: DataFrame, wanted: DataFrame | None = None, tokenizer: str = "plain") -> DataFrame:
    """(term, slot, doc_id, tf, dl). wanted(term) restricts to these terms. Narrow but for that join."""
    rows = term_rows(chunks, ("slot", "doc_id"), tokenizer=tokenizer).select("term", "slot", "doc_id", "tf", "dl")
    return rows if wanted is None else rows.join(wanted.select("term").distinct(), "term", "left_semi")


def postings_stats(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """(n, avgdl) as ``corpus_stats``, from stored postings: texts are not read."""
    total = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t"))
    return chunks.agg(F.count("slot").alias("n")).join(total).select("n", F.coalesce(F.col("t") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("avgdl"))


@dataclass(frozen=True)
class Known:
    """What a collection knows of itself: the number of chunks, their mean
    length, and terms(term, df) where these are stored; what is not known is
    counted from the postings."""

    n: int
    avgdl: float
    terms: DataFrame | None = None


def weighed_terms(stored: DataFrame, chunks: DataFrame, queries: DataFrame, known: Known | None = None, tokenizer: str = "plain") -> DataFrame:
    """(qid, term, idf, avgdl): the terms of the queries that the collection
    has. A table of the size of the query set."""
    wanted = query_terms(queries, tokenizer)
    df = known.terms if known is not None else None
    if df is None:
        df = doc_freq(stored)  # of all terms: a join with the wanted ones would shuffle the postings, not their counts
    rows = wanted.join(df, "term")
    if known is not None:
        rows = rows.withColumn("n", F.lit(known.n)).withColumn("avgdl", F.lit(known.avgdl))
    else:
        rows = rows.join(F.broadcast(postings_stats(stored, chunks)))
    return rows.select("qid", "term", idf_of(F.col("df"), F.col("n")).alias("idf"), "avgdl")


def _allowed_only(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if allowed is None:
        return rows
    key = "slot" if "slot" in allowed.columns else "doc_id"
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def bm25_scores(chunks: DataFrame, queries: DataFrame, p: BM25 = BM25(), allowed: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(qid, slot, doc_id, score): all chunks with a score above 0.

    stored: the postings of the chunks; without, they are counted and written
    once. allowed(slot or doc_id): only these are scored; statistics stay
    those of the whole collection. Terms outside the collection add nothing; a
    repeated term of a query counts once. The result has up to a row for every
    query and chunk: as in ``bm25_topk`` postings are dealt by chunk, and scores
    leave their task in batches, so neither (query, posting) rows nor scores
    are shuffled.
    """
    stored = staged(postings(chunks, tokenizer=p.tokenizer), "postings") if stored is None else stored
    return _scored(chunks, queries, None, p, allowed, stored, None)


def pair_scores(chunks: DataFrame, queries: DataFrame, pairs: DataFrame, p: BM25 = BM25(), stored: DataFrame | None = None) -> DataFrame:
    """(qid, slot, score) of given pairs(qid, slot) with a score above 0: the
    postings of other chunks are not weighed."""
    stored = staged(postings(chunks, tokenizer=p.tokenizer), "postings") if stored is None else stored
    told = weighed_terms(stored, chunks, queries, tokenizer=p.tokenizer)
    found = stored.join(told.select("term").distinct(), "term", "left_semi").join(pairs.select("qid", "slot").distinct(), "slot")
    rows = found.join(told, ["qid", "term"])
    return rows.groupBy("qid", "slot").agg(F.sum(weight_of(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"), p)).alias("score"))


#: Rows (query, term), and rows that are kept of a task, for which queries go along with one pass over the postings.
TERM_ROWS, KEPT_ROWS = 500_000, 2_000_000
#: Chunks whose postings of the queries' terms a task holds at a time, and tokens of these: no chunk has more postings than tokens.
HELD_CHUNKS, HELD_TOKENS = 50_000, 4_000_000


def _query_blocks(told: DataFrame, k: int) -> Iterator[dict]:
    """{qid: [(term, idf)]} of so many queries as go along at a time; no more are on the driver."""
    block: dict = {}
    size = 0
    for r in told.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("own")).toLocalIterator():
        if block and (size + len(r.own) > TERM_ROWS or len(block) * k >= KEPT_ROWS):
            yield block
            block, size = {}, 0
        block[r.qid] = [(x.term, x.idf) for x in r.own]
        size += len(r.own)
    if block:
        yield block


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, p: BM25 = BM25(), allowed: DataFrame | None = None, stored: DataFrame | None = None, known: Known | None = None) -> DataFrame:
    """(qid, slot, doc_id, score, rank): the best k chunks of each query, as
    ``top`` of ``bm25_scores``, without a row for every (query, chunk).

    The queries' terms go along in blocks; of several blocks, each one's result
    is written before the next is read. Postings of these terms are dealt by
    chunk into parts of HELD_CHUNKS and HELD_TOKENS at most, of which a task
    holds one at a time. For a query, it adds up the postings of its terms at
    the chunks that they touch, and keeps k rows over all its parts, so k rows
    for each query and task are shuffled.
    """
    stored = staged(postings(chunks, tokenizer=p.tokenizer), "postings") if stored is None else stored
    order = Window.partitionBy("qid").orderBy(F.round("score", DIGITS).desc(), "slot")
    # shuffled here: else the planner first sorts the rows of each task to keep k of a query, which they are already
    found = _scored(chunks, queries, k, p, allowed, stored, known).repartition("qid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(chunks: DataFrame, queries: DataFrame, k: int | None, p: BM25, allowed: DataFrame | None, stored: DataFrame, known: Known | None) -> DataFrame:
    """(qid, slot, doc_id, score): all scores above 0, or with k those that a task keeps."""
    spark = chunks.sparkSession
    if known is None:
        one = postings_stats(stored, chunks).first()
        known = Known(one.n, one.avgdl)
    told = weighed_terms(stored, chunks, queries, known, p.tokenizer)
    qid_type = to_arrow_type(queries.schema["qid"].dataType)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, slot bigint, doc_id {stored.schema['doc_id'].dataType.simpleString()}, score double"
    parts = max(spark.sparkContext.defaultParallelism, -(-known.n // HELD_CHUNKS), int(known.n * known.avgdl // HELD_TOKENS) + 1)
    found = None
    blocks = _query_blocks(told, k or 0)
    block = next(blocks, None)
    while block is not None:
        part = _scored_block(spark, _allowed_only(stored, allowed), block, known.avgdl or 1.0, k, p, schema, qid_type, parts)
        block = next(blocks, None)
        if k is not None and (block is not None or found is not None):
            part = staged(part, "best")
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], schema) if found is None else found


#: Terms of very many chunks whose weights a task also holds as a number for every chunk.
FULL_ROWS = 60


class _Held:
    """The postings of a part by term: ``at`` are places in ``slots``, a term has
    those from begin[t] to begin[t + 1]. Numbers only are kept of the batches,
    and of doc_id one for each slot."""

    def __init__(self, batches: Iterator[pa.RecordBatch], terms: int) -> None:
        parts, docs = [], []
        for b in batches:
            if b.num_rows:
                slot = b.column(0).to_numpy()
                own, first = np.unique(slot, return_index=True)
                docs.append((own, b.column(1).take(pa.array(first))))
                parts.append((slot.copy(), b.column(2).to_numpy().astype(np.int32), b.column(3).to_numpy().copy()))
        if not parts:
            self.slots = np.zeros(0, np.int64)
            return
        self.slots, first = np.unique(np.concatenate([s for s, _ in docs]), return_index=True)
        self.docs = pa.chunked_array([d for _, d in docs]).combine_chunks().take(pa.array(first))
        del docs
        t = np.concatenate([x for _, x, _ in parts])
        order = np.argsort(t, kind="stable")
        self.begin = np.searchsorted(t[order], np.arange(terms + 1))
        del t
        at = np.concatenate([np.searchsorted(self.slots, x).astype(np.int32) for x, _, _ in parts])
        self.at = at[order]
        del at
        self.weight = np.concatenate([x for _, _, x in parts])
        del parts
        self.weight = self.weight[order]
        self._score, self._product = np.zeros(len(self.slots)), np.zeros(len(self.slots))  # of one query at a time
        self._rows: dict[int, np.ndarray] = {}

    def _add(self, term: int, idf: float) -> None:
        a, b = self.begin[term], self.begin[term + 1]
        if b - a > len(self.slots) // 4 and (term in self._rows or len(self._rows) < FULL_ROWS):
            row = self._rows.get(term)
            if row is None:
                row = self._rows[term] = np.zeros(len(self.slots))
                row[self.at[a:b]] = self.weight[a:b]
            self._score += np.multiply(row, idf, out=self._product)
        else:  # a term is at a chunk once
            self._score[self.at[a:b]] += idf * self.weight[a:b]

    def scores(self, terms: np.ndarray, idf: np.ndarray, k: int | None = None, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(places in slots, in their order; scores above 0) of a query; with k
        those may be left out that k others are above, or that are below floor."""
        own = [(i, x) for i, x in zip(terms.tolist(), idf.tolist()) if self.begin[i] < self.begin[i + 1]]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0)
        score = self._score
        for i, x in own:
            self._add(i, x)
        if sum(self.begin[i + 1] - self.begin[i] for i, _ in own) * 4 <= len(score):
            hit = np.unique(np.concatenate([self.at[self.begin[i] : self.begin[i + 1]] for i, _ in own]))
            value = score[hit]
            score[hit] = 0.0
            return hit, value
        some = score[::8]
        least = np.partition(some, len(some) - k)[len(some) - k] if not floor and k is not None and len(some) > k else floor  # k scores at least reach it
        hit = np.flatnonzero(score >= least - 1.1 * 10.0**-DIGITS) if least > 1e-5 else np.flatnonzero(score)
        value = score[hit]
        score[:] = 0.0
        return hit, value

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        hit, value = self.scores(terms, idf, k, floor)
        if floor:
            keep = np.round(value, DIGITS) >= floor
            hit, value = hit[keep], value[keep]
        if len(hit) > k:
            keep = value >= np.partition(value, len(value) - k)[len(value) - k] - 1.1 * 10.0**-DIGITS
            hit, value = hit[keep], value[keep]
        order = np.lexsort((hit, -np.round(value, DIGITS)))[:k]
        return hit[order], value[order]


class _Kept:
    """The best k of each query over the parts of a task: two numbers a row, and doc_id once for a slot."""

    def __init__(self, queries: int, k: int) -> None:
        self.slot, self.score = np.zeros((queries, k), np.int64), np.zeros((queries, k))
        self.size = np.zeros(queries, np.int64)
        self.floor = np.zeros(queries)  # the rounded score of row k; 0: there are fewer
        self._docs: list[tuple[np.ndarray, pa.Array]] = []

    def add(self, held: _Held, asked: list[tuple]) -> None:
        k = self.slot.shape[1]
        used = np.zeros(len(held.slots), bool)
        for i, (_, terms, idf) in enumerate(asked):
            hit, value = held.best(terms, idf, k, self.floor[i])
            if not len(hit):
                continue
            used[hit] = True
            slot, n = held.slots[hit], self.size[i]
            if n:
                slot, value = np.concatenate([self.slot[i, :n], slot]), np.concatenate([self.score[i, :n], value])
                order = np.lexsort((slot, -np.round(value, DIGITS)))[:k]
                slot, value = slot[order], value[order]
            n = self.size[i] = len(slot)
            self.slot[i, :n], self.score[i, :n] = slot, value
            if n == k:
                self.floor[i] = np.round(value[-1], DIGITS)
        at = np.flatnonzero(used)
        self._docs.append((held.slots[at], held.docs.take(pa.array(at))))

    def rows(self) -> tuple[np.ndarray, pa.Array]:
        """(slots in order, their doc_id) of all that may be kept."""
        slots = np.concatenate([s for s, _ in self._docs])
        order = np.argsort(slots)
        return slots[order], pa.chunked_array([d for _, d in self._docs]).combine_chunks().take(pa.array(order))


#: Rows of scores that leave a task at a time.
OUT_ROWS = 50_000


def _leaving(found: Iterator[tuple], slots: np.ndarray, docs: pa.Array, qid_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """found: (qid, places in slots and docs, scores); a query with very many rows leaves in several batches."""

    def batch(own: list[tuple]) -> Iterator[pa.RecordBatch]:
        qids = pa.array([q for q, _, _ in own], qid_type)
        query = np.repeat(np.arange(len(own)), [len(h) for _, h, _ in own])
        hit, value = np.concatenate([h for _, h, _ in own]), np.concatenate([v for _, _, v in own])
        for i in range(0, len(hit), OUT_ROWS):
            at = hit[i : i + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query[i : i + OUT_ROWS])), pa.array(slots[at]), docs.take(pa.array(at)), pa.array(value[i : i + OUT_ROWS])], ["qid", "slot", "doc_id", "score"])

    own, size = [], 0
    for one in found:
        if len(one[1]):
            own.append(one)
            size += len(one[1])
        if size >= OUT_ROWS:
            yield from batch(own)
            own, size = [], 0
    if own:
        yield from batch(own)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of each part; the parts come one after the other, the last column is their number."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            part = b.column(b.num_columns - 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            yield from ((int(part[i]), b.slice(i, j - i)) for i, j in zip(cuts, cuts[1:]) if i < j)

    seen: set[int] = set()
    for part, own in groupby(pieces(), lambda x: x[0]):
        if part in seen:
            raise ValueError("the rows of a part do not come together")
        seen.add(part)
        yield (b for _, b in own)


def _scored_block(spark, stored: DataFrame, block: dict, avgdl: float, k: int | None, p: BM25, schema: str, qid_type: pa.DataType, parts: int) -> DataFrame:
    terms = sorted({t for own in block.values() for t, _ in own})
    number = {t: i for i, t in enumerate(terms)}
    asked = [(qid, np.array([number[t] for t, _ in own], np.int64), np.array([x for _, x in own])) for qid, own in block.items()]
    told = spark.sparkContext.broadcast((asked, len(terms)))
    ids = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "_term": pa.array(range(len(terms)), pa.int32())}))
    # dealt by chunk; the numbers of the terms, no more than TERM_ROWS, replace their texts before the shuffle
    weight = F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / avgdl))
    rows = stored.join(F.broadcast(ids), "term").select("slot", "doc_id", F.col("_term").alias("t"), weight.alias("w")).repartition(parts, "slot").withColumn("_part", F.spark_partition_id())
    if k is not None:  # a task takes several parts, one by one, and keeps k rows of all
        rows = rows.coalesce(spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n_terms = told.value
        kept = None
        for own in _by_part(batches):
            held = _Held(own, n_terms)
            if k is None:
                yield from _leaving(((qid, *held.scores(terms, idf)) for qid, terms, idf in asked), held.slots, held.docs, qid_type)
            else:
                kept = kept or _Kept(len(asked), k)
                kept.add(held, asked)
            del held  # before the next one is made
        if kept is not None:
            slots, docs = kept.rows()
            found = ((asked[i][0], np.searchsorted(slots, kept.slot[i, :n]), kept.score[i, :n]) for i, n in enumerate(kept.size.tolist()))
            yield from _leaving(found, slots, docs, qid_type)

    return rows.mapInArrow(run, schema)


def top(scores: DataFrame, k: int, by: str = "qid", tie: str = "slot") -> DataFrame:
    """The best k of each ``by`` with ``rank``; equal (rounded) scores by ``tie``.
    The planner keeps k rows of each group before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.round("score", DIGITS).desc(), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def padded(best: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Lists shorter than k filled with the first slots that they lack, score 0.
    A list lacks at most k rows, and no more than k of the first 2k slots can
    stand in it, so 2k slots of the collection are enough."""
    first = chunks.select("slot", "doc_id").orderBy("slot").limit(2 * k)
    short = queries.select("qid").distinct().join(best.groupBy("qid").agg(F.count("*").alias("have")), "qid", "left").select("qid", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < k)
    lack = short.join(F.broadcast(first)).join(best.select("qid", "slot"), ["qid", "slot"], "left_anti")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("slot"))
    fill = lack.withColumn("rank", (n + F.col("have")).cast("int")).where(F.col("rank") <= k).select("qid", "slot", "doc_id", F.lit(0.0).alias("score"), "rank")
    return best.select("qid", "slot", "doc_id", "score", "rank").unionByName(fill)

"""Occurrences and records of every distinct term of a collection.

Method: burst-trie counting. Each task adds the terms of its records to a
burst trie: inner nodes branch on the next character, containers hold the
remaining suffixes with two counters and burst into a node when they grow too
large. A task emits its containers as (path, suffixes, counters) rows. The
sizes of these rows show which prefixes are hot; a term is routed by its
shortest prefix that is not hot. Matching subtrees of all tasks meet in one
place and are merged there, again in a burst trie.

No route holds more than about HOT_ENTRIES entries, whatever the size of the
collection: only prefixes above a share of all entries come to the driver, so
routes are also parted by a hash of the whole term, into as many parts as a
prefix just below that share needs, and prefixes that are hot at the greatest
length (identifiers, addresses) into as many as they need themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.forms import current_rows
from quarry.llm.terms import Folder
from quarry.session import staged

#: Suffixes in a container before it bursts.
CONTAINER = 512
#: Terms in a task's trie before it is emitted and started anew.
TRIE_TERMS = 200_000
#: Characters of the shortest route, and of the longest that is considered.
ROUTE_MIN, ROUTE_MAX = 2, 12
#: Entries behind a prefix from which it is hot, at least; and the least share of all entries.
HOT_ENTRIES, HOT_SHARE = 50_000, 1000

PARTS = "path string, suffixes array<string>, occurrences array<bigint>, records array<bigint>, docs bigint"


class BurstTrie:
    """Maps strings to (occurrences, records)."""

    def __init__(self, container: int = CONTAINER) -> None:
        self.container = container
        self.root: dict = {}  # a node: character -> node (dict) or container (_Leaf); '' -> counters of the path itself
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node = self.root
        for depth, ch in enumerate(term):
            child = node.get(ch)
            if child is None:
                child = node[ch] = _Leaf()
            if type(child) is _Leaf:
                suffix = term[depth + 1 :]
                entry = child.get(suffix)
                if entry is None:
                    child[suffix] = [occurrences, records]
                    self.size += 1
                    if len(child) > self.container:
                        node[ch] = _burst(child)
                else:
                    entry[0] += occurrences
                    entry[1] += records
                return
            node = child
        entry = node.get("")
        if entry is None:
            node[""] = [occurrences, records]
            self.size += 1
        else:
            entry[0] += occurrences
            entry[1] += records

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(path, suffix -> counters), paths ascending."""
        stack: list[tuple[str, object]] = [("", self.root)]
        while stack:
            path, node = stack.pop()
            if type(node) is _Leaf:
                yield path, node
            else:
                if "" in node:
                    yield path, {"": node[""]}
                stack += [(path + ch, node[ch]) for ch in sorted(node, reverse=True) if ch]


class _Leaf(dict):
    """Suffix -> [occurrences, records]."""


def _burst(leaf: _Leaf) -> dict:
    node: dict = {}
    for suffix, entry in leaf.items():
        if suffix:
            node.setdefault(suffix[0], _Leaf())[suffix[1:]] = entry
        else:
            node[""] = entry
    return node


def _parts(trie: BurstTrie, docs: int) -> pa.RecordBatch:
    """A trie's containers as rows; paths have ROUTE_MIN characters at least, where the terms are that long."""
    rows: list[tuple] = []
    short: dict[str, dict[str, list[int]]] = {}
    for path, leaf in trie.containers():
        if len(path) >= ROUTE_MIN:
            rows.append((path, leaf))
            continue
        for suffix, entry in leaf.items():
            term = path + suffix
            short.setdefault(term[:ROUTE_MIN], {})[term[ROUTE_MIN:]] = entry
    rows += short.items()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in rows] + [None], pa.string()),
            pa.array([list(leaf) for _, leaf in rows] + [None], pa.list_(pa.string())),
            pa.array([[e[0] for e in leaf.values()] for _, leaf in rows] + [None], pa.list_(pa.int64())),
            pa.array([[e[1] for e in leaf.values()] for _, leaf in rows] + [None], pa.list_(pa.int64())),
            pa.array([None] * len(rows) + [docs], pa.int64()),
        ],
        ["path", "suffixes", "occurrences", "records", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folder, trie, docs = Folder(), BurstTrie(), 0
    for batch in batches:
        occurrences: Counter[str] = Counter()
        records: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            docs += 1
            terms = folder.terms(text)
            occurrences.update(terms)
            records.update(set(terms))
            if len(records) > TRIE_TERMS:
                yield from _flush(trie, occurrences, records)
        for term, n in occurrences.items():
            trie.add(term, n, records[term])
        if trie.size > TRIE_TERMS:
            yield _parts(trie, 0)
            trie = BurstTrie()
    yield _parts(trie, docs)


def _flush(trie: BurstTrie, occurrences: Counter, records: Counter) -> Iterator[pa.RecordBatch]:
    for term, n in occurrences.items():
        trie.add(term, n, records[term])
    occurrences.clear()
    records.clear()
    if trie.size > TRIE_TERMS:
        yield _parts(trie, 0)
        trie.__init__()


def _hot_prefixes(parts: DataFrame) -> tuple[dict[str, int], int]:
    """(hot, parts): prefixes behind which too many entries stand for one
    route, with their entries, and into how many parts all other routes go. At
    most HOT_SHARE prefixes can be hot at each length."""
    sized = parts.where("path is not null").select("path", F.size("suffixes").cast("bigint").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ENTRIES, total // HOT_SHARE)
    if total <= least:
        return {}, 1
    depths = sized.select(F.explode(F.sequence(F.lit(ROUTE_MIN), F.least(F.char_length("path"), F.lit(ROUTE_MAX)))).alias("d"), "path", "n").where("d <= char_length(path)")
    prefixes = depths.groupBy(F.expr("substring(path, 1, d)").alias("prefix")).agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return {r.prefix: r.n for r in prefixes.collect()}, -(-least // HOT_ENTRIES)


def route_of(term: str, hot: Mapping[str, int], parts: int = 1) -> str:
    at = ROUTE_MIN
    while at < len(term) and at < ROUTE_MAX and term[:at] in hot:
        at += 1
    route = term[:at]
    if at == ROUTE_MAX and route in hot:
        parts = max(parts, -(-hot[route] // HOT_ENTRIES))
    return route if parts == 1 else f"{route} {zlib.crc32(term.encode('utf-8', 'surrogatepass')) % parts}"


def term_census(docs: DataFrame) -> DataFrame:
    """(term string, occurrences bigint, records bigint, total bigint): every
    distinct term, with the number of all records in ``total``.

    docs as in ``record_terms``. Null texts are no records; empty and blank
    texts count as records without terms. Without records there are no rows.
    """
    texts = current_rows(docs, "text").where("text is not null").select("text")
    parts = staged(texts.mapInArrow(_count, PARTS), "tries")
    total = parts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total"))
    hot, apart = _hot_prefixes(parts)

    def reroute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, list, list, list]] = []
            for row in batch.to_pylist():
                by: dict[str, tuple[list, list, list]] = {}
                for s, o, r in zip(row["suffixes"], row["occurrences"], row["records"]):
                    own = by.setdefault(route_of(row["path"] + s, hot, apart), ([], [], []))
                    own[0].append(row["path"] + s), own[1].append(o), own[2].append(r)
                out += [(k, *v) for k, v in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string())), *(pa.array([x[i] for x in out], pa.list_(pa.int64())) for i in (2, 3))], ["route", "terms", "occurrences", "records"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = BurstTrie(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != at and trie.size > TRIE_TERMS:
                    yield _counted(trie)
                    trie = BurstTrie()
                at = row["route"]
                for t, o, r in zip(row["terms"], row["occurrences"], row["records"]):
                    trie.add(t, o, r)
        yield _counted(trie)

    routed = parts.where("path is not null").select("path", "suffixes", "occurrences", "records").mapInArrow(reroute, "route string, terms array<string>, occurrences array<bigint>, records array<bigint>")
    merged = routed.repartition(F.col("route")).sortWithinPartitions("route").mapInArrow(merge, "term string, occurrences bigint, records bigint")
    return merged.join(F.broadcast(total))


def _counted(trie: BurstTrie) -> pa.RecordBatch:
    terms, occurrences, records = [], [], []
    for path, leaf in trie.containers():
        for suffix, (o, r) in leaf.items():
            terms.append(path + suffix), occurrences.append(o), records.append(r)
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["term", "occurrences", "records"])


def marked_terms(docs: DataFrame, min_records: int = 3, max_share: tuple[int, int] = (1, 3)) -> DataFrame:
    """``term_census`` with ``mark``: 'rare' for terms in fewer than
    ``min_records`` records, 'common' for terms in more than max_share (a
    fraction) of the records, else null. A term that is both is 'rare' and
    'common': it has a row for each."""
    up, down = max_share
    marks = F.array_compact(F.array(F.when(F.col("records") < min_records, "rare"), F.when(F.col("records") * down > F.col("total") * up, "common")))
    return term_census(docs).select("term", "occurrences", "records", F.explode_outer(marks).alias("mark"))


def marked_found(docs: DataFrame) -> DataFrame:
    """(term, mark): the terms of too few or too many records."""
    return marked_terms(docs).where("mark is not null").select("term", "mark")

"""Mixing sources to target weights.

Method: multivariate-hypergeometric splitting tree. The records of a source
fall into blocks by a seeded hash. A source's quota is so many draws of
blocks: whole passes over its permuted blocks, then a part of one more pass,
whose last block is cut to the record. Walking down a binary tree over the
output shards, the draws of all sources are split by the multivariate
hypergeometric distribution, so each shard gets an exact number of draws of
each source. Each shard takes the next draws of each source, disjoint from
those of the others, and orders its records at random by itself.

Only sizes of blocks come to the driver: BLOCKS for each source of the target
table, and as many again for the one block that is cut.

Shares are relative to a stated total. With the total of all documents a source
that cannot reach its target leaves the others with more than their weight of
what is really drawn. The balanced total is the greatest at which every source
that has documents reaches its target, so all of them hold their weights.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.bpe import TOKENIZERS, token_counts
from quarry.session import staged

BLOCKS = 256


@dataclass(frozen=True)
class Goal:
    """What one source is to give, in tokens."""

    source: str
    weight: float
    max_repeats: int
    own: int
    want: float  # weight times the stated total

    @property
    def most(self) -> int:
        return self.max_repeats * self.own

    @property
    def capped(self) -> bool:
        return self.want > self.most

    @property
    def planned(self) -> int:
        return int(min(round(self.want, 6), self.most))


@dataclass
class Plan:
    sized: DataFrame
    total: float
    goals: list[Goal]
    draws: list[tuple[str, int, int, int, bool]]  # source, block, copy, shard, cut
    cuts: list[tuple[str, int, int]]  # source, sub-block, last hash taken in it


def _hash(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(seed))


def sized_documents(documents: DataFrame, seed: int = 7, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, size: Column | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, h, block, sub), written once. size: another
    measure of a record than its tokens, a bigint that is never null."""
    counted = token_counts(documents, ("doc_id", "source"), name=tokenizer, folder=folder) if size is None else documents.select("doc_id", "source", size.alias("n_tokens"))
    h = _hash(seed)
    bits = BLOCKS.bit_length() - 1
    return staged(
        counted.select("doc_id", "source", "n_tokens", h.alias("h"))
        .withColumn("block", F.shiftrightunsigned("h", 64 - bits).cast("int"))
        .withColumn("sub", F.shiftrightunsigned("h", 64 - 2 * bits).bitwiseAND(BLOCKS - 1).cast("int")),
        "sized",
    )


def balanced_total(goals: list[Goal]) -> float:
    """The greatest total of which each source that has documents can give its weight; 0 without such a source."""
    return min((g.most / g.weight for g in goals if g.own and g.weight > 0), default=0.0)


def plan(documents: DataFrame, targets: DataFrame, shards: int = 64, seed: int = 7, total: str | float = "all", sized: DataFrame | None = None, **how) -> Plan:
    """Sizes all records once and lays down every draw.

    targets: a null weight counts as 0, null max_repeats as 1; repeated rows
    count once, rows of one source that differ add up their weights and the
    greatest max_repeats holds. A null source is no source. total: 'all' is the
    size of all documents, those of no target source included; 'balanced' that
    of ``balanced_total``; or a number. sized: what ``sized_documents`` gave.
    """
    sized = sized_documents(documents, seed, **how) if sized is None else sized
    wanted = (
        targets.where("source is not null")
        .select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .distinct().groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()
    )
    blocks = sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    everything = sized.agg(F.sum("n_tokens")).first()[0] or 0
    names = [r.source for r in wanted]
    size = {s: np.zeros(BLOCKS, np.int64) for s in names}
    for r in blocks.where(F.col("source").isin(names)).collect() if names else []:
        size[r.source][r.block] = r.n
    goals = [Goal(r.source, r.weight, r.max_repeats, int(size[r.source].sum()), r.weight * everything) for r in wanted]
    stated = everything
    if total != "all":
        stated = balanced_total(goals) if total == "balanced" else float(total)
        goals = [replace(g, want=g.weight * stated) for g in goals]

    rng = np.random.default_rng(seed)
    lists: list[list[tuple[int, int, bool]]] = []
    rests: dict[str, tuple[int, int]] = {}
    for g in goals:
        units: list[tuple[int, int, bool]] = []
        passes, rest = divmod(g.planned, g.own) if g.own else (0, 0)
        for copy in range(passes):
            units += [(int(b), copy, False) for b in rng.permutation(BLOCKS) if size[g.source][b]]
        for b in rng.permutation(BLOCKS):
            n = int(size[g.source][b])
            if not rest or not n:
                continue
            units.append((int(b), passes, n > rest))
            if n > rest:
                rests[g.source] = (int(b), rest)
                rest = 0
            else:
                rest -= n
        lists.append(units)
    draws = _split(goals, lists, shards, rng)
    return Plan(sized, float(stated), goals, draws, _cuts(sized, rests))


def _split(goals: list[Goal], lists: list[list[tuple[int, int, bool]]], shards: int, rng: np.random.Generator) -> list[tuple[str, int, int, int, bool]]:
    """Down the tree: which shard gets which draws."""
    out: list[tuple[str, int, int, int, bool]] = []
    at = [0] * len(lists)

    def down(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            for k, n in enumerate(counts):
                out.extend((goals[k].source, b, c, lo, cut) for b, c, cut in lists[k][at[k] : at[k] + int(n)])
                at[k] += int(n)
            return
        middle = (lo + hi) // 2
        left = int(round(int(counts.sum()) * (middle - lo) / (hi - lo)))
        part = rng.multivariate_hypergeometric(counts, left, method="marginals")
        down(lo, middle, part)
        down(middle, hi, counts - part)

    if lists:
        down(0, shards, np.array([len(x) for x in lists], np.int64))
    return out


def _cuts(sized: DataFrame, rests: dict[str, tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Where the cut block of each source ends: whole sub-blocks, then within
    one sub-block the records in the order of their hash."""
    if not rests:
        return []
    inside = F.lit(False)
    for source, (block, _) in rests.items():
        inside = inside | ((F.col("source") == source) & (F.col("block") == block))
    cut_rows = sized.where(inside)
    subs: dict[str, np.ndarray] = {s: np.zeros(BLOCKS, np.int64) for s in rests}
    for r in cut_rows.groupBy("source", "sub").agg(F.sum("n_tokens").alias("n")).collect():
        subs[r.source][r.sub] = r.n
    last = F.lit(False)
    left: dict[str, tuple[int, int]] = {}
    room = F.lit(0)
    for source, (_, rest) in rests.items():
        ends = np.cumsum(subs[source])
        sub = int(np.searchsorted(ends, rest, side="right"))
        left[source] = (sub, int(rest - (ends[sub - 1] if sub else 0)))
        last = last | ((F.col("source") == source) & (F.col("sub") == sub))
        room = F.when(F.col("source") == source, F.lit(left[source][1])).otherwise(room)
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    found = cut_rows.where(last).withColumn("upto", running).where(F.col("upto") <= room).groupBy("source").agg(F.max("h").alias("h")).collect()
    upto = {r.source: r.h for r in found}
    return [(s, sub, upto.get(s, -(2**63))) for s, (sub, _) in left.items()]


_DRAWS = T.StructType([T.StructField("source", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("copy", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("cut", T.BooleanType())])


def drawn(p: Plan, seed: int = 7) -> DataFrame:
    """(shard, doc_id, source, copy, n_tokens, mix_key): the collection. Within
    a shard, ascending mix_key is its random order. The table of draws has at
    most BLOCKS * (passes + 1) rows for each source; Spark broadcasts it while
    it is below the session's threshold and joins by (source, block) beyond."""
    spark = p.sized.sparkSession
    draws = spark.createDataFrame(p.draws, _DRAWS)
    rows = p.sized.join(draws, ["source", "block"])
    keep = ~F.col("cut")
    for source, sub, h in p.cuts:
        keep = keep | ((F.col("source") == source) & ((F.col("sub") < sub) | ((F.col("sub") == sub) & (F.col("h") <= h))))
    return rows.where(keep).select("shard", "doc_id", "source", "copy", "n_tokens", F.xxhash64("doc_id", "copy", "shard", F.lit(seed + 1)).alias("mix_key"))


def mixed(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """The collection of ``plan``, one partition or more for each shard, in random order within it."""
    rows = drawn(plan(documents, targets, **how), how.get("seed", 7))
    return rows.repartition("shard").sortWithinPartitions("shard", "mix_key")


_GOALS = "source string, weight double, max_repeats int, own_tokens bigint, target_tokens double, planned_tokens bigint, capped boolean, total_tokens double"


def mixture_report(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """(source, weight, max_repeats, own_tokens, target_tokens, planned_tokens,
    capped, total_tokens, drawn_tokens, drawn_records, most_used, share,
    of_total): what each source was to give and really gave, from the rows
    drawn. share is relative to all that was drawn, of_total to the stated
    total; both are null where that is 0."""
    p = plan(documents, targets, **how)
    goals = documents.sparkSession.createDataFrame([(g.source, g.weight, g.max_repeats, g.own, g.want, g.planned, g.capped, p.total) for g in p.goals], _GOALS)
    rows = drawn(p, how.get("seed", 7))
    got = rows.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count("*").alias("drawn_records"), (F.max("copy") + 1).alias("most_used"))
    report = goals.join(F.broadcast(got), "source", "left").fillna(0, ["drawn_tokens", "drawn_records", "most_used"])
    whole = report.agg(F.sum("drawn_tokens").alias("_whole"))
    shares = {"share": F.col("drawn_tokens") / F.nullif(F.col("_whole"), F.lit(0)), "of_total": F.col("drawn_tokens") / F.nullif("total_tokens", F.lit(0.0))}
    return report.join(F.broadcast(whole)).withColumns(shares).drop("_whole")


def both_reports(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """The report with ``basis`` 'all' and 'balanced', the total it is drawn for; texts are encoded once."""
    sized = sized_documents(documents, **how)
    parts = [mixture_report(documents, targets, total=t, sized=sized).withColumn("basis", F.lit(t)) for t in ("all", "balanced")]
    return parts[0].unionByName(parts[1])


def quotas(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(basis, source, own, planned, capped, exact, repeats_kept): the two
    mixtures with records measured in characters, so that SQL can tell what
    each source is to give. exact: what was drawn falls short of it by less
    than the source's largest record; repeats_kept: none is used more often
    than allowed."""
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    largest = documents.groupBy("source").agg(F.max(length).alias("_largest"))
    report = both_reports(documents, targets, size=length).join(largest, "source", "left")
    short = F.col("planned_tokens") - F.col("drawn_tokens")
    exact = (short == 0) | ((short > 0) & (short < F.col("_largest")))
    return report.select("basis", "source", F.col("own_tokens").alias("own"), F.col("planned_tokens").alias("planned"), "capped", exact.alias("exact"), (F.col("most_used") <= F.col("max_repeats")).alias("repeats_kept"))


def unreachable(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """(source): sources whose target is more than all their allowed repeats
    give. They are taken from the mixture that was drawn, where such a source
    falls short, and checked by its sizes."""
    return mixture_report(documents, targets, total="all", **how).where("drawn_tokens < target_tokens and capped").select("source")

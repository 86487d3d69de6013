"""One ranking from several differently scaled scores.

Method: in each list, a score becomes its empirical percentile, ties averaged,
(number below + (number equal + 1) / 2) / (n + 1), then the inverse normal of
it; a document's place follows from the weighted mean over all lists of the
query. A list in which a document does not occur adds the value of a score
below the whole list, 0.5 / (n + 1).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import staged

# Coefficients of the public rational approximation of the normal quantile (algorithm AS 241, PPND16).
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution for 0 < p < 1, as JVM expressions."""

    def ratio(parts: tuple, x: Column) -> Column:
        def poly(c: tuple) -> Column:
            out = F.lit(c[-1])
            for a in reversed(c[:-1]):
                out = out * x + F.lit(a)
            return out

        return poly(parts[0]) / poly(parts[1])

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(_MIDDLE, r - 1.6)).otherwise(ratio(_TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(_CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)


def list_scores(hits: DataFrame) -> DataFrame:
    """(qid, source, doc_id, score): one counting score for each document of a list.

    Of the rows of (qid, source, chunk_id) the latest run_ts counts (null is
    the oldest; of equal ones the greatest score); if its score is null or NaN
    the piece has none. A document has the score of its best piece. Rows with
    a null qid, source or doc_id belong to no list; a null chunk_id is one
    piece of its document. What comes together in a task are the rows of one
    document in one list.
    """
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    # least numbers for null, so that a row with a time and then one with a score wins
    latest = F.max(F.struct(F.coalesce(F.unix_micros(F.col("run_ts").cast("timestamp")), F.lit(-(2**63))).alias("t"), score.alias("s")))
    rows = hits.where("qid is not null and source is not null and doc_id is not null").select("qid", "source", "doc_id", "chunk_id", "score", "run_ts")
    # one shuffle serves both steps: pieces of a document in a list are few
    pieces = rows.repartition("qid", "source", "doc_id").groupBy("qid", "source", "doc_id", "chunk_id").agg(latest.alias("last"))
    return pieces.where("last.s is not null").groupBy("qid", "source", "doc_id").agg(F.max("last.s").alias("score"))


#: Rows of a list from which it is ranged over several tasks.
LONG_LIST = 1_000_000


def _placed(lists: DataFrame) -> DataFrame:
    """Lists of which each is sorted in one task."""
    key = Window.partitionBy("qid", "source")
    best, score = key.orderBy(F.col("score").desc(), "doc_id"), key.orderBy(F.col("score").desc())
    equal = F.count("*").over(score.rangeBetween(Window.currentRow, Window.currentRow))
    return lists.withColumn("place", F.row_number().over(best)).withColumn("first", F.rank().over(score)).withColumn("equal", equal).withColumn("n", F.count("*").over(key))


def _placed_in_ranges(lists: DataFrame, ranges: int) -> DataFrame:
    """Lists ranged over tasks by (qid, source, score, doc_id): places are found
    within each range and moved by the sizes of the ranges before."""
    ranged = lists.repartitionByRange(ranges, "qid", "source", F.col("score").desc(), "doc_id").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")  # the number of a part must not change when it is read again
    key = ["qid", "source"]
    sizes = ranged.groupBy(*key, "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("size").over(Window.partitionBy(*key)))
    local = ranged.withColumn("at", F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.col("score").desc(), "doc_id")))
    placed = local.join(before.select(*key, "part", "ahead", "n"), [*key, "part"]).withColumn("place", F.col("ahead") + F.col("at"))
    # a score's documents have consecutive places, so its group follows from the first and their number
    ties = placed.groupBy(*key, "score").agg(F.min("place").alias("first"), F.count("*").alias("equal"))
    return placed.join(ties, [*key, "score"])


def ranked_lists(lists: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """list_scores with, within (qid, source): ``n`` documents, ``place`` (1 is
    best, equal scores by doc_id), ``below`` and ``equal`` (documents with a
    lower score, with this score).

    A list may hold any share of all rows. Lists of more than ``long_list``
    rows are ranged over tasks, so many that a range has about that many rows;
    all others are sorted whole, with one shuffle.
    """
    lists = staged(lists, "lists")
    columns = ("qid", "source", "doc_id", "score", F.col("n").cast("bigint").alias("n"), F.col("place").cast("bigint").alias("place"), F.col("equal").cast("bigint").alias("equal"), (F.col("n") - F.col("first") - F.col("equal") + 1).cast("bigint").alias("below"))
    long = staged(lists.groupBy("qid", "source").agg(F.count("*").alias("rows")).where(F.col("rows") > long_list), "long")
    rows = long.agg(F.sum("rows")).first()[0]
    if not rows:
        return _placed(lists).select(*columns)
    told = long.select("qid", "source")
    apart = _placed_in_ranges(lists.join(told, ["qid", "source"], "left_semi"), max(2, -(-rows // long_list)))
    return _placed(lists.join(told, ["qid", "source"], "left_anti")).select(*columns).unionAll(apart.select(*columns))


def fused_ranking(hits: DataFrame, weights: Mapping[str, float] | None = None, head: int = 10, long_list: int = LONG_LIST) -> DataFrame:
    """(qid, doc_id, fused, lists, of_lists, worst_place, head): one value for
    each document of a query, from which its place follows.

    lists: lists of the query that hold the document; of_lists: lists of the
    query; worst_place: its lowest place in any of them; head: the value of a
    document that stood at place ``head`` in each list (at the last one of
    shorter lists). weights: by source, 1 where not given. A source without
    counting rows is no list.
    """
    placed = ranked_lists(list_scores(hits), long_list)
    w = F.lit(1.0)
    for source, value in (weights or {}).items():
        w = F.when(F.col("source") == source, F.lit(float(value))).otherwise(w)
    z = normal_quantile((F.col("below") + (F.col("equal") + 1) / 2) / (F.col("n") + 1))
    floor = normal_quantile(0.5 / (F.col("n") + 1))
    # what a document gains over being absent, so that absences need no rows
    gains = placed.select("qid", "source", "doc_id", "place", "n", (w * (z - floor)).alias("gain"))
    documents = gains.groupBy("qid", "doc_id").agg(F.sum("gain").alias("gain"), F.count("*").alias("lists"), F.max("place").alias("worst_place"))
    each = gains.where((F.col("place") == head) | ((F.col("place") == F.col("n")) & (F.col("n") < head))).select("qid", "source", "n", "gain")
    queries = each.groupBy("qid").agg(F.count("*").alias("of_lists"), F.sum(w).alias("weight"), F.sum(w * floor).alias("base"), F.sum("gain").alias("head"))
    value = lambda gain: (F.col(gain) + F.col("base")) / F.col("weight")
    return documents.join(queries, "qid").select("qid", "doc_id", value("gain").alias("fused"), "lists", "of_lists", "worst_place", value("head").alias("head"))


def fused_order(hits: DataFrame, weights: Mapping[str, float] | None = None, long_list: int = LONG_LIST) -> DataFrame:
    """(qid, doc_id, fused, rank): fused_ranking with ``rank``, 1 for the best
    document of the query, equal values by doc_id. Places are found as in
    ranked_lists."""
    fused = fused_ranking(hits, weights, long_list=long_list)
    value = F.round("fused", 9)
    value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # no zero with a sign
    placed = ranked_lists(fused.select("qid", F.lit("fused").alias("source"), "doc_id", value.alias("score")), long_list)
    return placed.select("qid", "doc_id", F.col("score").alias("fused"), F.col("place").alias("rank"))


def head_of_all_lists(hits: DataFrame, best: int = 10) -> DataFrame:
    """(qid, doc_id): documents among the ``best`` of every list of the query.

    They are taken from the head of the one order: whatever the lists' scales,
    such a document's fused value reaches that of one at place ``best`` in
    each. Those taken are then checked exactly in the single lists."""
    taken = fused_ranking(hits, head=best).where(F.col("fused") >= F.col("head") - 1e-9)
    return taken.where((F.col("lists") == F.col("of_lists")) & (F.col("worst_place") <= best)).select("qid", "doc_id")

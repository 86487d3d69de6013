"""How distinctive a term is for a record.

Method: residual inverse document frequency. The observed idf, -log2(df / N),
minus the idf that a Poisson model expects of a term with the same collection
frequency, -log2(1 - exp(-cf / N)), times the term's frequency in the record.
A term spread evenly over records scores about 0; one that few records use
repeatedly scores high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.forms import record_ids
from quarry.llm.terms import record_terms
from quarry.session import staged

#: A term in more than 1 / HOT_SHARE of all (record, term) rows is hot; fewer than HOT_SHARE terms can be.
HOT_SHARE = 1000


def residual_idf(df: Column, cf: Column, n: Column) -> Column:
    """idf minus its Poisson expectation, in bits. -expm1(-x) keeps precision for rare terms."""
    return -F.log2(df / n) + F.log2(-F.expm1(-cf / n))


def distinctive_terms(docs: DataFrame, keep_n: bool = False) -> DataFrame:
    """(doc_id, term, tf, df, cf, ridf, score), with keep_n also n, the number
    of records: every term of every record.

    df: records with the term, cf: its occurrences, both over all records; N
    counts every record, empty ones too. No records: no rows.

    The (record, term) rows are written once and read twice. Term statistics
    are combined map-side before their shuffle. They return to the rows by a
    broadcast for hot terms, of which there are fewer than HOT_SHARE by
    definition, and by a shuffle on the term for all others, so that no task
    gets the rows of a hot term.
    """
    rows = staged(record_terms(docs), "terms")
    stats = staged(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf")), "termstats")
    n = record_ids(docs).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = F.col("df") * HOT_SHARE > total
    hot_stats = stats.where(hot)
    cold_stats = stats.where(~hot)
    near = rows.join(F.broadcast(hot_stats), "term")
    far = rows.join(F.broadcast(hot_stats.select("term")), "term", "left_anti").join(cold_stats, "term")
    joined = near.select("doc_id", "term", "tf", "df", "cf").unionAll(far.select("doc_id", "term", "tf", "df", "cf"))
    ridf = residual_idf(F.col("df"), F.col("cf"), F.col("n"))
    return joined.join(F.broadcast(n)).select("doc_id", "term", "tf", "df", "cf", ridf.alias("ridf"), (F.col("tf") * ridf).alias("score"), *(["n"] if keep_n else []))


def least_ridf(n: Column, min_tf: int, max_df: int) -> Column:
    """The least residual idf of a term that at most ``max_df`` of n records
    hold and one of them ``min_tf`` times: it grows with the occurrences, of
    which there are one for each other record at least, and falls with the
    records. A little is taken off for rounding."""
    least = [residual_idf(F.lit(float(df)), F.lit(float(df + min_tf - 1)), n) for df in range(1, max_df + 1)]
    return F.least(*least) - 1e-9


def distinctive_found(docs: DataFrame, min_tf: int = 3, min_length: int = 5, min_df: int = 2, max_df: int = 4) -> DataFrame:
    """(doc_id, term): terms of letters only that a record uses repeatedly and
    few records share. Terms are taken by their residual idf, which must reach
    that of the least such term; those taken are then checked exactly."""
    scored = distinctive_terms(docs, keep_n=True)
    taken = scored.where(F.col("ridf") >= least_ridf(F.col("n"), min_tf, max_df))
    exact = (F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df) & (F.char_length("term") >= min_length) & F.col("term").rlike(r"^\p{L}+$")
    return taken.where(exact).select("doc_id", "term")

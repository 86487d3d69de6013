"""Changes to a table of documents, as plans over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "doc_id", order: str = "doc_ord") -> DataFrame:
    """Of several rows with one key the last in ``order`` wins. Null keys are left out."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, key: str = "doc_id", order: str = "doc_ord") -> DataFrame:
    """base with the rows of new put in or over those of the same key; of
    several new rows of a key the last wins. new has at least base's columns."""
    fresh = latest(new, key, order).select(base.columns)
    return base.join(fresh.select(key), key, "left_anti").select(base.columns).unionByName(fresh)


def delete(base: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """base without the rows whose key stands in gone; unknown keys change nothing."""
    return base.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(base.columns)


def merged_meta(old: Column, new: Column) -> Column:
    """Two JSON objects as one JSON text, fields of the new one winning. What is no JSON object counts as {}."""
    kind = "map<string,variant>"

    def fields(c: Column) -> Column:
        empty = F.from_json(F.lit("{}"), kind)
        return F.coalesce(F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), kind), empty)

    a, b = fields(old), fields(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def update_metadata(base: DataFrame, changes: DataFrame, merge: bool = True, key: str = "doc_id") -> DataFrame:
    """base with ``meta`` of the documents in changes(key, meta) merged or
    replaced; texts are untouched. One change for each key."""
    told = changes.select(key, F.col("meta").alias("_new"))
    joined = base.join(told.withColumn("_told", F.lit(True)), key, "left")
    fresh = merged_meta(F.col("meta"), F.col("_new")) if merge else F.col("_new")
    return joined.withColumn("meta", F.when(F.col("_told"), fresh).otherwise(F.col("meta"))).select(base.columns)


def assign_metadata(docs: DataFrame, by_doc: DataFrame | None = None, shared: str | None = None) -> DataFrame:
    """docs with ``meta``: from by_doc(doc_id, meta) where it has the document, else ``shared``, else {}."""
    default = F.lit(shared if shared is not None else "{}")
    if by_doc is None:
        return docs.withColumn("meta", default)
    told = by_doc.select("doc_id", F.col("meta").alias("_m"))
    return docs.drop("meta").join(told, "doc_id", "left").withColumn("meta", F.coalesce("_m", default)).drop("_m")

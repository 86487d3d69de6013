"""The pN_ queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, census, forms, mixture, pathjoin, rankmix, ridf, spans, splitter
from quarry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: ridf.distinctive_found(table(s, d, "docs")),
        "p1_scores": lambda s, d: ridf.distinctive_terms(table(s, d, "docs")).withColumns({c: F.round(c, 6) for c in ("ridf", "score")}),
        "p2_found": lambda s, d: census.marked_found(table(s, d, "docs")),
        "p2_census": lambda s, d: census.marked_terms(table(s, d, "docs")),
        "p3_found": lambda s, d: splitter.faulty_pieces(table(s, d, "docs"), table(s, d, "chunks")),
        "p3_pieces": lambda s, d: splitter.split_records(table(s, d, "docs")),
        "p3_cover": lambda s, d: splitter.coverage(table(s, d, "docs")),
        "p3_audit": lambda s, d: splitter.audit_pieces(table(s, d, "docs"), splitter.as_chunks(splitter.split_records(table(s, d, "docs")))).where("bad_range or too_long or bad_overlap or torn_word"),
        "p4_found": lambda s, d: pathjoin.near_duplicate_pairs(table(s, d, "docs")),
        "p4_groups": lambda s, d: pathjoin.record_groups(table(s, d, "docs")),
        "p5_found": lambda s, d: rankmix.head_of_all_lists(table(s, d, "hits")),
        "p5_order": lambda s, d: rankmix.fused_order(table(s, d, "hits")),
        "p6_found": lambda s, d: forms.same_looking_pairs(table(s, d, "docs")),
        "p7_ids": lambda s, d: bpe.token_ids(table(s, d, "documents")),
        "p7_decoded": lambda s, d: bpe.decoded(bpe.token_ids(table(s, d, "documents"))).select("doc_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5")),
        "p7_round_trip": lambda s, d: bpe.round_trip(table(s, d, "documents")),
        "p8_found": lambda s, d: mixture.unreachable(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_mix": lambda s, d: mixture.mixed(table(s, d, "documents"), table(s, d, "mix_targets"), total="balanced"),
        "p8_report": lambda s, d: mixture.both_reports(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_quotas": lambda s, d: mixture.quotas(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: spans.shared_pairs(table(s, d, "documents")),
        "p9_spans": lambda s, d: spans.shared_spans(table(s, d, "documents")),
        "p9_report": lambda s, d: spans.shared_report(table(s, d, "documents")),
    }

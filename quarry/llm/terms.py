"""Terms of a text: maximal runs of letters and digits of its consistent form,
in lower case, accents removed."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.forms import current_rows, rewriter

_RUNS = re.compile(r"[^\W_]+").findall
_MEMO_LIMIT = 1_000_000


class Folder:
    """Terms of texts; remembers how a run folds (bounded, refilled when full)."""

    def __init__(self) -> None:
        self.memo: dict[str, str] = {}
        self.form = rewriter()

    def fold(self, run: str) -> str:
        got = self.memo.get(run)
        if got is None:
            got = run.lower()
            if not got.isascii():
                got = "".join(c for c in unicodedata.normalize("NFD", got) if unicodedata.category(c) != "Mn")
            if len(self.memo) >= _MEMO_LIMIT:
                self.memo.clear()
            self.memo[run] = got
        return got

    def terms(self, text: str) -> list[str]:
        fold, memo = self.fold, self.memo.get
        # a run of nothing but folded-away marks gives no term
        return [t for t in [memo(run) or fold(run) for run in _RUNS(self.form(text))] if t]

    def counts(self, text: str) -> Counter[str]:
        runs = Counter(_RUNS(self.form(text)))
        out: Counter[str] = Counter()
        for run, n in runs.items():
            if term := self.fold(run):
                out[term] += n
        return out


def record_terms(docs: DataFrame) -> DataFrame:
    """(doc_id string, term string, tf int): one row per record and term.

    docs: doc_id, text, updated, doc_ord and any other columns. Only current
    rows count; a null text is no record; an empty or blank text gives no rows.
    Narrow after the choice of current rows: nothing is grouped here.
    """
    records = current_rows(docs, "text").where("text is not null")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            ids, terms, tfs = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = folder.counts(text)
                ids += [doc_id] * len(counts)
                terms += counts
                tfs += counts.values()
                if len(ids) > 100_000:
                    yield _rows(ids, terms, tfs)
                    ids, terms, tfs = [], [], []
            yield _rows(ids, terms, tfs)

    return records.mapInArrow(explode, "doc_id string, term string, tf int")


def _rows(ids: list, terms: list, tfs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["doc_id", "term", "tf"])

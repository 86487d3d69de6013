import datetime
import random

import pytest

DOCS = "doc_id string, doc_ord bigint, text string, meta string, deleted int, updated timestamp_ntz, term string, score double, path string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """docs of (doc_id, text[, day]) with columns whose names the operators use themselves."""

    def make(items):
        rows = []
        for k, item in enumerate(items):
            doc_id, text, day = (*item, 1)[:3]
            when = None if day is None else datetime.datetime(2024, 1, day)
            rows.append((doc_id, k, text, None, 0, when, "clash", float("nan"), "p"))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def phrases():
    """Texts of sentences over a small vocabulary, some shared."""
    rng = random.Random(7)
    words = ["lei", "prazo", "ação", "órgão", "multa", "fiscal", "contrato", "edital", "recurso", "licença", "água", "obra", "taxa", "norma", "juízo", "parte"]

    def text(n):
        return " ".join(rng.choice(words) + (rng.choice(",.") if rng.random() < 0.1 else "") for _ in range(n))

    return text, rng

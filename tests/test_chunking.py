import random

import pytest

from quarry.functions.text import WHITE_SPACE
from quarry.operators import chunking as ch

TEXTS = {
    "prose": "Primeiro parágrafo aqui.\n\nSegundo parágrafo, um pouco mais longo que o outro.\n\n\nTerceiro.",
    "faq": "P: o quê?\nR: isto.\n\nP: quando?\nR: já.",
    "crlf": "linha um\r\n\r\nlinha dois\rlinha três",
    "empty": "",
    "blank": " \n\n \t ",
    "line": "palavra " * 900,
    "run": "x" * 2100,
    "edges": "\xa0　dentro　\xa0",
    "half": "a" * 100 + " " + "b" * 150,
    "below": "a" * 99 + " " + "b" * 150,
    "accents": "ação é " * 50,
}


@pytest.mark.parametrize("mode", ["document", "window", "none", "paragraph", "structure", "hard"])
def test_contract(spark, mode):
    docs = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(TEXTS.items())], "doc_id string, doc_ord bigint, text string")
    chunks = ch.chunk(docs, mode, 200, 20)
    bad = {r.rule: r.violations for r in ch.contract_violations(chunks, docs, None if mode == "document" else 200).collect()}
    assert set(bad.values()) == {0}, bad
    got = {}
    for r in chunks.orderBy("slot").collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.chunk_id == f"{r.doc_id}#{r.chunk_ord}"
    assert "empty" not in got
    for name, rows in got.items():
        text = TEXTS[name].replace("\r\n", "\n").replace("\r", "\n")
        covered = "".join(text[r.start : r.end] for r in rows)
        squeeze = lambda s: "".join(c for c in s if c not in WHITE_SPACE)
        assert squeeze(covered) == squeeze(text)
        assert [r.chunk_ord for r in rows] == list(range(len(rows)))


def reference(piece, most):
    if len(piece) <= most:
        return [piece.strip(WHITE_SPACE)] if piece.strip(WHITE_SPACE) else []
    out = []
    while len(piece) > most:
        head = piece[:most]
        cut = max((i for i, c in enumerate(head) if c == " "), default=-1)
        cut = most if cut < most // 2 else cut
        if head[:cut].strip(WHITE_SPACE):
            out.append(head[:cut].strip(WHITE_SPACE))
        piece = piece[cut:]
    return out + ([piece.strip(WHITE_SPACE)] if piece.strip(WHITE_SPACE) else [])


def test_window_against_definition():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("ab  \n　é") for _ in range(rng.randrange(0, 80)))
        most = rng.randrange(2, 20)
        assert [text[a:b] for a, b in ch.split_window(text, most, 0)] == reference(text, most)


def test_boundary_at_half():
    assert ch.split_window(TEXTS["half"], 200, 0)[0] == (0, 100)
    assert ch.split_window(TEXTS["below"], 200, 0)[0] == (0, 200)


def test_arguments(spark):
    with pytest.raises(ValueError):
        ch.spans("t", "other")
    with pytest.raises(ValueError):
        ch.spans("t", "window", 1)


def test_own_splitter_and_resolve(spark):
    docs = spark.createDataFrame([("a", 0, "um dois"), ("b", 1, None)], "doc_id string, doc_ord bigint, text string")
    halves = ch.chunk(docs, lambda t, most, least: [(0, 2), (2, 2), (3, 7)])
    assert [(r.start, r.end, r.text) for r in halves.orderBy("slot").collect()] == [(0, 2, "um"), (3, 7, "dois")]
    hits = spark.createDataFrame([("a", 3, 7), ("a", None, None), ("z", 0, 1)], "doc_id string, start int, end int")
    assert sorted(str(r.text) for r in ch.resolve(hits, docs).collect()) == ["None", "None", "dois"]

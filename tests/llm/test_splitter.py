import math
import random
import re

import pytest

from quarry.llm import splitter as sp


def contract(text, pieces, limits):
    n = len(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == n
    for k, (a, b) in enumerate(pieces):
        assert 0 <= a < b <= n and b - a <= limits.limit
        if k:
            assert limits.overlap_min <= pieces[k - 1][1] - a <= limits.overlap_max
        if b < n and text[b - 1].isalnum() and text[b].isalnum():
            assert not any(c in " \t\r\n" for c in text[a + (b - a + 1) // 2 : b])


@pytest.mark.parametrize("limits", [sp.Limits(), sp.Limits(120, 8, 20, 10), sp.Limits(60, 0, 0, 5)])
def test_contract(limits):
    rng = random.Random(5)
    texts = ["x" * 5000, "ab " * 3000, "frase. " * 900, "a\r\nb\r\n" * 800, "é" * 3000, "linha\n\n" * 500, "👩‍👩" * 900, " " * 4000, "a" * 599 + " " + "b" * 5000]
    texts += ["".join(rng.choice("abcdé .\n") for _ in range(rng.randrange(1, 4000))) for _ in range(60)]
    for t in texts:
        contract(t, sp.split_text(t, limits), limits)


def test_short_and_empty():
    assert sp.split_text(None) == sp.split_text("") == [] and sp.split_text("a" * 1200) == [(0, 1200)]
    with pytest.raises(ValueError):
        sp.Limits(100, 40, 60)


def test_cuts_where_the_topic_changes():
    a = "O imposto sobre renda incide sobre salários e rendimentos tributáveis. " * 11
    b = "A licença ambiental exige estudo prévio sobre florestas nascentes. " * 14
    text = a + b
    end = sp.split_text(text)[0][1]
    assert abs(end - len(a)) < 80


def _cosine(a, b):
    words = set(a) | set(b)
    top = sum(a.count(w) * b.count(w) for w in words)
    return top / math.sqrt(sum(a.count(w) ** 2 for w in words) * sum(b.count(w) ** 2 for w in words)) if a and b else 0.0


def test_the_deepest_valley_of_each_window_is_taken():
    """Against the definition: similarity of the blocks at every natural boundary, depth to the peaks on both sides."""
    rng, limits = random.Random(3), sp.Limits(400, 20, 50, 12)
    words = ["imposto", "renda", "licença", "floresta", "contrato", "multa", "prazo", "edital", "norma", "juízo"]
    seen = 0
    for _ in range(12):
        text = " ".join(" ".join(rng.choice(words[k % 7 : k % 7 + 4]) for _ in range(rng.randrange(3, 9))) + rng.choice([".", ";", "!", ":\n"]) for k in range(60))
        found = [(m.start(), m.group().lower()) for m in re.finditer(r"[^\W_]{4,}", text)]
        ends = [i for i in range(1, len(text)) if (text[i - 1] in ".;!:" and text[i].isspace()) or text[i] == "\n"]
        similar = []
        for e in ends:
            before, after = [w for s, w in found if s < e], [w for s, w in found if s >= e]
            similar.append(_cosine(before[-12:], after[:12]))
        depth = {}
        for k, e in enumerate(ends):
            total = 0.0
            for side in (similar[max(0, k - 8) : k][::-1], similar[k + 1 : k + 9]):
                peak = similar[k]
                for x in side:
                    if x < peak:
                        break
                    peak = x
                total += peak - similar[k]
            depth[e] = total
        for a, b in sp.split_text(text, limits)[:-1]:
            window = [e for e in ends if a + 200 <= e <= a + 400]
            if window:
                seen += 1
                assert depth[b] == pytest.approx(max(depth[e] for e in window)), (a, b)
    assert seen > 30


def test_records_and_audit(spark, make_docs, rows):
    long = "Primeira frase do texto. " * 120
    docs = make_docs([("a", long), ("b", "curto"), ("c", ""), ("d", None), ("a", "velho", None)])
    pieces = sp.split_records(docs)
    assert {r.doc_id for r in pieces.collect()} == {"a", "b"}
    assert rows(sp.faulty_pieces(docs, sp.as_chunks(pieces))) == []
    assert rows(sp.split_records(docs.where("false"))) == []
    n = len(long)
    stored = [("a#0", "a", 0, 1100), ("a#0", "a", 0, 1100), ("a#1", "a", 1000, 2190), ("a#3", "a", 2100, n), ("b#0", "b", -1, 3), ("b#1", "b", 3, 2), ("b#2", "b", 0, 99), ("x#0", "x", 0, 1201), ("x#9", "x", 1101, 1300), ("y", "y", 0, 5), ("z#0", "z", None, 4), ("w#0", "a2", 0, 1103)]
    chunks = spark.createDataFrame([(*s, 1, None) for s in stored], "chunk_id string, doc_id string, start int, end int, slot bigint, text string")
    more = make_docs([("a", long), ("b", "curto"), ("a2", "Palavra " * 137 + "inteiras e mais outras palavras " * 9)])
    got = {r[0] for r in rows(sp.faulty_pieces(more, chunks))}
    want = {"b#0", "b#1", "b#2", "x#0", "z#0"}
    text = {"a": long, "a2": "Palavra " * 137 + "inteiras e mais outras palavras " * 9}
    for cid, d, s, e in stored:
        if d in text and 0 < e < len(text[d]) and text[d][e - 1].isalnum() and text[d][e].isalnum():
            want.add(cid)
    assert got == want
    assert rows(sp.faulty_pieces(more, chunks.where("false"))) == []

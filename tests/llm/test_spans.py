import random

import numpy as np
import pytest

from quarry.llm import spans
from quarry.llm.fmindex import FMIndex, WaveletMatrix

SPAN = 240


def points(s):
    return spans._points(s)


def windows(texts, span):
    found = {}
    for d, t in texts.items():
        for i in range(len(t or "") - span + 1):
            found.setdefault(t[i : i + span], set()).add(d)
    return found


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefé日🙂"])
def test_index_against_definition(letters):
    rng = random.Random(len(letters))
    for trial in range(60):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(6)]
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 8))]
        asked = texts if trial % 2 else ["".join(rng.choice(parts) for _ in range(3)) + rng.choice(["", "x", "zab"]) for _ in range(5)]
        limit = rng.choice([3, 7, 20])
        index = FMIndex([points(t) for t in texts], limit)
        got = {(int(p), int(s)): frozenset(index.text_of[index.sa[r : index.run_end[r]]].tolist()) for p, s, r in zip(*index.windows([points(a) for a in asked]))}
        held = windows(dict(enumerate(texts)), limit)
        assert got == {(p, s): frozenset(held[a[s : s + limit]]) for p, a in enumerate(asked) for s in range(len(a) - limit + 1) if a[s : s + limit] in held}


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 11, 500)
    w = WaveletMatrix(seq, 4)
    for c in range(11):
        i = np.arange(0, 501, 7)
        assert (w.rank(np.full(len(i), c), i) == [np.count_nonzero(seq[:k] == c) for k in i]).all()


def test_anchors_meet_in_every_shared_window():
    rng = random.Random(9)
    for letters in ("ab", "abcdefgh ", "a"):
        shared = "".join(rng.choice(letters) for _ in range(SPAN))
        x = "".join(rng.choice(letters) for _ in range(500)) + shared + "x"
        y = "y" * 17 + shared + "".join(rng.choice(letters) for _ in range(90))
        a, b = (spans.anchors([points(t)], SPAN) for t in (x, y))
        inside = {h for h, p in zip(a[1].tolist(), a[3].tolist()) if p + spans.GRAM > 500}
        assert inside & set(b[1].tolist())


def test_long_text_is_hashed_in_segments():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3 * spans._SEGMENT))
    part = text[spans._SEGMENT - 1000 : spans._SEGMENT + 1000]
    whole, own = spans.anchors([points(text)], SPAN), spans.anchors([points(part)], SPAN)
    assert set(own[1].tolist()) <= set(whole[1].tolist())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é.\n") for _ in range(n))
    quote, just, short = some(700), some(SPAN), some(SPAN - 1)
    out = {1: some(900), 2: None, 3: "", 4: "   "}
    for k in range(10, 18):
        out[k] = some(rng.randrange(0, 400)) + quote[rng.randrange(0, 300) :][: rng.randrange(200, 400)] + some(rng.randrange(0, 400))
    out |= {20: just + some(300), 21: some(300) + just, 22: just, 23: short + some(200), 24: some(200) + short}
    out |= {30: "ab" * 400, 31: "z" + "ab" * 300, 32: "a" * 239, 33: "a" * 240, 34: "a" * 900}
    copy = some(500)
    out |= {40: copy, 41: copy, 42: copy, 43: some(100) + copy[100:400], 50: some(60000) + quote[:300] + some(70000)}
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in texts.items()], "doc_id bigint, text string, region string, a int, rep int")


def test_pairs(documents, texts, rows):
    held = windows(texts, SPAN).values()
    want = sorted({(a, b) for s in held for a in s for b in s if a < b})
    assert (40, 41) in want and (20, 22) in want and (23, 24) not in want and (33, 34) in want
    got = rows(spans.shared_pairs(documents))
    assert got == sorted(want, key=repr)
    assert rows(spans.shared_pairs(documents, index_chars=300)) == got
    assert rows(spans.shared_pairs(documents, group=2)) == got
    assert rows(spans.shared_pairs(documents.where("false"))) == []


def test_pairs_of_a_group_over_several_blocks(spark, rows):
    """All texts have one stretch within different surroundings: one group, many blocks."""
    rng = random.Random(21)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    quote = some(SPAN)
    texts = {d: some(150) + quote + some(250) for d in range(9)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = [(a, b) for a in range(9) for b in range(a + 1, 9)]
    for chars in (1, 700, 10**6):
        assert rows(spans.shared_pairs(df, index_chars=chars)) == want


def test_pairs_with_hot_anchors(documents, rows, monkeypatch):
    want = rows(spans.shared_pairs(documents))
    found = rows(spans.shared_spans(documents))
    monkeypatch.setattr(spans, "HOT_REGIONS", 1)
    assert rows(spans.shared_pairs(documents.repartition(3))) == want
    # anchors that a sample, here of all texts, shows to be in many
    monkeypatch.setattr(spans, "LOOK", 1)
    monkeypatch.setattr(spans, "MANY", 2)
    assert rows(spans.shared_pairs(documents)) == want and rows(spans.shared_spans(documents)) == found


def test_pairs_in_pieces(monkeypatch):
    monkeypatch.setattr(spans, "PAIRS", 7)
    some = [(np.array([3, 1, 2]), np.array([1, 3, 2])), (np.arange(20), np.arange(20)[::-1])]
    got = {p for x, y in spans._batches(some) for p in zip(x.tolist(), y.tolist())}
    assert got == {(1, 3)} | {(i, 19 - i) for i in range(10)}


@pytest.mark.parametrize("group", [spans.GROUP, 2])
def test_spans_and_report(documents, texts, group):
    held = windows(texts, SPAN)
    cover = {}
    for d, t in texts.items():
        mark = [False] * len(t or "")
        for i in range(len(t or "") - SPAN + 1):
            if len(held[t[i : i + SPAN]]) > 1:
                mark[i : i + SPAN] = [True] * SPAN
        cover[d] = mark
    got = {d: [False] * len(t or "") for d, t in texts.items()}
    for r in spans.shared_spans(documents, group=group).collect():
        got[r.doc_id][r.start : r.end] = [True] * (r.end - r.start)
    assert got == cover
    report = {r.doc_id: r for r in spans.shared_report(documents).collect()}
    assert set(report) == set(texts)
    for d, mark in cover.items():
        assert (report[d].n_chars, report[d].shared_chars) == (len(mark), sum(mark))
        assert report[d].share == (None if not mark else sum(mark) / len(mark))

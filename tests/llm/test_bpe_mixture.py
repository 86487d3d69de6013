import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, mixture

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def plain():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.encoder().vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = ["", " ", "\r\n\t  x", "Ação civil pública — R$ 1.234,56", "a" * 3000, "=-" * 2000, "日本語 🙂👍🏽", "it's 'll don't", "<|endoftext|>", "  dois  espaços ", "́", "\x00\x1f"]


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(plain, text):
    e = bpe.encoder()
    ids = e.encode(text)
    assert ids == plain(text) and "".join(e.decode(ids)) == e.decode_whole(ids) == text and e.count(text) == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(plain, text):
    e = bpe.encoder()
    assert e.encode(text) == plain(text)
    assert "".join(e.decode(e.encode(text))) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_transducer_on_bytes(data):
    e = bpe.encoder()
    assert e.words.transducer.encode(data) == e.vocabulary.merge(data)


def test_small_bounds(monkeypatch, plain):
    monkeypatch.setattr(bpe, "_MAX_STATES", 50)
    monkeypatch.setattr(bpe, "_MAX_WORDS", 3)
    e = bpe.Encoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for text in TEXTS:
        assert e.encode(text) == plain(text)


def test_tables(spark, rows):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (4, "Olá\r\nmundo", 5), (4, "Olá\r\nmundo", 5)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df).collect()}
    assert got[1] == got[2] == [] and got[3] == [220] and bpe.token_ids(df).count() == 5
    assert rows(bpe.token_counts(df), "doc_id", "n_tokens") == sorted((k, len(got[k])) for k in (1, 2, 3, 4, 4))
    assert all(r.same for r in bpe.round_trip(df).collect())
    assert rows(bpe.decoded(bpe.token_ids(df))) == [(1, ""), (2, ""), (3, " "), (4, "Olá\r\nmundo"), (4, "Olá\r\nmundo")]
    assert bpe.token_ids(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["tiny"]), " ".join(["palavra"] * rng.randrange(0, 60)), 1) for i in range(3000)]
    rows += [(9000, None, "sem fonte " * 50, 1), (9001, "mid", None, 1), (9002, "mid", "", 1), (9003, "other", "x " * 100, 1)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string, block int")
    targets = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.4, 2), ("tiny", 0.2, 2), ("none", 0.1, 5), ("tiny", 0.2, 2), (None, 0.5, 1), ("nil", None, None)], "source string, weight double, max_repeats int")
    return documents, targets


def test_mixture(spark, sources):
    documents, targets = sources
    e = bpe.encoder()
    size = {r.doc_id: e.count(r.text) for r in documents.collect()}
    own, total = {}, sum(size.values())
    for r in documents.collect():
        own.setdefault(r.source, {})[r.doc_id] = size[r.doc_id]
    report = {r.source: r for r in mixture.mixture_report(documents, targets).collect()}
    rows = mixture.mixed(documents, targets).collect()
    assert set(report) == {"big", "mid", "tiny", "none", "nil"}
    largest = max(size.values())
    whole = sum(r.n_tokens for r in rows)
    for name, weight, most in (("big", 0.3, 2), ("mid", 0.4, 2), ("tiny", 0.2, 2), ("none", 0.1, 5), ("nil", 0.0, 1)):
        mine = [r for r in rows if r.source == name]
        cap = most * sum(own.get(name, {}).values())
        plan = int(min(weight * total, cap))
        drawn = sum(r.n_tokens for r in mine)
        assert plan - largest < drawn <= plan
        assert report[name].drawn_tokens == drawn and report[name].capped == (weight * total > cap) and report[name].drawn_records == len(mine)
        assert report[name].share == pytest.approx(drawn / whole)
        assert len({(r.doc_id, r.copy) for r in mine}) == len(mine) and all(r.copy < most for r in mine)
        assert all(r.n_tokens == size[r.doc_id] for r in mine)
    assert {r.source for r in mixture.unreachable(documents, targets).collect()} == {s for s, r in report.items() if r.capped} >= {"tiny", "none"}


def test_balanced_total(sources):
    """Every source that has documents holds its weight, to a record; a number may be stated as well."""
    documents, targets = sources
    e = bpe.encoder()
    largest = max(e.count(r.text) for r in documents.collect())
    report = {r.source: r for r in mixture.mixture_report(documents, targets, total="balanced").collect()}
    total = report["big"].total_tokens
    assert total == pytest.approx(min(r.max_repeats * r.own_tokens / r.weight for r in report.values() if r.own_tokens and r.weight))
    whole = sum(r.drawn_tokens for r in report.values())
    for name, weight in (("big", 0.3), ("mid", 0.4), ("tiny", 0.2)):
        assert abs(report[name].drawn_tokens - weight * total) <= largest and not report[name].capped
        assert abs(report[name].share - weight / 0.9) * whole <= 2 * largest and abs(report[name].of_total - weight) * total <= largest
    assert report["none"].drawn_tokens == 0
    stated = {r.source: r for r in mixture.mixture_report(documents, targets, total=5000).collect()}
    assert abs(stated["mid"].drawn_tokens - 2000) <= largest
    assert {(r.basis, r.source) for r in mixture.both_reports(documents, targets).collect()} == {(b, s) for b in ("all", "balanced") for s in report}


def test_quotas(sources):
    documents, targets = sources
    assert all(r.exact and r.repeats_kept for r in mixture.quotas(documents, targets).collect())


def test_shards_get_their_share(sources):
    documents, targets = sources
    p = mixture.plan(documents, targets, shards=7)
    per = [0] * 7
    for d in p.draws:
        per[d[3]] += 1
    assert max(per) - min(per) <= 3
    assert len({d[:3] for d in p.draws}) == len(p.draws)
    assert p.draws == mixture.plan(documents, targets, shards=7).draws


def test_nothing(sources):
    documents, targets = sources
    assert mixture.unreachable(documents, targets.where("false")).count() == 0
    assert mixture.mixed(documents.where("false"), targets).count() == 0
    assert {r.share for r in mixture.mixture_report(documents.where("false"), targets).collect()} == {None}

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.lexical import term_rows


def naive(text):
    return ["".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn") for t in re.findall(r"[^\W_]+", text)]


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def test_tokens(spark):
    cases = ["Ação é Ünico", "a_b-c 12º", "decomposto é", "", "   ", "日本 語", "Straße ĄŚĆ"]
    for c in cases:
        assert one(spark, c, tx.tokens) == naive(c), c
    assert one(spark, None, tx.tokens) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("aáÃçÇñ _-1٣\n", max_size=20), min_size=1, max_size=20))
def test_term_rows_agree_with_tokens(spark, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "i int, text string, dl int")
    got = {}
    for r in term_rows(df, ("i",)).collect():
        got.setdefault(r.i, []).append(r)
    for r in df.select("i", tx.tokens("text").alias("a")).collect():
        rows = got.get(r.i, [])
        assert sorted(r.a) == sorted(t for x in rows for t in [x.term] * x.tf) and {x.dl for x in rows} <= {len(r.a)}


def test_strip_and_canonicalize(spark):
    assert one(spark, " 　\x1c a b ", tx.strip) == "a b"
    assert one(spark, "a\r\nb\rc\n", tx.canonicalize) == "a\nb\nc\n"
    assert len(tx.WHITE_SPACE) == 29


def test_html_preview_cap(spark):
    assert one(spark, " <p>a<br/>b</p>\n c ", tx.strip_html) == "a b c"
    assert one(spark, "x" * 230, tx.preview) == "x" * 220 + "..."
    assert one(spark, "a\nb", tx.preview) == "a b"
    assert one(spark, "lei.txt", lambda c: tx.without_suffix(c, ".txt")) == "lei"
    assert one(spark, "abc", lambda c: tx.char_cap(c, 2)) == "ab"

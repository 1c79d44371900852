from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docspark.functions import profiles as P
from docspark.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("<b>إِنَّ</b>&nbsp;أَحْمَدَ،  ٱلْمَدْرَسَةِ ١٢", "ان احمد المدرسه ١٢"), ("هُدًى مؤمن شيئ", "هدي مومن شيي"), ("", ""), ("abc", "")],
)
def test_normalise(spark, text, want):
    assert one(spark, T.normalise("t"), t=text) == want
    assert one(spark, T.normalise(T.normalise("t")), t=text) == want


def test_browser_profile_drops_local_digits(spark):
    assert one(spark, T.normalise("t", P.ARABIC_BROWSER), t="باب ١٢ 3") == "باب 3"


@pytest.mark.parametrize("word, want", [("والكتاب", "كتاب"), ("الماء", "ماء"), ("ال", "ال"), ("للماء", "ماء"), ("وال", "ال"), ("كتاب", "تاب")])
def test_stem(spark, word, want):
    assert one(spark, T.stem("w"), w=word) == want


def test_tokens_keep_repeats_and_drop_question_words(spark):
    assert one(spark, T.tokens("t", query=True), t="ما حكم الماء والماء") == ["ماء", "ماء"]
    assert one(spark, T.tokens("t", P.UNICODE, query=True), t="The cat and the CAT a") == ["cat", "cat"]


def test_page_and_notes(spark):
    page = "body\n_____\n(١) one\nmore\n\n(2) two\n(١) again"
    parts = one(spark, T.split_page("t"), t=page)
    assert parts["body"] == "body"
    assert one(spark, T.split_notes(F.lit(parts["notes"])), t="") == {1: "again", 2: "two"}
    assert one(spark, T.split_notes("t"), t="carried over\n(3) x") == {0: "carried over", 3: "x"}


def test_small_functions(spark):
    assert one(spark, T.similarity("a", "b"), a="abcd", b="abce") == 0.75
    assert one(spark, T.similarity("a", "b"), a="", b="x") == 0.0
    assert one(spark, T.bracketed("t"), t="a (b) (12) (١) (c d)") == ["b", "c d"]
    assert one(spark, T.label_number("t"), t="[P١٢]") == 12 and one(spark, T.label_number("t"), t="none") is None
    assert one(spark, T.strip_labels("t"), t="so [P3] it is") == "so it is"
    assert one(spark, T.guard_brackets("t"), t="(a) ﴿ b (c) ﴾ (d)") == "(a) ﴿ b [c] ﴾ (d)"
    assert one(spark, T.speakable("t"), t='<span data-type="title">T</span>x (١) «y» [أ]') == "x y"
    assert [one(spark, T.number("t"), t=t) for t in ("True", "False", "1.5", "", "x")] == [1.0, 0.0, 1.5, None, None]
    assert one(spark, T.first_match("t", [("^a", "A"), ("b", "B")], "none"), t="ab") == "A"
    assert one(spark, T.host("t"), t="https://Api.Example.com:8/x") == "api.example.com"
    assert one(spark, T.search_link("u?q=", "t", 2), t="a b c") == "u?q=b+c"
    assert one(spark, T.mentions("q", F.lit("word")), q="these words") is True
    assert one(spark, T.content_words("t", P.UNICODE), t="the big red dog") == ["big", "red", "dog"]
    assert one(spark, T.content_words("t", P.UNICODE), t="big red old dog") == []
    assert one(spark, T.unescape("t"), t="&amp;lt; &lt;") == "&lt; <"
    assert one(spark, T.quote_context("t", "q", 3, 2), t="0123456789", q="56") == "234567"

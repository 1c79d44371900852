from __future__ import annotations

import re
from collections import Counter

from docspark.llm import line_quality as lq

WORDS = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    w = WORDS.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark, odd_docs, no_docs):
    texts = ["a b c a b c", "x x x x x", "one\none\n\n \none", "a|b # $%\r\x0bq", "p q r s p q r t p q", "w " * 300]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    for r in lq.measure(docs).collect():
        n, chars, symbols, dup, rep = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), r["text"]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
    assert lq.measure(no_docs).count() == 0
    assert lq.clean(odd_docs).columns == odd_docs.columns and {r["n_words"] for r in lq.clean(odd_docs).collect()} <= {0}


def test_line_rules(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(12))
    junk = "Home | About | Contact | Imprint\nwin%%% big&&& now$$$ here###\nAll rights reserved.\nno mark in this line at all"
    docs = spark.createDataFrame([(1, prose + "\n" + junk), (2, "\n".join([junk] * 20) + "\n" + prose), (3, prose), (4, "é" * 10)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lq.measure(docs).collect()}
    assert got[1]["kept"] and got[3]["kept"] and not got[2]["kept"] and not got[4]["kept"]
    assert got[3]["lost_chars"] == 0 and got[1]["lost_chars"] > 0
    assert {r["doc_id"]: r["text"] for r in lq.clean(docs).collect()} == {1: prose, 3: prose}


def test_words_and_edges(spark):
    texts = ["one\ttwo\tthree\tfour five", "    a  b   c", "the design in catalog in use is old.", "TOUS DROITS RÉSERVÉS.", "Please sign in.", "Impressum", "blogin. x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bad = {r["doc_id"] for r in lq.with_bad_lines(docs).where("size(__bad) > 0").collect()}
    assert bad == {0, 3, 4, 5}


def test_menus(spark):
    menu, prose = ["Home", "About us", "", "Contact", "Our last news"], "Here is a sentence of prose, and it ends."
    texts = ["\n".join(x) for x in (menu * 18, [prose, *menu[:2], prose], [prose, *menu, prose], ["", " ", *menu[:4]], ["", *menu[3:], "", "A. B.", *menu[:2]], menu[:3] + ["Stop here."])]
    got = {r["doc_id"]: r for r in lq.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lost = [got[i]["lost_chars"] for i in range(6)]
    chars = lambda lines: sum(len("".join(x.split())) for x in lines)
    assert lost == [chars(menu * 18), 0, chars(menu), 0, 0, 0]
    assert not got[0]["kept"]
    own = [" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(12)]
    long = spark.createDataFrame([(1, "\n".join([*own, "", "", *menu, prose]))], "doc_id long, text string")
    assert lq.clean(long).first()["text"] == "\n".join([*own, "", "", prose])


def test_stays_native(spark, tables, odd_docs):
    d = tables(documents=odd_docs)
    plan = lq.op4_line_quality(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import sequences as Q
from docspark.functions.profiles import ARABIC, UNICODE
from docspark.operators import passages as P
from docspark.operators import reading as B
from docspark.streaming import state as Z


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_recital_lines(spark):
    def lines(*segments):
        words = [("g", s, k, k == n - 1) for s, n in enumerate(segments) for k in range(n)]
        out = B.recital_lines(spark.createDataFrame(words, "g string, s int, k int, e boolean"), "g", ["s", "k"], "e")
        return [r["count"] for r in out.groupBy("line").count().orderBy("line").collect()]

    assert lines(6, 20, 2) == [6, 14, 8]  # 14 of the second segment, its six others, then two that join them
    assert lines(3, 4, 3) == [7, 3] and lines(2) == [2] and lines(5, 5, 14, 2) == [10, 16]
    empty = spark.createDataFrame([], "g string, s int, k int, e boolean")
    assert B.recital_lines(empty, "g", ["s", "k"], "e").count() == 0
    forms = spark.createDataFrame([("بسم الله", "بِسْمِ اللهِ"), ("بسم الله", "قَالَ"), ("a b", None), (None, None)], "p string, v string")
    got = [r[0] for r in forms.select(B.spoken_words(F.col("p"), F.col("v"), ARABIC)).collect()]
    assert got == [["بِسْمِ", "اللهِ"], ["بسم", "الله"], ["a", "b"], []]


def test_pages_cut_at_paragraphs_and_sentences(spark):
    texts = {"short": [["w"] * 4, ["w"] * 5, ["w"] * 3], "long": [["w"] * 3, ["w"] * 7 + ["end."] + ["w"] * 14], "none": [[]], "null": [None], "exact": [["w"] * 10, ["w"] * 10]}
    data = [(t, i, p) for t, ps in texts.items() for i, p in enumerate(ps)]
    got = rows(B.pages(spark.createDataFrame(data, "t string, i int, words array<string>"), "t", ["i"], "words", limit=10, back=4))
    of = lambda t: [r[2:] for r in got if r[0] == t]
    assert of("short") == [(0, 9), (9, 12)] and of("exact") == [(0, 10), (10, 20)]
    assert of("long") == [(0, 3), (3, 11), (11, 21), (21, 25)]
    assert of("none") == of("null") == [(0, 0)]
    words = spark.range(12).withColumnRenamed("id", "place")
    assert rows(B.on_page(words, F.lit(9), F.lit(12))) == [(10,), (11,), (9,)]


def test_timings_and_listening_order(spark):
    w = spark.createDataFrame([("c", k, x) for k, x in enumerate(["ab", "c", "def"])], "c string, k int, word string")
    assert [r["at"] for r in B.timings(w, ["c"], ["k"], "word", F.lit(90)).orderBy("k").collect()] == [0, 30, 50]
    assert [r["at"] for r in B.timings(w, ["c"], ["k"], "word", F.lit(90), lead=9).orderBy("k").collect()] == [45, 60, 70]
    p = spark.createDataFrame([("c", 1, ["x", "y"]), ("c", 2, ["x", "y"]), ("c", 3, ["y"]), ("c", 4, None), ("d", 1, ["x"])], "c string, i int, a array<string>")
    assert rows(B.listening_order(p, "c", ["i"], "i", "a")) == [("c", 1, "x"), ("c", 2, "y"), ("c", 3, None), ("c", 4, None), ("d", 1, "x")]


def test_links_in_order_and_back(spark):
    s = [("c", 1, [], False, None), ("c", 2, [5, 9], False, None), ("c", 3, [2, 7], False, None), ("c", 4, [1], False, None), ("c", 5, None, None, None), ("c", 6, [], True, 3), ("c", 7, [], True, None), ("c", 8, [], False, None)]
    got = B.links_in_order(spark.createDataFrame(s, "c string, i int, hits array<int>, t boolean, o int"), "c", ["i"], "i", "hits", "t", "o")
    assert [r[2:] for r in rows(got)] == [(None, "none"), (5, "hit"), (7, "hit"), (1, "hit"), (1, "order"), (3, "title"), (None, "title"), (3, "order")]
    links = spark.createDataFrame([("p", 1, "b"), ("p", 2, "a"), ("p", 3, "b"), ("q", 1, None)], "p string, i int, a string")
    assert [(r["p"], r["targets"], r["first"]) for r in B.inverse_links(links, "p", ["i"], "a").collect()] == [("p", ["b", "a"], "b")]


def test_notes_behind_a_mark(spark):
    notes = [("p", "the purity", "ours", "variant", 1), ("p", "purities", "else", "variant", 2), ("p", "other", "ours", "takhrij", 3), ("q", None, "else", "takhrij", 1), ("q", "x", "else", "variant", 2)]
    n = spark.createDataFrame(notes, "para string, lemma string, source string, kind string, i int")
    m = spark.createDataFrame([(1, "p", "Purity,"), (2, "p", "puritie"), (3, "q", "nothing"), (4, "p", None)], "mark_id int, para string, word string")
    got = rows(B.notes_behind(m, n, ["para"], ["i"], F.col("source") == "ours", profile=UNICODE).select("mark_id", "i", "tier", "rank"))
    assert got == [(1, 1, 1, 1), (2, 2, 2, 1), (3, 1, 3, 1), (4, 3, 3, 1)]  # 'puritie' is like 'purities' (7 of 8 letters), not like 'purity'


def test_entries_of_a_word_without_letters(spark):
    p = spark.createDataFrame([(1, "p", "c", "-- is a long line", ["dash"]), (2, "p", "c", "-- is a long line", None)], "id int, para string, chapter string, text string, context array<string>")
    got = P.entries(p, [("(-+) is ([a-z ]{3,40})", "", "def")], profile=UNICODE)
    assert rows(got.select("id", "key", "word", "definition")) == [(1, "dash", "dash", "a long line")]


def test_find_quote_against_all_windows(spark):
    rng = random.Random(5)
    like = lambda a, b: Q.alike(a, b) >= 0.75
    views = [("b", k, [rng.choice(["abcd", "abce", "xy", "zzzz", "abcdefgh"]) for _ in range(rng.randint(0, 9))]) for k in range(12)] + [("c", 0, ["abcd"] * 4), ("c", 1, None)]
    quotes = [(str(k), rng.choice("bc"), [rng.choice(["abcd", "xy", "qqqq", "abcdefgx"]) for _ in range(rng.randint(2, 4))]) for k in range(40)]
    want = []
    for name, on, quote in quotes:
        places = [(sum(like(t[s + j], q) for j, q in enumerate(quote)) / len(quote), -k, -s) for on_, k, t in views if on_ == on and t for s in range(len(t) - len(quote) + 1) if like(t[s], quote[0]) or like(t[s + 1], quote[1])]
        if len(quote) >= 3 and places and max(places)[0] >= 0.6:
            score, k, s = max(places)
            want.append((name, -k, score, -s, len(quote) - s - 1))
    v = spark.createDataFrame(views, "src string, ch int, tokens array<string>")
    got = B.find_quote(spark.createDataFrame(quotes, "quote_id string, src string, words array<string>"), v, ["src"], ["ch"])
    assert rows(got.select("quote_id", "ch", "score", "begins", "ends")) == sorted(want)


def test_notes_behind_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["purity", "purities", "purify", "water", "waters", "watery", "x", "", None]
    notes = [(rng.choice("pq"), rng.choice(words), rng.choice(["ours", "else"]), rng.choice(["takhrij", "variant"]), i) for i in range(60)]
    marks = [(i, rng.choice("pqr"), rng.choice(words)) for i in range(30)]
    n = spark.createDataFrame(notes, "para string, lemma string, source string, kind string, i int")
    m = spark.createDataFrame(marks, "mark_id int, para string, word string")
    want = []
    for mark, para, word in marks:
        tiers = {}
        for para_, lemma, source, kind, i in notes:
            like = bool(word and lemma) and Q.alike(lemma, word) >= 0.75
            tier = (1 if source == "ours" else 2) if like else 3 if kind == "takhrij" else None
            if para_ == para and tier:
                tiers.setdefault(tier, []).append(i)
        if tiers:
            want += [(mark, i, min(tiers), r + 1) for r, i in enumerate(sorted(tiers[min(tiers)])[:3])]
    got = B.notes_behind(m, n, ["para"], ["i"], F.col("source") == "ours", profile=UNICODE).select("mark_id", "i", "tier", "rank")
    assert sorted(rows(got)) == sorted(want)


def test_small_sums(spark):
    s = spark.createDataFrame([(1, 2, 1, "x"), (1, 2, 0, "w"), (1, 3, 2, "y")], "a int, n int, i int, q string")
    assert rows(B.quotes_by_number(s, ["a"], "n", ["i"], "q")) == [(1, 2, ["w", "x"]), (1, 3, ["y"])]
    cards = spark.createDataFrame([(1, "f", "b"), (1, " ", "b"), (1, "f", None), (2, "", "")], "d int, f string, b string")
    assert rows(B.complete_cards(cards, ["d"], "f", "b")) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_forms_agree_with_batch_forms(spark, tmp_path, files):
    e = spark.range(60).selectExpr("id", "cast(id % 2 as string) as u", "timestamp_seconds(1000000 + id * 7000) as ts", "cast(element_at(array(0, 3, 4, 5), cast(id * 7 % 4 + 1 as int)) as int) as q")
    for k in range(files):  # one file a micro-batch, in order of time
        e.where(f"cast(id * {files} / 60 as int) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limited = run(Z.rate_limit_stream(stream(), "u", "ts", "id", 2, 30000), f"limited{files}", "append")
    assert rows(limited.select("id", "accepted")) == rows(Z.rate_limit(e, "u", "ts", "id", 2, 30000).select("id", "accepted"))

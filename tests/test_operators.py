from __future__ import annotations

from collections import deque

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import evaluation as E
from docspark.operators import linking as L
from docspark.operators import retrieval as R
from docspark.operators import segmentation as S
from docspark.operators import verification as V
from docspark.streaming import state as Z


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_guaranteed_places(spark):
    def put(top, sure):
        df = spark.createDataFrame([(top, sure)], "top array<long>, sure array<long>")
        return df.select(R.guarantee(F.col("top"), F.col("sure")).alias("t")).first()["t"]

    assert put([1, 2, 3, 4], [9, 1]) == [1, 2, 3, 9]
    assert put([1, 2, 3], [8, 9]) == [1, 9, 8]
    assert put([1, 2], [1, 2, 7]) == [1, 2]
    assert put([], [5]) == []


def test_ranked_empty_inputs(spark):
    docs = spark.createDataFrame([(1, "red apples"), (2, "green pears"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apples apples"), (2, None)], "item_id long, text string")
    best = R.ranked(R.bm25(docs, asked), "item_id", "doc_id", 5)
    assert [(r["item_id"], r["doc_id"]) for r in best.collect()] == [(1, 1)]
    assert R.bm25(docs.limit(0), asked).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    top = R.dense_topk(v, v.withColumnRenamed("vec_id", "query_id"), 2)
    assert rows(top.select("query_id", "vec_id")) == [(1, 1)]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, t long, v string")
    assert rows(L.asof_backward(left, right, ["k"], "t", ["v"]).select("id", "last_v")) == [(1, "y"), (2, None), (3, None)]
    band = L.band_join(left, right.selectExpr("k", "t as u", "v"), ["k"], "t", "u", 1)
    assert rows(band.select("id", "v")) == [(1, "y"), (2, "x")]
    far = L.band_join(left, right.selectExpr("k", "t + 1 as u", "v"), ["k"], "t", "u", 1, "left")
    assert rows(far.select("id", "u")) == [(1, 6), (2, None), (3, None)]
    hits = spark.createDataFrame([(1, 4, 6), (1, 7, 6), (1, 8, 6), (2, 3, None), (2, 1, None)], "id long, i long, near long")
    assert rows(L.nearest(hits, ["id"], "i", "near")) == [(1, 7), (2, 1)]
    said = spark.createDataFrame([(1, False), (2, None)], "id long, ok boolean")
    assert rows(L.keep_if_missing(left.select("id"), said, ["id"], "ok").select("id", "kept")) == [(1, False), (2, False), (3, True)]
    assert rows(L.keep_if_missing(left.select("id"), said, ["id"], "ok", True).select("id", "kept")) == [(1, False), (2, True), (3, True)]
    first, second = (spark.createDataFrame([x], "id long, unit long") for x in ((1, 10), (2, 20)))
    found = L.cascade(left.select("id"), [("exact", first), ("fuzzy", second)], ["id"])
    assert rows(found.select("id", "unit", "method")) == [(1, 10, "exact"), (2, 20, "fuzzy"), (3, None, None)]


def test_lemmas_notes_and_trees(spark):
    units = spark.createDataFrame([("c", 0, "aa bb cc"), ("c", 1, "dd ee"), ("c", 2, "ff gg hh ii"), ("d", 0, "aa bb")], "chapter string, idx int, norm string")
    lemmas = spark.createDataFrame([(1, "c", "bb cc"), (2, "c", "cc dd ee ff"), (3, "c", "aa xx cc dd ee"), (4, "c", "zz yy"), (5, "c", "aa"), (6, "d", "ff gg")], "lemma_id int, chapter string, lemma string")
    assert rows(L.lemma_links(lemmas, units)) == [(1, 0, "exact", 1.0), (2, 2, "exact_span", 1.0), (3, 0, "fuzzy", 0.8), (4, None, "none", 0.0), (5, None, "too_short", 0.0), (6, None, "none", 0.0)]
    assert ("2", 0) == [(str(r["lemma_id"]), r["idx"]) for r in L.lemma_links(lemmas, units, use_end=False).collect() if r["method"] == "exact_span"][0]
    notes = spark.createDataFrame([(1, 1, 1, "first"), (1, 1, 2, "begun ="), (1, 2, 0, "= more"), (1, 2, 1, "x"), (1, 3, 0, "of x"), (1, 4, 0, "lost"), (1, 5, 0, "lost too")], "b int, pg int, n int, note string")
    pages = spark.range(1, 6).selectExpr("1 as b", "cast(id as int) as pg")
    assert rows(L.continue_notes(notes, pages, ["b"]).select("pg", "n", "note")) == [(1, 1, "first"), (1, 2, "begun more"), (2, 1, "x of x")]
    apart = spark.createDataFrame([(4, 0, "begins far"), (4, 2, "begun ="), (6, 0, "= far continuation"), (6, 1, "own"), (7, 0, "a"), (7, 0, "b"), (8, 0, "")], "pg int, n int, note string").selectExpr("1 as b", "*")
    listed = spark.range(4, 9).selectExpr("1 as b", "cast(id as int) as pg")
    assert rows(L.continue_notes(apart, listed, ["b"]).select("pg", "n", "note")) == [(4, 0, "begins far"), (4, 2, "begun ="), (6, 1, "own b")]
    marks = spark.createDataFrame([(1, 2, "m"), (9, 9, "q")], "pg int, n int, word string")
    assert rows(L.marker_notes(marks, notes.where("n > 0")).select("word", "note")) == [("m", "begun ="), ("q", "")]
    paras = spark.createDataFrame([("p",), ("q",)], "para string")
    tree = L.attach(paras, spark.createDataFrame([("p", 2, "y"), ("p", 1, "x"), ("z", 1, "w")], "para string, seq int, t string"), "para", ["seq"], "units")
    assert [(r["para"], [x["t"] for x in r["units"]]) for r in tree.orderBy("para").collect()] == [("p", ["x", "y"]), ("q", [])]


def test_segmentation(spark):
    pages = spark.createDataFrame([(1, 1, 'x\n<span data-type="title">One</span>(core) text (١) more\nq')], "book_id int, pg int, text string")
    assert [(r["kind"], r["text"]) for r in S.events(pages).orderBy("seq").collect()] == [("line", "x"), ("title", "One"), ("line", "(core) text (١) more"), ("line", "q")]
    df = spark.createDataFrame([(["aa", "bb", "c" * 9, "d"],)], "p array<string>")
    assert df.select(S.pack(F.col("p"), 4).alias("x")).first()["x"] == ["aa bb", "c" * 9, "d"]
    rng = random.Random(4)
    many = [[rng.choice(["", "a", "bb", "ccc", "d" * 9]) for _ in range(rng.randrange(12))] for _ in range(200)]
    packed = spark.createDataFrame([(i, p) for i, p in enumerate(many)], "i int, p array<string>").select("i", "p", S.pack(F.col("p"), 4).alias("x"), S.pack_below(F.transform("p", lambda x: F.length(x)), 6).alias("y")).collect()
    for r in packed:
        out, buffer, section, held, sections = [], "", 0, 0, []
        for p in r["p"]:
            buffer = p if buffer == "" else f"{buffer} {p}"
            if len(buffer) > 4:
                out, buffer = [*out, buffer], ""
            section, held = (section + 1, len(p)) if held + len(p) > 6 and held else (section, held + len(p))
            sections.append(section)
        assert r["x"] == out + [buffer] * (buffer != "") and r["y"] == sections, r["p"]
    sizes = spark.createDataFrame([([3, 4, 9, 1, 2],)], "s array<long>")
    assert sizes.select(S.pack_below(F.col("s"), 8).alias("x")).first()["x"] == [0, 0, 1, 2, 2]
    budget = spark.createDataFrame([([(False, 5), (True, 9), (False, 4), (False, 1)],)], "r array<struct<anchor:boolean,size:long>>")
    assert [tuple(x) for x in budget.select(S.fit_budget(F.col("r"), 15).alias("x")).first()["x"]] == [(False, 5), (True, 9), (False, 1)]


@pytest.mark.parametrize(
    "said, kept, dropped, attributed, want",
    [("supported", 2, 0, False, "supported"), ("supported", 1, 1, False, "partial"), ("supported", 0, 2, False, "not_found"), ("differing", 1, 1, True, "differing"), ("differing", 1, 0, False, "supported"), ("nonsense", 1, 0, False, "supported"), ("not_found", 1, 1, False, "partial"), ("partial", 1, 0, False, "partial")],
)
def test_status(spark, said, kept, dropped, attributed, want):
    df = spark.createDataFrame([(said, kept, dropped, attributed)], "s string, k int, d int, a boolean")
    assert df.select(V.status(F.col("s"), F.col("k"), F.col("d"), F.col("a")).alias("x")).first()["x"] == want


def test_claims_to_answer(spark):
    passages = spark.createDataFrame([(1, 1, "Water is pure."), (1, 2, "Other text")], "question_id long, n int, text string")
    claims = spark.createDataFrame([(1, 0, "t", "P1", "water IS pure"), (1, 1, "t", "P9", "water"), (1, 2, "t", "P2", "water"), (1, 3, "t", "P2", "")], "question_id long, k int, text string, label string, quote string")
    checked = V.check_quotes(claims, passages)
    assert [(r["k"], r["quote_ok"]) for r in checked.orderBy("k").collect()] == [(0, True), (1, False), (2, False), (3, False)]
    verdicts = spark.createDataFrame([(1, 0, None)], "question_id long, k int, supported boolean")
    said = spark.createDataFrame([(1, "supported", False, None), (2, "supported", True, None)], "question_id long, status string, personal boolean, premise_correct boolean")
    assert rows(V.answers(V.judge(checked, verdicts.limit(0)), said, "some say")) == [(1, "partial", None, 1, 3), (2, "not_found", "personal_nothing", 0, 0)]
    assert rows(V.answers(V.judge(checked, verdicts), said.limit(1), "some say")) == [(1, "not_found", "not_in_library", 0, 4)]


def test_model_failures_become_errors(spark):
    class Broken:
        def ask(self, prompt):
            raise RuntimeError("down") if "x" in prompt else ValueError("odd")

    out = V.ask_model(spark.createDataFrame([("ax",), ("b",)], "p string"), "p", Broken()).collect()
    assert sorted(r["error"] for r in out) == ["RuntimeError: down", "ValueError: odd"]
    assert V.StubModel().ask("pure water\nwater here") == "supported"


def test_evaluation(spark):
    items = spark.createDataFrame(
        [("out_of_library", True, "not_in_library", "not_in_library", "not_found", "not_found", [], [], 0, False, None), ("answerable", True, "answerable", "answerable", "supported", "partial", [(1, 6)], [(1, 5)], 1, False, None), ("false_premise", True, "answerable", "answerable", "supported", "supported", [(1, 9)], [(1, 5)], 1, True, False)],
        "category string, critical boolean, scope string, expected_scope string, status string, expected_status string, cites array<struct<book_id:int,page:int>>, gold array<struct<book_id:int,page:int>>, n_shown int, premise_false boolean, premise_correct boolean",
    )
    got = {r["category"]: r for r in E.score_items(items).collect()}
    assert got["out_of_library"]["correct_refusal"] is True and got["out_of_library"]["citation_hit"] is None and got["out_of_library"]["critical_pass"] is True
    assert got["answerable"]["citation_hit"] is True and got["answerable"]["status_ok"] is False and got["answerable"]["false_refusal"] is False
    assert got["false_premise"]["citation_hit"] is False and got["false_premise"]["premise_caught"] is True and got["false_premise"]["critical_pass"] is True
    sus = spark.createDataFrame([(["5", "1"] * 5,), (["3"] * 10,), (["x"] * 10,), (["3"] * 9,)], "a array<string>")
    assert [r[0] for r in sus.select(E.usability(F.col("a"))).collect()] == [100.0, 50.0, None, None]
    p95 = E.run_metrics(spark.range(1, 101).select(F.lit("s").alias("s"), F.col("id").cast("double").alias("v")), ["s"], ["v"], latency="v").first()
    assert (p95["latency_median"], p95["latency_p95"]) == (50.5, 95.0)


def test_matrix_refuses_too_many_systems(spark):
    few = spark.range(3).selectExpr("concat('s', id) as system")
    assert E.matrix(few, 2, spark.range(2).withColumnRenamed("id", "item")).count() == 12
    with pytest.raises(ValueError):
        E.matrix(few, 1, spark.range(1), most=2)


def test_state(spark):
    assert list(Z.admit([0, 1, 2, 60, 61, 62], deque(), 2, 60)) == [True, True, False, False, True, True]
    card = (0, 0, 2.5, 0)
    for q in [4, 4, 5, 3, 0, 4]:
        card = Z.next_review(card, q)
    reps, interval, ease, lapses = 0, 0, 2.5, 0
    for q in [4, 4, 5, 3, 0, 4]:
        if q < 3:
            reps, interval, lapses = 0, 0, lapses + 1
            continue
        reps += 1
        interval = 1 if reps == 1 else 3 if reps == 2 else int(interval * ease * {3: 0.8, 4: 1, 5: 1.3}[q] + 0.5)
        ease = max(1.3, ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    assert (card[0], card[1], round(card[2], 9), card[3]) == (reps, interval, round(ease, 9), lapses)


def test_cards_transcripts_and_recitation(spark):
    grades = [4, 4, 5, 3, 0, 4]
    graded = spark.createDataFrame([(u, k, q, 1000 + k) for u in ("a", "b") for k, q in enumerate(grades[: 6 if u == "a" else 5])], "u string, k int, q int, s long").selectExpr("*", "timestamp_seconds(s) as ts")
    card = (0, 0, 2.5, 0)
    for q in grades:
        card = Z.next_review(card, q)
    cards = {r["u"]: r for r in Z.review_cards(graded, ["u"], ["k"], "q", "ts").collect()}
    assert tuple(cards["a"][c] for c in ("reps", "interval", "ease", "lapses")) == pytest.approx(card)
    assert (cards["b"]["reps"], cards["b"]["lapses"], cards["b"]["due"].timestamp()) == (0, 1, 1004 + 600)
    due = Z.due_cards(Z.review_cards(graded, ["u"], ["k"], "q", "ts"), F.timestamp_seconds(F.lit(2000)))
    assert [r["u"] for r in due.collect()] == ["b"]
    turns = spark.createDataFrame([(1, 2, "b"), (1, 1, "é"), (2, 1, ""), (None, 1, "n")], "c int, t int, line string")
    import hashlib

    assert rows(Z.transcripts(turns, "c", ["t"], "line")) == sorted([(1, hashlib.md5("é\nb".encode()).hexdigest(), 3), (2, hashlib.md5(b"").hexdigest(), 0), (None, hashlib.md5(b"n").hexdigest(), 1)], key=repr)
    line = "one two three four five six".split()
    said = spark.createDataFrame([("s", 1, line, ["one", "two"]), ("s", 2, line, ["zz", "yy", "xx", "ww"]), ("s", 3, line, ["three", "four", "five"])], "k string, t int, line array<string>, heard array<string>")
    assert rows(Z.recitation(said, "k", "t", "line", "heard")) == [("s", 1, True, 2), ("s", 2, False, 2), ("s", 3, True, 5)]


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    events = spark.createDataFrame([(k, u, 10.0 * k) for k in range(20) for u in (1, 2)], "n long, user_id long, s double").selectExpr("n * 10 + user_id as event_id", "user_id", "timestamp_seconds(s) as ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = rows(Z.rate_limit(events, "user_id", "ts", "event_id", 3, 60))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = Z.rate_limit_stream(stream, "user_id", "ts", "event_id", 3, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("limited")) == want

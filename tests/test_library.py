from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import ARABIC
from docspark.operators import evaluation as E
from docspark.operators import passages as P
from docspark.operators import projections as J
from docspark.operators import verification as V
from docspark.sources import io
from docspark.streaming import state as Z


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_books_pages_and_ranges(spark, tmp_path):
    write(tmp_path / "books/17.json", json.dumps({"pages": [{"text": f"p{k}", "vol": "1", "page": str(k)} for k in range(1, 5)] + [{"text": "x", "vol": "1", "page": "front"}]}))
    pages = io.read_books(spark, str(tmp_path / "books"))
    assert rows(pages.select("book_id", "pg", "page", "text"))[:2] == [(17, 1, 1, "p1"), (17, 2, 2, "p2")] and pages.where("pg = 5").first()["page"] is None
    io.write_pages(pages.unionByName(pages.withColumn("book_id", F.lit(18))), str(tmp_path / "pages"))
    some = io.pages_between(spark, str(tmp_path / "pages"), 17, 2, 3)
    assert rows(some.select("book_id", "pg")) == [(17, 2), (17, 3)] and io.page(spark, str(tmp_path / "pages"), 18, 4).first()["text"] == "p4"
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(book_id" in plan and "GreaterThanOrEqual(pg,2)" in plan
    write(tmp_path / "meta/17.json", json.dumps({"indexes": {"headings": [{"title": "One", "level": 1, "page": 2}, {"title": "Deep", "level": 3, "page": 2}, {"title": "Two", "level": 2, "page": 9}], "page_map": ["1,1"]}}))
    assert io.contents_text(io.read_headings(spark, str(tmp_path / "meta"))).first()["toc"] == "One (2)\nTwo (9)"
    write(tmp_path / "raw/003.json", json.dumps({"text": "t", "meta": json.dumps({"vol": "2", "page": 7})}))
    got = io.read_page_files(spark, str(tmp_path / "raw")).first()
    assert (got["pg"], got["meta"]["vol"], got["meta"]["page"]) == (3, "2", 7)


def test_items_runs_csv_and_transcripts(spark, tmp_path):
    items = write(tmp_path / "items.jsonl", json.dumps({"id": "a", "gold": [[1, 5], [2, 6]], "category": "answerable"}) + "\n\n")
    got = io.read_items(spark, items)
    assert [tuple(g) for g in got.first()["gold"]] == [(1, 5), (2, 6)] and rows(J.scored_items(got, ["answerable"]).select("id")) == [("a",)] and J.scored_items(got, ["other"]).count() == 0
    sheet = write(tmp_path / "x.csv", "﻿id,n\na,1\n")
    assert rows(io.read_csv(spark, sheet, "id string, n int")) == [("a", 1)]
    scored = spark.createDataFrame([("full", 1, "q", 0.5), ("full", 2, "q", 1.0)], "system string, run int, id string, hit double")
    io.write_runs(scored, str(tmp_path / "runs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "runs")).count() == 2
    write(tmp_path / "res/scored_full_run2.csv", "id,hit\nq,1\n")
    run = io.read_runs(spark, str(tmp_path / "res/*.csv"), "id string, hit double").first()
    assert (run["system"], run["run"], run["hit"]) == ("full", 2, 1.0)
    talk = [{"type": "user", "timestamp": "1", "message": {"role": "user", "content": "hi"}}, {"type": "summary"}, {"type": "assistant", "timestamp": "2", "message": {"role": "assistant", "content": json.dumps([{"type": "text", "text": "yo"}, {"type": "tool_use", "name": "grep"}])}}]
    t = io.read_transcript(spark, write(tmp_path / "t.jsonl", "\n".join(map(json.dumps, talk))))
    assert sorted((r["role"], r["text"], r["tools"]) for r in t.collect()) == [("assistant", "yo", ["grep"]), ("user", "hi", [])]
    assert [tuple(r) for r in spark.createDataFrame([("a <system-note>x\ny</system-note> b",)], "t string").select(T.clean_user("t"), T.tool_line(F.lit(None).cast("string"), F.lit(" ")), T.question(F.lit("  q  ")), T.display_words(F.lit("a - b."))).collect()] == [("a  b", "- tool", "q", ["a", "b."])]


def test_sinks(spark, tmp_path):
    some = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "log")
    assert io.append_new(some, path, ["k"]) == 2 and io.append_new(some, path, ["k"]) == 0 and spark.read.parquet(path).count() == 2
    io.write_dataset({"a": some}, str(tmp_path / "set"))
    assert io.read_dataset(spark, str(tmp_path / "set"), ["a"])["a"].count() == 3
    io.append_log(some, str(tmp_path / "jsonl"))
    io.write_json(some, str(tmp_path / "one"))
    assert spark.read.json(str(tmp_path / "jsonl")).columns == ["k", "t", "v"] and spark.read.json(str(tmp_path / "one")).count() == 3
    io.write_label_sheet(some, str(tmp_path / "sheet"))
    assert next((tmp_path / "sheet").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfk,v")
    assert rows(io.read_or_empty(spark, str(tmp_path / "none"), "k int")) == []
    table = spark.createDataFrame([("full", 0.5, 0.25, 0.75), ("x", None, None, None), ("y", 1.0, 1.0, 1.0)], "name string, mean double, low double, high double")
    assert rows(table.select("name", io.mean_and_range("mean", "low", "high"), io.percent("mean"))) == [("full", "0.50 (0.25–0.75)", "50%"), ("x", "–", "–"), ("y", "1.00", "100%")]
    assert rows(io.markdown_rows(table, "name", ["mean"]).select("line"))[0] == ("| full | 0.50 |",)
    frames = io.to_sse(spark.createDataFrame([("stage", ("x",))], "event string, data struct<s:string>"))
    back = io.parse_sse(frames.select(F.col("frame").alias("body"))).first()
    assert (back["event"], back["data"]) == ("stage", '{"s":"x"}')
    assert io.env_map("short:low,long:high,odd") == {"short": "low", "long": "high"} and io.whitelist(some, ["v"], 1).columns == ["v"]
    bodies = spark.createDataFrame([('{"question": "  why ", "depth": "long"}',), ('{"depth": "odd"}',), ("no json",)], "body string")
    assert rows(io.requests(bodies).select("question", "depth")) == [("", "normal"), ("", "normal"), ("why", "long")]
    assert rows(io.read_key(some.distinct(), spark.createDataFrame([(1,), (9,)], "k int"), "k", "v", "-")) == [(1, "a"), (9, "-")]
    assert rows(io.assembled({"p": some.select("k"), "q": some.select("v")}).groupBy("source").count()) == [("p", 3), ("q", 3)]
    answers = spark.createDataFrame([(1, False, False, 2, False), (2, True, False, 2, False), (3, None, None, 0, True), (4, False, True, 1, False), (5, None, None, None, None)], "id int, cached boolean, search_only boolean, n_sentences int, refused boolean")
    assert rows(io.good_answers(answers).select("id")) == [(1,), (3,)]
    notes = spark.createDataFrame([("c", 2, "w2", None), ("c", 1, "w1", "n")], "chapter string, seq int, word string, note string")
    assert io.notebook_markdown(notes).first()["markdown"] == "## c\n- **w1**: n\n- **w2**: "


def test_passages_and_embeddings(spark):
    assert P._closed([5, 0, 6, 20, 1], 10) == [0, 0, 0, 1, 2]
    pieces = spark.createDataFrame([("p", 1, "aaaa"), ("p", 2, "bbbbbbb"), ("p", 3, "c"), ("q", 1, "")], "para string, seq int, text string")
    assert rows(P.chunks(pieces, ["para"], "seq", 10)) == [("p", 0, 1, "aaaa bbbbbbb"), ("p", 1, 3, "c"), ("q", 0, 1, "")]
    seen = []

    class Counting(P.HashEmbedder):
        def embed(self, texts):
            assert len(texts) <= 2 and all(len(t) <= 5 for t in texts)
            return super().embed(texts)

    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, "three")], "id int, text string")
    out, new = P.embed(docs, "text", Counting(8), batch=2, most=5)
    assert new.count() == 3 and out.count() == 4
    vectors = {r["id"]: r["embedding"] for r in out.collect()}
    assert vectors[1] == vectors[2] and sum(x * x for x in vectors[1]) == pytest.approx(1, abs=1e-4) and set(vectors[3]) == {0.0}
    again, none = P.embed(docs, "text", Counting(8), new, 2, 5)
    assert none.count() == 0 and {r["id"]: r["embedding"] for r in again.collect()} == vectors and seen == []
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, id long, rank int")
    assert rows(P.search("dense", ranked, None, "q", "id", 1)) == [(1, 10, 1)]
    with pytest.raises(ValueError):
        P.search("odd", ranked, None, "q", "id")
    weights = spark.createDataFrame([(10, 0.3)], "id long, weight double")
    dense = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.85)], "q long, id long, score double")
    assert [r["id"] for r in P.damped(dense, weights, "q", "id").orderBy("rank").collect()] == [11, 10]
    asked = spark.createDataFrame([(1, "water")], "query_id int, word string")
    offered = spark.createDataFrame([(1, 1, "water is pure"), (1, 1, "is pure"), (1, 9, "water"), (1, 1, "")], "query_id int, n int, quote string")
    sources = spark.createDataFrame([(1, 1, "Water is pure.")], "query_id int, n int, text string")
    assert sorted((r["quote"], r["shown"]) for r in P.meanings(asked, offered, sources).collect()) == [("", False), ("is pure", False), ("water", False), ("water is pure", True)]


def test_arabic_signs(spark):
    df = spark.createDataFrame([("قال ﷺ [ أ ] (١) «نص» [كلمة]",)], "t string")
    assert df.select(T.speakable("t")).first()[0] == "قال صلى الله عليه وسلم نص كلمة"
    assert df.select(T.normalise(F.lit("إأآٱىةؤئ"), ARABIC)).first()[0] == "اااايهوي"


def test_answers_and_study_items(spark):
    df = spark.createDataFrame([("answerable", "may I"), ("odd", "x"), ("contemporary", "I")], "s string, q string")
    assert [r[0] for r in df.select(V.scope_gate(F.col("s"), F.col("q"), "(^| )I", ["answerable", "contemporary"])).collect()] == ["personal_fatwa", "answerable", "contemporary"]
    assert df.select(V.depth_rule(F.col("s"), {"odd": "short"}, "as needed")).distinct().count() == 2
    bad = V.degraded(spark.createDataFrame([(1, None, "supported"), (2, "content_filter", "supported"), (3, "timeout", "supported")], "id int, error string, status string"))
    assert rows(bad.select("id", "search_only", "status")) == [(1, False, "supported"), (2, False, "not_found"), (3, True, "not_found")]
    claims = spark.createDataFrame([(1, 0, "x")], "question_id int, k int, text string")
    assert V.keep_all(claims).first()["kept"] and V.closed_book(claims).first()["n"] is None
    items = spark.createDataFrame([("s", 0, "P1", "pure", ["a", "b"], 1), ("s", 1, "P1", "pure", ["a"], 0), ("s", 2, "P1", "dirty", None, None), ("s", 3, "P1", "water", None, None)], "section string, k int, label string, quote string, options array<string>, answer int")
    passages = spark.createDataFrame([("s", 1, "Water is pure")], "section string, n int, text string")
    verdicts = spark.createDataFrame([("s", 3, False)], "section string, k int, supported boolean")
    assert rows(V.study_items(items, passages, verdicts)) == [("s", 3, 2, 1)]


def test_scores_and_projections(spark):
    s = spark.createDataFrame([([("My Book", "page 12", None), ("?", "", None)], True)], "sentences array<struct<book:string,page:string,cite:struct<book_id:int,page:int>>>, closed boolean")
    assert [tuple(x) for x in s.select(E.citations(F.col("sentences"), F.col("closed"), [("Book", 7)]).alias("c")).first()["c"]] == [(7, 12), (None, None)]
    img = spark.createDataFrame([("data:image/png;base64,AA",), ("data:text/html,x",), (None,)], "d string")
    assert [r[0] for r in img.select(J.image_ok(F.col("d"))).collect()] == [True, False, False]
    src = spark.createDataFrame([("a", True), ("b", False)], "n string, enabled boolean")
    assert [J.available(src, w).count() for w in ("all", "on", "soon")] == [2, 1, 1] and J.listed(src, "n", ["a"]).count() == 1 and J.listed(src, "n", []).count() == 2
    res = spark.createDataFrame([(1, "log", [(1, 2, "v", 3, "k", "text")])], "id int, calls string, passages array<struct<n:int,book_id:int,vol:string,page:int,kind:string,text:string>>")
    assert J.slim_results(res).columns == ["id", "passages"] and J.slim_results(res).schema["passages"].dataType.elementType.names == J.SHOWN
    units = spark.createDataFrame([("u1", "x"), ("u2", "y")], "unit string, t string")
    chapters = spark.createDataFrame([("c", ["u2", "u1", "u9"])], "id string, units array<string>")
    assert [r["t"] for r in J.chapter_units(chapters, units, "c").collect()] == ["y", "x"] and J.chapter_units(chapters, units, "z").count() == 0
    notes = spark.createDataFrame([(1, "graded sound by x", "last words"), (2, "mere", "w")], "id int, text string, lemma string")
    kind = F.when(F.contains("text", F.lit("graded")), "takhrij").otherwise("note")
    got = J.reference_notes(notes, notes, kind, F.lit(True), "sound|weak", "https://example.org/?q=")
    assert sorted((r["source"], r["id"], r["grades"]) for r in got.collect()) == [("first", 1, ["sound"]), ("second", 1, ["sound"])]
    assert J.longer(notes, "text", 5).count() == 1 and J.headings(spark.createDataFrame([(1, 80), (3, 1), (2, 81)], "level int, page int")).count() == 1
    passage = spark.createDataFrame([tuple("x" for _ in J.CITATION) + ("t",)], [*J.CITATION, "text"])
    assert J.citation(passage).columns == J.CITATION
    cached = spark.createDataFrame([("a", 100), ("b", 900)], "k string, s long").selectExpr("k", "timestamp_seconds(s) as at")
    assert rows(Z.fresh(cached, "at", F.timestamp_seconds(F.lit(1000))).select("k")) == [("b",)]

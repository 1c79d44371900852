from __future__ import annotations

import html
import re

from pyspark.sql import functions as F

from docspark.functions import sequences as Q
from docspark.functions import text as T
from docspark.functions.profiles import ARABIC, UNICODE
from docspark.operators import linking as L
from docspark.operators import passages as P
from docspark.streaming import state as Z

RULES = [("([a-z]{3,}) is ([a-z ]{3,40})", "", "def"), ("(it) means ([a-z ]{3,40})", "means ", "gloss")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_glossary_of_four_sources(spark):
    chapters = spark.createDataFrame([(1, "p1", "c", "Of Water", "It is a clear liquid; and more."), (2, "p2", "c", "Of Vessels", "Nothing here.")], "id int, para string, chapter string, title string, text string")
    units = spark.createDataFrame([(3, "p1", "c", "pure", "water is wet stuff"), (4, "p1", "c", "pure", "it means without stain"), (5, "p1", "c", "one two three four", "it means nothing at all")], "id int, para string, chapter string, core string, text string")
    notes = spark.createDataFrame([(6, "p1", "c", "the jug", "exact", "plural of jug, a vessel"), (7, "p1", "c", "Of Water", "title", "plural of nothing"), (8, "p1", "c", None, "exact", "spout is a part"), (9, "p1", "c", "big tank", "exact", "see above")], "id int, para string, chapter string, lemma string, method string, text string")
    sections = spark.createDataFrame([(10, "p2", "c", "«basin»", "it means a wide bowl"), (11, "p2", "c", None, "it means unsaid")], "id int, para string, chapter string, heading string, text string")
    got = P.glossary_sources(chapters, units, notes, sections, RULES, "It is ([^.;]{3,120})", "plural|from")
    assert rows(got.select("source", "id", "key", "definition", "kind")) == [
        ("note", 6, "jug", "plural of jug, a vessel", "note"),
        ("note", 8, "spout", "a part", "def"),
        ("opening", 1, "water", "a clear liquid", "def"),
        ("section", 10, "basin", "means a wide bowl", "gloss"),
        ("unit", 3, "water", "wet stuff", "def"),
        ("unit", 4, "pure", "means without stain", "gloss"),
    ]


def test_pool_and_memo_of_meanings(spark):
    looked = spark.createDataFrame([(1, k, "word", f"meaning {k}") for k in range(1, 7)], "query_id int, rank int, word string, definition string")
    ranked = spark.createDataFrame([(1, 1, "a passage"), (1, 2, "another"), (2, 1, "alone")], "query_id int, rank int, text string")
    pool = P.meaning_pool(looked, ranked)
    assert rows(pool) == [(1, 1, "word: meaning 1"), (1, 2, "word: meaning 2"), (1, 3, "word: meaning 3"), (1, 4, "word: meaning 4"), (1, 5, "a passage"), (1, 6, "another"), (2, 1, "alone")]
    asked = spark.createDataFrame([(1, "Passage", "Some context"), (2, "alone", None), (3, "passage!", "some CONTEXT")], "query_id int, word string, context string")
    offered = spark.createDataFrame([(1, 5, "a passage"), (1, 6, "not there"), (2, 1, "elsewhere")], "query_id int, n int, quote string")
    shown = P.meanings(asked, offered, pool)
    assert rows(shown.select("query_id", "n", "shown")) == [(1, 5, True), (1, 6, False), (2, 1, False)]
    both = shown.unionByName(shown.where("query_id = 1").withColumn("query_id", F.lit(3)))
    assert rows(P.worth_keeping(both, asked)) == [("passage|some context", 1)]


def test_functions_of_the_reading_views(spark):
    vowels = "".join(chr(c) for c in range(0x64B, 0x651))
    one = spark.range(1).select(
        T.strip_marks(F.lit("ب" + vowels + "ت")).alias("bare"),
        T.local_digits(F.lit("12.5%")).alias("local"),
        T.ascii_digits(F.lit("٣ و ٤")).alias("ascii"),
        T.highlight_pattern(F.lit("بت")).alias("pattern"),
        T.escape_html(F.lit("<a href=\"x\">&amp;</a> 'q'")).alias("safe"),
        Q.map_words(F.array(F.lit("albook"), F.lit("book"), F.lit("x")), F.array(F.lit("book"), F.lit("thebook"), F.lit("xx"))).alias("map"),
    ).first()
    assert one["bare"] == "بت" and one["local"] == "١٢٫٥٪" and one["ascii"] == "3 و 4" and one["map"] == [0, 1, 2]
    assert re.search(one["pattern"], "كتب" + vowels + "ت" + vowels)
    assert one["safe"] == html.escape("<a href=\"x\">&amp;</a> 'q'").replace("&#x27;", "'")
    assert ARABIC.marks and UNICODE.name == "unicode"


def test_fallback_takes_the_first_table_that_knows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    first, second = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, w string")
    assert rows(L.fallback(df, [(first, "v"), (second, "w")], ["k"], "got")) == [(1, "a"), (2, "y"), (3, "z"), (4, None)]


def test_hourly_activity_over_a_stream(spark, tmp_path):
    e = spark.range(30).selectExpr("element_at(array('view', 'buy'), cast(id % 2 + 1 as int)) as event_type", "timestamp_seconds(id * 600) as ts")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = Z.hourly_activity(stream, "ts").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = rows(spark.table("hours"))
    want = rows(e.where("ts < timestamp_seconds(29 * 600 - 3600)").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")))
    assert got and set(got) <= set(want)  # hours that the watermark has not passed stay open

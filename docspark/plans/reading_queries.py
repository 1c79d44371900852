"""Queries of the reading views over the test tables, each with the SQL it agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import UNICODE
from docspark.operators import reading as B
from docspark.plans.tables import table
from docspark.plans.text_queries import _NORM


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("conv", F.col("conv_id").cast("string"))


def _turn_words(spark: SparkSession, sf: str) -> DataFrame:
    c = _turns(spark, sf).select("conv", "turn", T.word_list(T.normalise("text", UNICODE)).alias("w"))
    return c.select("conv", "turn", F.size("w").alias("n"), F.posexplode("w").alias("k", "word"))


def recital_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines to learn by heart of each conversation, whose turns are the segments."""
    words = _turn_words(spark, sf).withColumn("ends", F.col("k") == F.col("n") - 1)
    lines = B.recital_lines(words, "conv", ["turn", "k"], "ends")
    return lines.groupBy("conv", "line").agg(F.count(F.lit(1)).alias("n_words"), F.min("place").alias("begins"))


def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of at most 300 words of each document, whose lines are the paragraphs."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    d = d.select("doc", "i", F.filter(F.split("line", " "), lambda w: w != "").alias("words"))
    return B.pages(d, "doc", ["i"], "words").select("doc", F.col("page").cast("long").alias("page"), "begins", "ends")


def word_timings(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn in a recording of ten seconds and some, after fourteen characters spoken before them."""
    words = _turn_words(spark, sf).withColumn("ms", F.col("turn") + 10_000)
    out = B.timings(words, ["conv", "turn"], ["k"], "word", "ms", lead=14)
    return out.select("conv", "turn", F.col("k").cast("long").alias("k"), "at")


def listening_order(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as paragraphs that share anchors, each taken once."""
    c = _turns(spark, sf).select("conv", "turn", F.array(F.col("turn") % 3, F.floor(F.col("turn") / 2)).cast("array<long>").alias("anchors"))
    return B.listening_order(c, "conv", ["turn"], "turn", "anchors").select("conv", F.col("turn").cast("long").alias("turn"), "anchor")


def links_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as sections with up to two hits each, linked in reading order."""
    t = F.col("turn").cast("long")
    hits = F.filter(F.array(t * 7 % 5, t * 3 % 11), lambda h: (t + h) % 3 != 0)
    s = _turns(spark, sf).select("conv", t.alias("turn"), hits.alias("hits"), (t % 5 == 4).alias("title"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") % 4).alias("opening"))
    return B.links_in_order(s, "conv", ["turn"], "turn", "hits", "title", "opening")


def suppliers_met(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each order as first met along its lines."""
    out = B.inverse_links(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], "l_suppkey")
    return out.select("l_orderkey", F.array_join(F.col("targets").cast("array<string>"), ",").alias("suppliers"), F.col("first").cast("long").alias("first"))


def notes_behind(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as marks (the first word of the name and a letter) and as notes of their brand and size, in tiers."""
    p = table(spark, sf, "part")
    w = F.split("p_name", " ")
    marks = p.select(F.col("p_partkey").alias("mark_id"), "p_brand", "p_size", F.concat(F.get(w, F.lit(0)), F.lit("s")).alias("word"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "takhrij").otherwise("variant")
    notes = p.select(F.col("p_partkey").alias("note_id"), "p_brand", "p_size", F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0))).alias("lemma"), kind.alias("kind"))
    out = B.notes_behind(marks, notes, ["p_brand", "p_size"], ["note_id"], F.col("note_id") % 2 == 0, profile=UNICODE)
    return out.select("mark_id", "note_id", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"))


def found_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Four words of each assistant turn, one of them misquoted, sought in all turns of the conversation."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]+", ""), " "), lambda w: w != "")
    v = _turns(spark, sf).select("conv", "turn", words.alias("tokens"))
    w = lambda k: F.get("tokens", F.lit(k))
    asked = v.where((F.col("turn") % 2 == 1) & (F.size("tokens") >= 6))
    quotes = asked.select("conv", F.concat_ws(":", "conv", "turn").alias("quote_id"), F.array(w(2), w(3), F.lit("zzz"), w(5)).alias("words"))
    out = B.find_quote(quotes, v, ["conv"], ["turn"])
    return out.select("quote_id", "turn", "score", F.col("begins").cast("long").alias("begins"), F.col("ends").cast("long").alias("ends"))


def quotes_by_number(spark: SparkSession, sf: str) -> DataFrame:
    """Events as quotes of a user's answer, by passage number."""
    e = table(spark, sf, "events").withColumn("n", F.col("event_id") % 3)
    out = B.quotes_by_number(e, ["user_id"], "n", ["event_id"], "event_type")
    return out.select("user_id", "n", F.md5(F.array_join("quotes", ",")).alias("quotes_md5"))


def complete_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as cards of their source's deck; short ones have no back."""
    d = table(spark, sf, "documents").select("source", "lang", F.when(F.col("n_chars") > 500, F.col("text")).otherwise(" ").alias("back"))
    return B.complete_cards(d, ["source"], "lang", "back")


QUERIES = {f.__name__: f for f in (recital_lines, page_ranges, word_timings, listening_order, links_in_order, suppliers_met, notes_behind, found_quotes, quotes_by_number, complete_cards)}

_WORDS = f"list_filter(string_split({_NORM}, ' '), lambda w: w <> '')"
_LIKE = "CAST({0} = {1} OR 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) >= 0.75 AS INT)"


def _cut(b: str) -> str:
    """End of the page that begins at b: the last paragraph end within 300 words, else the last sentence mark, else the limit."""
    return f"""CAST(CASE WHEN len(w) - {b} <= 300 THEN len(w) ELSE coalesce(list_max(list_filter(ends, lambda e: e > {b} AND e <= {b} + 300)),
  list_max(list_filter(range({b} + 220, {b} + 301), lambda k: regexp_matches(w[k], '[.؛:!؟]$'))), {b} + 300) END AS BIGINT)"""


ORACLE_SQL = {
    "recital_lines": f"""WITH RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS conv, turn, {_WORDS} AS w FROM conversations),
x AS (SELECT conv, turn, len(w) AS n, unnest(range(len(w))) AS k FROM t),
p AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY turn, k) - 1 AS place, k = n - 1 AS ends FROM x),
f AS (SELECT conv, place, 1 AS line, 1 AS held, ends FROM p WHERE place = 0 UNION ALL
  SELECT p.conv, p.place, f.line + CAST(f.held >= 14 OR (f.ends AND f.held >= 6) AS INT), CASE WHEN f.held >= 14 OR (f.ends AND f.held >= 6) THEN 1 ELSE f.held + 1 END, p.ends
  FROM f JOIN p ON p.conv = f.conv AND p.place = f.place + 1),
l AS (SELECT conv, line, count(*) AS n, min(place) AS b, max(line) OVER (PARTITION BY conv) AS most FROM f GROUP BY conv, line),
j AS (SELECT conv, CASE WHEN line = most AND line > 1 AND n < 3 THEN line - 1 ELSE line END AS line, n, b FROM l)
SELECT conv, line, CAST(sum(n) AS BIGINT) AS n_words, min(b) AS begins FROM j GROUP BY conv, line""",
    "page_ranges": f"""WITH RECURSIVE l AS (SELECT CAST(doc_id AS VARCHAR) AS doc, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l),
y AS (SELECT doc, i, list_filter(string_split(line, ' '), lambda v: v <> '') AS ws FROM x),
z AS (SELECT *, CAST(sum(len(ws)) OVER (PARTITION BY doc ORDER BY i) AS BIGINT) AS e FROM y),
d AS (SELECT doc, flatten(list(ws ORDER BY i)) AS w, list(e ORDER BY i) AS ends FROM z GROUP BY doc),
r AS (SELECT doc, CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS begins, {_cut("0")} AS ends_at FROM d UNION ALL
  SELECT doc, page + 1, ends_at, {_cut("ends_at")} FROM r JOIN d USING (doc) WHERE ends_at < len(w))
SELECT doc, page, begins, ends_at AS ends FROM r""",
    "word_timings": f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS conv, turn, {_WORDS} AS w FROM conversations),
x AS (SELECT conv, turn, unnest(range(len(w))) AS k, unnest(w) AS word FROM t)
SELECT conv, turn, k, CAST(floor((turn + 10000) * (coalesce(sum(length(word) + 1) OVER (PARTITION BY conv, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 14)
  / (sum(length(word) + 1) OVER (PARTITION BY conv, turn) + 14) + 0.5) AS BIGINT) AS at FROM x""",
    "listening_order": """WITH RECURSIVE f AS (SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS BIGINT) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
  [CAST(turn % 3 AS BIGINT), CAST(turn // 2 AS BIGINT)] AS anchors FROM conversations),
r AS (SELECT conv, turn, i, anchors[1] AS anchor, [anchors[1]] AS taken FROM f WHERE i = 1 UNION ALL
  SELECT f.conv, f.turn, f.i, list_filter(f.anchors, lambda a: NOT list_contains(r.taken, a))[1], list_concat(r.taken, f.anchors[1:CASE WHEN list_contains(r.taken, f.anchors[1]) THEN 2 ELSE 1 END])
  FROM r JOIN f ON f.conv = r.conv AND f.i = r.i + 1)
SELECT conv, turn, anchor FROM r""",
    "links_in_order": """WITH RECURSIVE f AS (SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(turn AS BIGINT) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn % 5 = 4 AS title,
  CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id % 4 AS BIGINT) END AS opening, list_filter([CAST(turn * 7 % 5 AS BIGINT), CAST(turn * 3 % 11 AS BIGINT)], lambda h: (turn + h) % 3 <> 0) AS hits FROM conversations),
r AS (SELECT DISTINCT conv, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS idx, '' AS method, CAST(NULL AS BIGINT) AS held FROM f UNION ALL
  SELECT conv, turn, i, idx, method, coalesce(idx, held) FROM (SELECT f.conv, f.turn, f.i, r.held,
    CASE WHEN title THEN opening WHEN len(hits) > 0 THEN coalesce(list_filter(hits, lambda h: h >= coalesce(r.held, -1))[1], hits[1]) ELSE r.held END AS idx,
    CASE WHEN title THEN 'title' WHEN len(hits) > 0 THEN 'hit' WHEN r.held IS NULL THEN 'none' ELSE 'order' END AS method
  FROM r JOIN f ON f.conv = r.conv AND f.i = r.i + 1))
SELECT conv, turn, idx, method FROM r WHERE i > 0""",
    "suppliers_met": """WITH s AS (SELECT l_orderkey, l_suppkey AS s, min(l_linenumber) AS m FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(CAST(s AS VARCHAR), ',' ORDER BY m, s) AS suppliers, CAST(arg_min(s, (m, s)) AS BIGINT) AS first FROM s GROUP BY l_orderkey""",
    "notes_behind": f"""WITH m AS (SELECT p_partkey AS mark_id, p_brand, p_size, string_split(p_name, ' ')[1] || 's' AS word FROM part),
n AS (SELECT p_partkey AS note_id, p_brand, p_size, string_split(p_name, ' ')[1] AS tail, p_partkey % 3 = 0 AS takhrij FROM part),
t AS (SELECT mark_id, note_id, CASE WHEN {_LIKE.format("word", "tail")} = 1 AND note_id % 2 = 0 THEN 1 WHEN {_LIKE.format("word", "tail")} = 1 THEN 2 WHEN takhrij THEN 3 END AS tier FROM m JOIN n USING (p_brand, p_size)),
b AS (SELECT *, min(tier) OVER (PARTITION BY mark_id) AS best FROM t WHERE tier IS NOT NULL)
SELECT mark_id, note_id, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY mark_id ORDER BY note_id) AS rank FROM b WHERE tier = best QUALIFY rank <= 3""",
    "found_quotes": f"""WITH v AS (SELECT CAST(conv_id AS VARCHAR) AS conv, turn, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]+', '', 'g'), ' '), lambda x: x <> '') AS t FROM conversations),
q AS (SELECT conv, conv || ':' || CAST(turn AS VARCHAR) AS quote_id, [t[3], t[4], 'zzz', t[6]] AS q FROM v WHERE turn % 2 = 1 AND len(t) >= 6),
c AS (SELECT quote_id, turn, q, t, unnest(range(len(t) - 3)) AS i FROM q JOIN v USING (conv)),
s AS (SELECT *, {", ".join(_LIKE.format(f"t[i + {k}]", f"q[{k}]") + f" AS l{k}" for k in (1, 2, 3, 4))} FROM c),
g AS (SELECT quote_id, turn, i, (l1 + l2 + l3 + l4) / 4 AS score FROM s WHERE l1 + l2 > 0 AND l1 + l2 + l3 + l4 >= 3)
SELECT quote_id, turn, score, i AS begins, i + 3 AS ends FROM g QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY score DESC, turn, i) = 1""",
    "quotes_by_number": "SELECT user_id, event_id % 3 AS n, md5(string_agg(event_type, ',' ORDER BY event_id)) AS quotes_md5 FROM events GROUP BY ALL",
    "complete_cards": "SELECT source, count(*) FILTER (WHERE trim(lang) <> '' AND n_chars > 500 AND trim(text) <> '') AS \"full\" FROM documents GROUP BY source",
}

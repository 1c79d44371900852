"""Queries over texts and pages, each with the SQL it agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import entities
from docspark.functions import text as T
from docspark.functions.profiles import UNICODE
from docspark.operators import retrieval as R
from docspark.operators.matching import nearest_text, substring_join
from docspark.plans.tables import table


def normalise_docs(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select("doc_id", T.normalise("text", UNICODE).alias("norm"))
    return n.select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("norm_chars"))


def html_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.trim(T.unescape(title)).alias("title"))


def html_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of a page in reading order, without tags, with their running character offset."""
    found = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("seq", "raw"))
    lines = found.select("page_id", F.col("seq").cast("long").alias("seq"), T.unescape(F.regexp_replace("raw", "<[^>]+>", " ")).alias("line"))
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("page_id", "seq", F.md5("line").alias("line_md5"), F.coalesce(F.sum(F.length("line")).over(w), F.lit(0)).alias("begins"))


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens("text", UNICODE)
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


def term_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    stats = R.term_stats(docs.select(F.explode(F.array_distinct(T.tokens("text", UNICODE))).alias("term")), docs.count())
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def verbatim_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that occur word for word, wherever they begin and end, and where first."""
    return _quote_hits(spark, sf).select("item_id", "doc_id", F.instr("norm", F.col("quote")).cast("long").alias("at"))


def _quote_hits(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, quote, doc_id, norm) of the documents that hold a benchmark text, both normalised."""
    quotes = table(spark, sf, "benchmark").select("item_id", T.normalise("text", UNICODE).alias("quote"))
    docs = table(spark, sf, "documents").select("doc_id", T.normalise("text", UNICODE).alias("norm"))
    return substring_join(quotes, docs, "quote", "norm", ["doc_id"]).join(quotes, "quote").join(docs, "doc_id")


def quote_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = _quote_hits(spark, sf)
    return hits.select("item_id", "doc_id", F.md5(T.quote_context("norm", F.col("quote"))).alias("context_md5"))


def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.content_id("text").alias("content_id"))


def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents in the order of a salted hash: the sampling operator."""
    seeded = table(spark, sf, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))).alias("draw"))
    return seeded.orderBy("draw", "doc_id").limit(50)


def part_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest other name of the same brand and size by edit similarity."""
    return nearest_text(table(spark, sf, "part"), "p_partkey", "p_name", ["p_brand", "p_size"])


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """JSON properties typed through an explicit schema, numbers coerced."""
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k string").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 1)"
_QUOTES = f"""WITH q AS (SELECT item_id, {_NORM} AS quote FROM benchmark), d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
h AS (SELECT * FROM q JOIN d ON contains(norm, quote) WHERE quote <> '')"""

QUERIES = {f.__name__: f for f in (normalise_docs, html_titles, html_lines, token_stats, term_df_idf, verbatim_quotes, quote_context, content_ids, deterministic_sample, part_similarity, event_props)}

ORACLE_SQL = {
    "normalise_docs": f"SELECT doc_id, md5({_NORM}) AS norm_md5, CAST(length({_NORM}) AS BIGINT) AS norm_chars FROM documents",
    "html_titles": f"SELECT page_id, trim({entities.oracle("t")}) AS title FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)",
    "html_lines": f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ls FROM pages),
u AS (SELECT page_id, unnest(range(len(ls))) AS seq, ls FROM l),
x AS (SELECT page_id, seq, {entities.oracle("regexp_replace(ls[seq + 1], '<[^>]+>', ' ', 'g')")} AS line FROM u)
SELECT page_id, seq, md5(line) AS line_md5, CAST(coalesce(sum(length(line)) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM x""",
    "token_stats": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "term_df_idf": f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (max(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM t, n GROUP BY term""",
    "verbatim_quotes": _QUOTES + " SELECT item_id, doc_id, CAST(instr(norm, quote) AS BIGINT) AS at FROM h",
    "quote_context": _QUOTES + """, p AS (SELECT *, instr(norm, substr(quote, 1, 30)) AS pos FROM h)
SELECT item_id, doc_id, md5(CASE WHEN pos > 0 THEN substr(norm, greatest(1, pos - 220), pos + 220 - greatest(1, pos - 220)) ELSE substr(norm, 1, 440) END) AS context_md5 FROM p""",
    "content_ids": "SELECT doc_id, substr(sha1(text), 1, 8) AS content_id FROM documents",
    "deterministic_sample": "SELECT doc_id, lang, md5('42:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents ORDER BY draw, doc_id LIMIT 50",
    "part_similarity": """WITH s AS (SELECT a.p_partkey, b.p_partkey AS other, round(CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END, 6) AS score
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)
SELECT p_partkey, other, score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) = 1""",
    "event_props": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
}

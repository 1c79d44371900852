"""Line-first cleaning with DataFrame functions only.

Every line is judged on its own: punctuation (a line of more than MIN_WORDS
words without any sentence mark, or one with as many signs as words), navigation
(separators between short labels, or a line of a menu: MENU_LINES or more lines on end of at most MIN_WORDS words
without a sentence mark, blank lines between them not counted) and boilerplate (a short line with a stock
phrase, in English, French, German or Spanish). Failing lines are removed; a document that loses more than
MAX_LOSS percent of its word characters that way is rejected.

Repeated three-word windows are counted inside the row: each window becomes one
long, its hash above its position, one sort brings equal windows together, and
equal hashes are confirmed on the words themselves. No row is exploded and
nothing is shuffled, so long or frequent texts cost what their length costs.

Defined cases: a null text has no words and no lines with a word, fails the base
rules and is not kept; a text shorter than three words has no window; lines
without a word hold nothing to lose and are no repeats; ties and repeated rows give equal
rows; further columns are ignored by the query and carried by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty, words

MIN_WORDS, MAX_LOSS, STOCK_WORDS, MENU_LINES = 3, 50, 30, 4
WORD = "[^\\x20\\x09-\\x0D]"
SENTENCE_MARK = "[.!?\u2026\u3002\u061F]"
SEPARATORS = "|\u00BB\u00B7"
SIGNS = "#*$%&<>~^=_{}!" + SEPARATORS
#: Stock phrases of pages, not of their content.
PHRASES = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "sign in", "log in", "skip to content", "share this", "licensed under", "copyright"]
PHRASES += ["tous droits réservés", "politique de confidentialité", "mentions légales", "se connecter", "partager cet article", "accepter les cookies"]
PHRASES += ["alle rechte vorbehalten", "datenschutzerklärung", "impressum", "jetzt anmelden", "newsletter abonnieren", "cookies akzeptieren"]
PHRASES += ["todos los derechos reservados", "política de privacidad", "aviso legal", "iniciar sesión", "suscríbete al boletín", "aceptar cookies"]
#: A phrase stands between other characters than letters; ASCII is named, so that every engine reads the same.
STOCK = "(^|[^A-Za-z])(" + "|".join(PHRASES) + ")($|[^A-Za-z])"


def _line_fails(line: str = "l.line", n: str = "l.n") -> str:
    """SQL (of Spark) for one line's verdict; n: its words."""
    signs = f"regexp_replace({line}, '[^{SIGNS}]+', '')"
    separators = f"length(regexp_replace({line}, '[^{SEPARATORS}]+', ''))"
    return f"""({n} > {MIN_WORDS} AND NOT {line} RLIKE '{SENTENCE_MARK}')
        OR (length({signs}) >= {n} AND length({signs}) > 2)
        OR ({separators} >= 2 AND 3 * {separators} >= {n})
        OR ({n} <= {STOCK_WORDS} AND {line} RLIKE '(?iu){STOCK}')"""


def with_bad_lines(docs: DataFrame) -> DataFrame:
    """docs with __lines (all), __judged (each line with a word and the blank lines behind it; fails) and __bad (those that fail a rule)."""
    # A line takes the blank lines behind it along, so that neighbours in the array are neighbours in the menu.
    lines = F.split(text_or_empty("text"), f"\n(?=[^\n]*{WORD})", -1)
    out = docs.withColumns({"__lines": F.split(text_or_empty("text"), "\n", -1), "__judged": lines})
    judged = f"transform(__judged, x -> struct(x AS line, regexp_count(x, '{WORD.replace(chr(92), chr(92) * 2)}+') AS n))"
    alone = f"transform(__judged, l -> struct(l.line, {_line_fails()} AS fails, l.n BETWEEN 1 AND {MIN_WORDS} AND NOT l.line RLIKE '{SENTENCE_MARK}' AS short))"
    near = lambda k: f"coalesce(get(__judged, i + {k}).short, false)"
    menu = " OR ".join("(" + " AND ".join(near(first + k) for k in range(MENU_LINES)) + ")" for first in range(1 - MENU_LINES, 1))
    whole = f"transform(__judged, (l, i) -> struct(l.line, l.fails OR (l.short AND ({menu})) AS fails))"
    for step in (judged, alone, whole):
        out = out.withColumn("__judged", F.expr(step))
    return out.withColumn("__bad", F.expr("filter(__judged, l -> l.fails).line"))


def word_chars(c: Column) -> Column:
    """Characters of c that are no white space."""
    for blank in " \t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(blank), F.lit(""))
    return F.length(c).cast("long")


def repeat_words(array: str = "__words") -> list[tuple[str, str]]:
    """Named SQL steps whose last counts the words inside three-word windows that occur twice or more."""
    n = f"size({array})"
    return [
        ("__bits", f"length(bin({n}))"),
        ("__windows", f"sort_array(transform(IF({n} >= 3, sequence(0, {n} - 3), array()), i -> shiftleft(xxhash64({array}[i], {array}[i + 1], {array}[i + 2]), __bits) | i))"),
        ("__twice", f"""transform(filter(__windows, (x, k) -> {_same('k - 1', array)} OR {_same('k + 1', array)}), x -> x & (shiftleft(1L, __bits) - 1))"""),
        ("__starts", "sort_array(__twice)"),
        ("n_repeat_words", "aggregate(transform(__starts, (x, i) -> least(3L, coalesce(get(__starts, i + 1) - x, 3L))), 0L, (a, x) -> a + x)"),
    ]


def _same(other: str, array: str) -> str:
    """Whether window x and the sorted neighbour at ``other`` are the same three words."""
    mine, its = "int(x & (shiftleft(1L, __bits) - 1))", f"int(get(__windows, {other}) & (shiftleft(1L, __bits) - 1))"
    words_equal = " AND ".join(f"{array}[{mine} + {j}] = {array}[{its} + {j}]" for j in range(3))
    return f"(coalesce(shiftright(get(__windows, {other}), __bits) = shiftright(x, __bits), false) AND {words_equal})"


def measure(docs: DataFrame) -> DataFrame:
    """docs with the base figures, base_failed and kept."""
    text = text_or_empty("text")
    out = with_bad_lines(docs).withColumn("__words", words(text))
    for name, sql in repeat_words():
        out = out.withColumn(name, F.expr(sql))
    worded = F.filter("__lines", lambda line: line.rlike(WORD))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": word_chars(text),
            "lost_chars": word_chars(F.array_join("__bad", "")),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOSS * F.col("word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents, with the failing lines taken out of their texts."""
    # The document travels as one column, so that its own names clash with none of the measures.
    # The row number keeps the filter above the measures: pushed below them it would put whole arrays into each other's lambdas.
    judged = measure(docs.select(F.struct("*").alias("__row"), "text")).withColumn("__at", F.monotonically_increasing_id()).where("kept and __at >= 0")
    good = F.array_join(F.expr("filter(__judged, l -> NOT l.fails).line"), "\n")
    return judged.select(F.col("__row").withField("text", good).alias("__row")).select("__row.*")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def _oracle() -> str:
    r = "'[^\\x20\\x09-\\x0D]+'"
    n = f"len(regexp_extract_all(l, {r}))"
    count = lambda of: f"length(regexp_replace(l, '[^{of}]+', '', 'g'))"
    fails = f"""({n} > {MIN_WORDS} AND NOT regexp_matches(l, '{SENTENCE_MARK}')) OR ({count(SIGNS)} >= {n} AND {count(SIGNS)} > 2)
      OR ({count(SEPARATORS)} >= 2 AND 3 * {count(SEPARATORS)} >= {n}) OR ({n} <= {STOCK_WORDS} AND regexp_matches(l, '(?i){STOCK}'))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, {r}) AS w, string_split(t, chr(10)) AS ls FROM d),
l1 AS (SELECT row_number() OVER () AS rid, * FROM b),
ln AS (SELECT rid, unnest(range(len(ls))) AS k, unnest(ls) AS l FROM l1),
ls AS (SELECT *, regexp_matches(l, {r}) AS worded, {n} BETWEEN 1 AND {MIN_WORDS} AND NOT regexp_matches(l, '{SENTENCE_MARK}') AS short FROM ln),
li AS (SELECT *, row_number() OVER (PARTITION BY rid, worded ORDER BY k) - row_number() OVER (PARTITION BY rid, worded, short ORDER BY k) AS island FROM ls),
lm AS (SELECT *, worded AND short AND count(*) OVER (PARTITION BY rid, worded, short, island) >= {MENU_LINES} AS menu FROM li),
lv AS (SELECT rid, l, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c, worded, menu OR {fails} AS fails FROM lm),
lr AS (SELECT rid, sum(CASE WHEN fails THEN c ELSE 0 END) AS lost, count(*) FILTER (worded) - count(DISTINCT l) FILTER (worded) AS dup FROM lv GROUP BY rid),
g AS (SELECT rid, unnest(range(len(w) - 2)) AS i, w FROM l1 WHERE len(w) >= 3),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i + 1], w[i + 2], w[i + 3]) AS k FROM g),
cov AS (SELECT rid, count(DISTINCT p) AS rw FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE k >= 2) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rw, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_chars FROM l1 LEFT JOIN lr USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost_chars <= {MAX_LOSS} * word_chars AS kept, lost_chars FROM f
"""


ORACLE = _oracle()

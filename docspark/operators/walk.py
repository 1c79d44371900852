"""The unit walk of a commentary: paragraphs, units of core text, note marks with the words before them.

A line is cut at its round brackets into pieces. A bracket that holds a number is a note mark, any
other is core text and opens a unit; so does the first text of a chapter. A unit runs on over
paragraphs and pages until the next one opens or the chapter ends. A mark's lemma is
the last words since the mark, core text, title or chapter start before it; without
any it is the title, if nothing stood between, or the end of the core text.

All of this is state that crosses paragraphs. It is kept in running columns
(``operators.scan``) over the pieces of all books in reading order, so a chapter or book is spread
over tasks like any other rows; only a unit, a paragraph and a mark's last words are ever gathered.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import ARABIC, TextProfile
from docspark.operators.scan import PLACE, in_order, running
from docspark.plans.staging import stage

BRACKETS, DIGITS = "\\(([^()]*)\\)", "[٠-٩0-9]+"


class Walk(NamedTuple):
    """paragraphs: book_id, para, chapter, pg, text, heading, units (numbers, as met); units: book_id, unit, chapter, para, pg, core, text;
    markers: book_id, chapter, para, pg, n, place, lemma, how (text or title), unit, unit_pg. Numbers of paragraphs and units count from 1 in each book."""

    paragraphs: DataFrame
    units: DataFrame
    markers: DataFrame


def _pieces(body: Column) -> Column:
    """array of (kind, text) of a line: seg and mark or core in turn, tail at the end."""
    between, inner = F.split(body, BRACKETS, -1), F.regexp_extract_all(body, F.lit(BRACKETS), F.lit(1))
    piece = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    last = F.size(between) - 1

    def pair(text: Column, i: Column) -> Column:
        held = F.get(inner, i)
        kind = F.when(T.trimmed(held).rlike(f"^{DIGITS}$"), "mark").otherwise("core")
        return F.when(i == last, F.array(piece(F.lit("tail"), text))).otherwise(F.array(piece(F.lit("seg"), text), piece(kind, held)))

    return F.flatten(F.transform(between, pair))


def walk(events: DataFrame, profile: TextProfile = ARABIC, lemma_words: int = 12, heading_chars: int = 15) -> Walk:
    """Walk of events (book_id, chapter, pg, seq, kind: title or line, text); a line of few letters without digits is part of the next paragraph's heading."""
    body = T.guard_brackets(T.strip_markup("text"))
    norm = T.normalise(body, profile)
    short = (F.length(norm) <= heading_chars) & ~body.rlike(DIGITS)
    kept = events.select("book_id", "chapter", "pg", "seq", F.when(F.col("kind") == "title", "title").when(short, "short").otherwise("line").alias("kind"), F.when(F.col("kind") == "title", F.col("text")).otherwise(body).alias("text"))
    whole = F.array(F.struct("kind", "text"))
    cut = kept.select("book_id", "chapter", "pg", "seq", F.posexplode(F.when(F.col("kind") == "line", _pieces(F.col("text"))).otherwise(whole)).alias("k", "p")).select("book_id", "chapter", "pg", "seq", "k", "p.*")

    kind = F.col("kind")
    solid = F.col("text").rlike("\\S")
    core, mark = kind == "core", kind == "mark"
    spoken_words = F.when(kind.isin("seg", "tail", "core"), T.word_list(T.normalise("text", profile))).otherwise(F.array().cast("array<string>"))
    # What reads a whole text is told before the order is laid, so that the running columns need not read texts again.
    cut = cut.withColumns({"__said": core | (kind.isin("seg", "tail") & solid), "__size": F.size(spoken_words)})
    opens_para = (F.col("k") == 0) & kind.isin("seg", "tail")
    title = F.regexp_replace("text", "^[\\[\\]() ]+|[\\[\\]() ]+$", "")
    p = running(in_order(cut, ["book_id", "pg", "seq", "k"], "walk"), before={"__was": F.struct("book_id", "chapter")})
    new_book = F.col("__was").isNull() | ~F.col("__was.book_id").eqNullSafe(F.col("book_id"))
    p = p.withColumns({"__starts": new_book | ~F.col("__was.chapter").eqNullSafe(F.col("chapter")), "__new_book": new_book, "__para": opens_para})
    p = running(p, sums={"__texts": F.col("__said"), "__paras": F.col("__para")})
    p = running(p, last={"__texts_at": F.when(F.col("__starts"), F.col("__texts") - F.col("__said").cast("int")), "__paras_at": F.when(F.col("__new_book"), F.col("__paras") - F.col("__para").cast("int"))})
    p = p.withColumn("__opens", core | (F.col("__said") & (F.col("__texts") - 1 == F.col("__texts_at"))))
    state = {
        "__title": F.when(kind == "title", F.struct(title.alias("t"))).when(F.col("__said"), F.struct(F.lit(None).cast("string").alias("t"))),
        "__core": F.when(F.col("__opens"), F.struct(F.when(core, T.trimmed(F.col("text"))).otherwise("").alias("c"), F.col("pg").alias("pg"))),
    }
    p = running(p, sums={"__units": F.col("__opens"), "__fresh": F.col("__starts") | (kind == "title") | core, "__marks": mark, "__words": F.col("__size")}, last=state)
    p = running(p, last={"__units_at": F.when(F.col("__starts"), F.col("__units") - F.col("__opens").cast("int")), "__book_units": F.when(F.col("__new_book"), F.col("__units") - F.col("__opens").cast("int"))})
    # A mark closes its stretch: what comes after it begins a new one.
    stretch = F.col("__fresh") + F.col("__marks") - mark.cast("int")
    p = p.withColumns({"__in_unit": F.col("__units") > F.col("__units_at"), "para": F.col("__paras") - F.col("__paras_at"), "unit": F.col("__units") - F.col("__book_units"), "__stretch": stretch})
    p = stage(p.drop("__was", "__new_book", "__starts", "__texts", "__paras", "__texts_at", "__paras_at", "__units_at", "__book_units", "__fresh", "__marks"), "walked")

    # Units: their own pieces, from the opening one on.
    shown = F.when(kind.isin("core", "mark"), F.concat(F.lit("("), "text", F.lit(")"))).when(kind == "tail", F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    inside = p.where(F.col("__in_unit") & kind.isin("seg", "tail", "core", "mark"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(PLACE, shown.alias("t")))), lambda x: x["t"]), "")
    first = F.min(F.when(F.col("__opens"), F.struct(PLACE, "chapter", "para", "pg", F.col("__core.c").alias("core"))))
    units = inside.groupBy("book_id", "unit").agg(first.alias("f"), text.alias("text")).select("book_id", "unit", "f.chapter", "f.para", "f.pg", "f.core", "text")

    # Paragraphs, their headings (titles and short lines since the paragraph before, from the last title on) and units.
    rows = p.where(kind.isin("seg", "tail", "core", "mark"))
    bare = F.when(kind.isin("core", "mark"), F.concat(F.lit("("), "text", F.lit(")"))).otherwise(F.col("text"))
    para_text = T.trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(PLACE, bare.alias("t")))), lambda x: x["t"]), ""))
    # The chapter's page and name stand on every piece of a paragraph.
    paras = rows.groupBy("book_id", "para").agg(F.first("chapter").alias("chapter"), F.first("pg").alias("pg"), para_text.alias("text"))
    touched = p.where(F.col("__said") & F.col("__in_unit")).groupBy("book_id", "para", "unit").agg(F.min(PLACE).alias("at"))
    touched = touched.groupBy("book_id", "para").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "unit"))), lambda x: x["unit"]).alias("units"))
    heads = p.where(kind.isin("title", "short")).groupBy("book_id", (F.col("para") + 1).alias("para")).agg(F.array_sort(F.collect_list(F.struct(PLACE, (kind == "title").alias("is_title"), F.when(kind == "title", title).otherwise(T.trimmed(F.col("text"))).alias("t")))).alias("h"))
    joined = F.aggregate("h", F.lit(""), lambda s, x: F.when(x["is_title"] | (s == ""), x["t"]).otherwise(F.concat(s, F.lit(" "), x["t"])))
    paras = paras.join(touched, ["book_id", "para"], "left").join(heads.select("book_id", "para", joined.alias("heading")), ["book_id", "para"], "left")
    paras = paras.select("book_id", "para", "chapter", "pg", "text", "heading", F.coalesce("units", F.array().cast("array<bigint>")).alias("units"))

    # Marks: of the words since the last reset the last few, found by their running number.
    n = F.translate(T.trimmed(F.col("text")), "٠١٢٣٤٥٦٧٨٩", "0123456789").cast("int")
    unit = F.when(F.col("__in_unit"), F.col("unit"))
    marks = p.where(mark).select("book_id", "chapter", "para", "pg", n.alias("n"), F.col(PLACE).alias("place"), "__stretch", "__words", unit.alias("unit"), F.when(F.col("__in_unit"), F.col("__core.pg")).otherwise(F.col("pg")).alias("unit_pg"), F.col("__title.t").alias("__title"), F.when(F.col("__in_unit"), F.col("__core.c")).alias("__core"))
    spoken = p.where(F.col("__size") > 0).withColumn("__w", spoken_words).select("__stretch", F.col("__words").alias("__upto"), "__w", F.col(PLACE).alias("__p"))
    near = marks.select("__stretch", "place", "__words").join(spoken, "__stretch").where(F.col("__upto") > F.col("__words") - lemma_words)
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - lemma_words + 1), lemma_words)
    lemmas = near.groupBy("place").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__w"))), lambda x: x["__w"])).alias("__w")).select("place", tail(F.col("__w")).alias("__w"))
    named, cored = T.word_list(T.normalise("__title", profile)), tail(T.word_list(T.normalise("__core", profile)))
    none = F.coalesce(F.size("__w"), F.lit(0)) == 0
    by_title = none & (F.coalesce("__title", F.lit("")) != "")
    lemma = F.when(by_title, F.array_join(named, " ")).when(none, F.coalesce(F.array_join(cored, " "), F.lit(""))).otherwise(F.array_join("__w", " "))
    markers = marks.join(lemmas, "place", "left").select("book_id", "chapter", "para", "pg", "n", "place", lemma.alias("lemma"), F.when(by_title, "title").otherwise("text").alias("how"), "unit", "unit_pg")
    return Walk(paras, units, markers)

"""The passage corpus and the search over it: assembly of passages, modes of search, comparison of systems, glossary entries and their lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import UNICODE, TextProfile
from docspark.operators import retrieval as R

PASSAGE = ["book_id", "pg", "text", "para", "chapter", "kind", "note", "heading"]


def _closed(sizes: list[int], over: int) -> list[int]:
    """Number of the chunk of each piece: a chunk ends with the piece that makes it longer than ``over``; joined pieces have a blank between them."""
    out, n, held = [], 0, 0
    for size in sizes:
        out.append(n)
        held += size + (1 if held and size else 0)
        if held > over:
            n, held = n + 1, 0
    return out


def chunks(pieces: DataFrame, by: list[str], order: str, over: int, profile: TextProfile = UNICODE) -> DataFrame:
    """(by, chunk, first, text): the pieces (order, text) of each group merged in order until their normalised text is longer than ``over``.

    Only the sizes of a group meet in one row; texts are gathered a chunk at a time.
    """

    @F.pandas_udf("array<int>")
    def closed(sizes: pd.Series) -> pd.Series:
        return pd.Series([_closed(list(s), over) for s in sizes])

    sized = pieces.select(*by, order, F.length(T.normalise("text", profile)).alias("__n"))
    listed = sized.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "__n"))).alias("__l"))
    numbered = listed.select(*by, F.explode(F.arrays_zip(F.col(f"__l.{order}").alias(order), closed(F.col("__l.__n")).alias("chunk"))).alias("__x")).select(*by, f"__x.{order}", "__x.chunk")
    met = pieces.join(numbered, [*by, order])
    parts = F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("text"))))
    merged = met.groupBy(*by, "chunk").agg(F.min(order).alias("first"), parts.alias("__p"))
    return merged.select(*by, "chunk", "first", F.trim(F.array_join(F.col("__p.text"), " ")).alias("text"))


def passages(units: DataFrame, paras: DataFrame, notes: list[DataFrame], lines: DataFrame, contents: DataFrame, anchor: int, section_book: int, profile: TextProfile = UNICODE, unit_over: int = 120, line_over: int = 60, note_over: int = 20) -> DataFrame:
    """The corpus to search: chunks of the anchor book's units, its paragraphs without units, notes of more than ``note_over`` characters, chunks of section lines, the contents.

    units: para, seq, pg, text; paras: para, chapter, pg, text; notes: para, book_id, pg, n, text; lines: para, heading, seq, pg, text; contents: book_id, pg, text.
    """
    empty = F.lit(None)

    def shaped(rows: DataFrame, **given: Column) -> DataFrame:
        kinds = {"book_id": "int", "pg": "int", "text": "string", "para": "string", "chapter": "string", "kind": "string", "note": "int", "heading": "string"}
        return rows.select(*[given.get(c, F.col(c) if c in rows.columns else empty).cast(kinds[c]).alias(c) for c in PASSAGE])

    of = paras.select("para", "chapter")
    page_of = units.select("para", F.col("seq").alias("first"), "pg")
    own = chunks(units, ["para"], "seq", unit_over, profile).join(page_of, ["para", "first"]).join(of, "para")
    bare = paras.join(units.select("para").distinct(), "para", "left_anti")
    told = [n.where(F.length(T.normalise("text", profile)) > note_over).join(of, "para") for n in notes]
    line_page = lines.select("para", "heading", F.col("seq").alias("first"), "pg")
    parts = chunks(lines, ["para", "heading"], "seq", line_over, profile).join(line_page, ["para", "heading", "first"]).join(of, "para")
    branches = [shaped(own, book_id=F.lit(anchor), kind=F.lit("unit")), shaped(bare, book_id=F.lit(anchor), kind=F.lit("paragraph"))]
    branches += [shaped(n, note=F.col("n"), kind=F.lit("note")) for n in told]
    branches += [shaped(parts, book_id=F.lit(section_book), kind=F.lit("section")), shaped(contents, kind=F.lit("contents"))]
    return reduce(DataFrame.unionByName, branches)


def weighted(rows: DataFrame, anchor: int, reference: str, profile: TextProfile = UNICODE) -> DataFrame:
    """rows with norm, tokens and weight: 0.3 for short passages of other books that begin with a reference verb (pattern), else 1."""
    tokens = T.tokens("text", profile)
    low = (F.col("book_id") != anchor) & F.col("text").rlike(f"^(?:{reference})") & (F.size(tokens) < 60)
    return rows.select("*", T.normalise("text", profile).alias("norm"), tokens.alias("tokens"), F.when(low, 0.3).otherwise(1.0).alias("weight"))


def plain_passages(pages: DataFrame, notes: DataFrame, without_body: list[int], over: int = 30, profile: TextProfile = UNICODE) -> DataFrame:
    """(book_id, pg, text): body lines and notes of more than ``over`` normalised characters; some books give notes only."""
    lines = pages.where(~F.col("book_id").isin(without_body)).select("book_id", "pg", F.explode(F.split("text", "\n", -1)).alias("text"))
    both = lines.unionByName(notes.select("book_id", "pg", "text"))
    return both.where(F.length(T.normalise("text", profile)) > over)


def body_paragraphs(pages: DataFrame, over: int = 15, profile: TextProfile = UNICODE) -> DataFrame:
    """pages with seq and text of each body line whose normalised length is more than ``over``."""
    lines = pages.select(*[c for c in pages.columns if c != "text"], F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    return lines.where(F.length(T.normalise("text", profile)) > over)


# ------------------------------------------------------------------- search
def damped(dense: DataFrame, weights: DataFrame, query_id: str, id_: str, factor: float = 0.9) -> DataFrame:
    """Dense scores with those of low-weight passages damped, ranked anew."""
    met = dense.join(weights, id_, "left")
    return R.ranked(met.withColumn("score", F.col("score") * F.when(F.coalesce("weight", F.lit(1.0)) < 1, factor).otherwise(1.0)), query_id, id_, R.DEPTH).drop("weight")


def search(mode: str, keyword: DataFrame, dense: DataFrame | None, query_id: str, id_: str, k: int = 8) -> DataFrame:
    """(query_id, id, rank) of one mode: keyword, dense or hybrid. Without vectors every mode falls back to the keyword list."""
    if mode not in ("keyword", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "hybrid" and dense is not None:
        return R.hybrid(keyword, dense, query_id, id_, k)
    chosen = dense if mode == "dense" and dense is not None else keyword
    return chosen.where(F.col("rank") <= k).select(query_id, id_, "rank")


def first_hits(results: dict[str, DataFrame], gold: DataFrame, query_id: str, id_: str) -> DataFrame:
    """One row a query: each system's rank of the first gold passage, null if none is found. gold: query_id, id."""
    each = [df.join(gold, [query_id, id_]).groupBy(query_id).agg(F.min("rank").alias("rank")).withColumn("system", F.lit(name)) for name, df in results.items()]
    asked = gold.select(query_id).distinct()
    wide = reduce(DataFrame.unionByName, each).groupBy(query_id).pivot("system", list(results)).agg(F.first("rank"))
    return asked.join(wide, query_id, "left")


class Embedder(Protocol):
    """A model that turns texts into vectors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic stand-in: words counted into ``size`` places by their hash."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.size] += 1
        return out.tolist()


def embed(rows: DataFrame, text: str, provider: Embedder, cache: DataFrame | None = None, batch: int = 32, most: int = 6000) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, vectors that the cache lacks): each distinct text is embedded once, in batches; vectors have length 1 and five decimals.

    cache: key (SHA-1 of the text that is embedded), embedding.
    """
    keyed = rows.withColumn("__text", F.substring(F.coalesce(F.col(text), F.lit("")), 1, most)).withColumn("__key", F.sha1(F.col("__text").cast("binary")))
    wanted = keyed.select(F.col("__key").alias("key"), F.col("__text").alias("t")).distinct()
    if cache is not None:
        wanted = wanted.join(cache.select("key"), "key", "left_anti")

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                v = np.array(provider.embed(part["t"].tolist()), np.float64)
                norms = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.round(v / np.where(norms == 0, 1, norms), 5)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": list(v)})

    new = R.stage(wanted.mapInPandas(embedded, "key string, embedding array<double>"), "vectors")
    known = new if cache is None else new.unionByName(cache.select("key", "embedding"))
    out = keyed.join(known.withColumnRenamed("key", "__key"), "__key", "left").drop("__key", "__text")
    return out, new


# ----------------------------------------------------------------- glossary
def entries(passages_: DataFrame, rules: list[tuple[str, str, str]], openings: DataFrame | None = None, profile: TextProfile = UNICODE) -> DataFrame:
    """(key, word, definition, kind, id, para, chapter): what the rules find in passages (id, para, chapter, text, context).

    A word that says nothing by itself (a question word, or none) stands for the passage's context, words of what is being explained.
    openings: id, para, chapter, word, definition of chapters whose first sentence defines their title.
    """
    found = passages_.select("id", "para", "chapter", "context", F.explode(T.glosses("text", rules)).alias("g")).select("id", "para", "chapter", "context", "g.*")
    bare = F.try_element_at(T.word_list(T.normalise("word", profile)), F.lit(-1))
    asked = F.transform(T.word_list(T.normalise(F.lit(profile.question_words), profile)), lambda w: w)
    own = F.when(bare.isNull() | F.array_contains(asked, bare), F.coalesce("context", F.array().cast("array<string>"))).otherwise(F.array(bare))
    each = found.withColumn("word", F.explode(own)).drop("context")
    if openings is not None:
        each = each.unionByName(openings.select("id", "para", "chapter", "word", "definition", F.lit("def").alias("kind")))
    return _named(each, profile)


def _named(found: DataFrame, profile: TextProfile) -> DataFrame:
    """With their keys, those that have one and say something."""
    keyed = found.withColumn("key", T.match_key("word", profile))
    return keyed.where((F.length("key") >= 2) & (F.length(T.normalise("definition", profile)) >= 3))


def glossary_sources(chapters: DataFrame, units: DataFrame, notes: DataFrame, sections: DataFrame, rules: list[tuple[str, str, str]], opening: str, note_opening: str, profile: TextProfile = UNICODE) -> DataFrame:
    """(key, word, definition, kind, id, para, chapter) of the four places that define words, each told by ``source``: opening, unit, note, section.

    chapters (id, para, chapter, title, text): a first sentence that matches ``opening`` (one group) defines the title's last word.
    units (id, para, chapter, core, text): the rules, with the core text as what is being explained.
    notes (id, para, chapter, lemma, method, text): a note not linked by title that begins as ``note_opening`` defines its lemma's last
    word, by its first 300 characters (kind note); and the rules, with that word as context.
    sections (id, para, chapter, heading, text), one row a line: the rules, with the heading as context.
    """
    last = lambda c: F.try_element_at(F.filter(F.split(F.col(c), "\\s+"), lambda w: w != ""), F.lit(-1))
    begun = F.regexp_extract("text", f"^\\s*(?:{opening})", 1)
    openings = chapters.where(begun != "").select("id", "para", "chapter", last("title").alias("word"), T.trimmed(begun).alias("definition"))
    words = lambda c: T.content_words(F.coalesce(c, F.lit("")), profile)
    own = ["id", "para", "chapter", "text"]
    noted = notes.where(F.coalesce(F.trim("lemma"), F.lit("")) != "")
    told = noted.where((F.coalesce("method", F.lit("")) != "title") & F.col("text").rlike(f"^\\s*(?:{note_opening})"))
    parts = {
        "opening": _named(openings.withColumn("kind", F.lit("def")), profile),
        "unit": entries(units.select(*own, words(F.col("core")).alias("context")), rules, None, profile),
        "note": _named(told.select("id", "para", "chapter", last("lemma").alias("word"), F.substring("text", 1, 300).alias("definition"), F.lit("note").alias("kind")), profile).unionByName(
            entries(notes.select(*own, words(last("lemma")).alias("context")), rules, None, profile)
        ),
        "section": entries(sections.select(*own, words(F.regexp_replace("heading", "[«»\"]", " ")).alias("context")), rules, None, profile),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in parts.items()])


def lookup(entries_: DataFrame, words: DataFrame, kinds: list[str], k: int = 4, profile: TextProfile = UNICODE) -> DataFrame:
    """The k entries of each word (query_id, word, para, chapter): key equal to the stem of its last word or to the whole of it.

    Order: kind as listed, the query's paragraph, its chapter, id; of entries whose definitions begin alike (60 characters) the first stays.
    """
    norm = T.normalise("word", profile)
    asked = words.select("query_id", F.col("para").alias("__para"), F.col("chapter").alias("__chapter"), norm.alias("__norm")).where("__norm <> ''")
    stem = T.stem(F.element_at(F.split("__norm", " "), -1), profile)
    keys = asked.withColumn("key", F.explode(F.array_distinct(F.array(stem, F.col("__norm")))))
    met = keys.join(entries_, "key")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(kinds) + 1).otherwise(rank)
    order = [rank, ~F.col("para").eqNullSafe(F.col("__para")), ~F.col("chapter").eqNullSafe(F.col("__chapter")), F.col("id"), F.col("definition")]
    alike = Window.partitionBy("query_id", F.substring(T.normalise("definition", profile), 1, 60)).orderBy(*order)
    first = met.withColumn("__n", F.row_number().over(alike)).where("__n = 1")
    w = Window.partitionBy("query_id").orderBy(*order)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "key", "word", "definition", "kind", "id")


def meanings(asked: DataFrame, offered: DataFrame, sources: DataFrame, profile: TextProfile = UNICODE) -> DataFrame:
    """offered meanings (query_id, n, quote, ...) with ``shown``: the quote stands in source n of its query (query_id, n, text) and mentions the word (asked: query_id, word)."""
    met = offered.join(asked.select("query_id", "word"), "query_id").join(sources.select("query_id", "n", T.normalise("text", profile).alias("__norm")), ["query_id", "n"], "left")
    quote = T.normalise("quote", profile)
    ok = F.contains("__norm", quote) & (quote != "") & T.mentions(quote, T.normalise("word", profile))
    return met.withColumn("shown", F.coalesce(ok, F.lit(False))).drop("__norm")


def meaning_pool(looked_up: DataFrame, ranked_: DataFrame, entries_most: int = 4, passages_most: int = 8) -> DataFrame:
    """(query_id, n, text): the numbered texts that a meaning may quote: the first entries (query_id, rank, word, definition), then the best passages (query_id, rank, text)."""
    first = looked_up.where(F.col("rank") <= entries_most).select("query_id", F.lit(0).alias("__s"), "rank", F.concat_ws(": ", "word", "definition").alias("text"))
    then = ranked_.where(F.col("rank") <= passages_most).select("query_id", F.lit(1).alias("__s"), "rank", "text")
    w = Window.partitionBy("query_id").orderBy("__s", "rank", "text")
    return first.unionByName(then).select("query_id", F.row_number().over(w).alias("n"), "text")


def meaning_key(word: str | Column, context: str | Column, profile: TextProfile = UNICODE) -> Column:
    """What a remembered meaning goes by: the word, and the beginning of where it stands."""
    return F.concat_ws("|", T.normalise(word, profile), F.substring(T.normalise(F.coalesce(F.col(context) if isinstance(context, str) else context, F.lit("")), profile), 1, 120))


def worth_keeping(shown: DataFrame, asked: DataFrame, profile: TextProfile = UNICODE) -> DataFrame:
    """(key, query_id) of the questions (query_id, word, context) with a meaning to show; one a key, the first: what a memo of meanings keeps."""
    some = shown.where("shown").select("query_id").distinct().join(asked, "query_id")
    return some.select(meaning_key("word", "context", profile).alias("key"), "query_id").groupBy("key").agg(F.min("query_id").alias("query_id"))

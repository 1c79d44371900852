"""Views for reading: lines to learn by heart, pages, timings, listening order, links kept in reading order, fuzzy search for notes and quotes.

Rules that depend on what came before stream the ordered rows of a group through
a generator that holds only its running state, so a group may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import ARABIC, TextProfile
from docspark.operators.matching import similar_words

#: Marks that end a sentence when a page is cut. Fixed values.
SENTENCE_END = (".", "؛", ":", "!", "؟")


def _streamed(rows: DataFrame, by: str, order: list[str], held: list[str], each: Callable[[Iterator[tuple]], Iterator[tuple]], fields: str, batch: int = 5000) -> DataFrame:
    """(by, fields): what ``each`` yields from the ordered rows (held) of every group; ``by`` is a string column."""
    names = [by, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = (r for frame in batches for r in frame.itertuples(index=False, name=None))
        found = ((key, *x) for key, group in groupby(flat, key=lambda r: r[0]) for x in each(r[1:] for r in group))
        while part := list(islice(found, batch)):
            yield pd.DataFrame(part, columns=names, dtype=object)

    ordered = rows.repartition(by).sortWithinPartitions(by, *order).select(by, *held)
    return ordered.mapInPandas(run, f"{by} string, {fields}")


# ---------------------------------------------------------- learning by heart
def spoken_words(plain: Column, vocalised: Column, profile: TextProfile = ARABIC) -> Column:
    """Words of the vocalised form where both forms have the same normalised words, else those of the plain one."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda w: w != "")
    same = lambda c: F.transform(split(c), lambda w: T.normalise(w, profile))
    return F.when((F.size(split(vocalised)) > 0) & (same(vocalised) == same(plain)), split(vocalised)).otherwise(split(plain))


def recital_lines(words: DataFrame, by: str, order: list[str], ends: str, least: int = 6, most: int = 14) -> DataFrame:
    """(by, place, line) of each word of a group, places counted in order from 0, lines from 1.

    A line closes after ``most`` words, or where a segment ends (column
    ``ends``) once it has ``least``; a rest of under half of ``least`` words
    joins the line before it.
    """

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        line, held = 1, []
        for place, (end,) in enumerate(rows):
            held.append(place)
            if len(held) >= most or end and len(held) >= least:
                yield from ((p, line) for p in held)
                line, held = line + 1, []
        own = line - 1 if line > 1 and len(held) < least // 2 else line
        yield from ((p, own) for p in held)

    return _streamed(words, by, order, [ends], each, "place long, line int")


# ----------------------------------------------------------------------- pages
def pages(paragraphs: DataFrame, by: str, order: list[str], words: str, limit: int = 300, back: int = 80) -> DataFrame:
    """(by, page, begins, ends): word ranges of at most ``limit`` words; a text without words is one empty page.

    A page ends with a paragraph. A longer paragraph is cut after the last
    sentence mark among its page's last ``back`` words, or at the limit.
    """

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        page = first = at = 0
        for (own,) in rows:
            end = at + len(own)
            if at > first and end - first > limit:
                yield page, first, at
                page, first = page + 1, at
            while end - first > limit:
                ahead = own[first - at : first - at + limit]
                marks = [k for k in range(max(1, limit - back), limit + 1) if str(ahead[k - 1]).endswith(SENTENCE_END)]
                cut = first + (marks[-1] if marks else limit)
                yield page, first, cut
                page, first = page + 1, cut
            at = end
        if at > first or page == 0:
            yield page, first, at

    listed = paragraphs.withColumn(words, F.coalesce(words, F.array().cast("array<string>")))
    return _streamed(listed, by, order, [words], each, "page int, begins long, ends long")


def on_page(words: DataFrame, begins: Column, ends: Column, place: str = "place") -> DataFrame:
    """The words of one page."""
    return words.where((F.col(place) >= begins) & (F.col(place) < ends))


def timings(words: DataFrame, by: list[str], order: list[str], word: str, duration: str | Column, lead: int = 0) -> DataFrame:
    """words with ``at``: a recording's duration spread over its words by their length; ``lead`` characters are spoken before them."""
    size = F.length(word) + 1
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum(size).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + lead
    whole = F.sum(size).over(group) + lead
    length = F.col(duration) if isinstance(duration, str) else duration
    return words.withColumn("at", F.floor(length * before / whole + 0.5).cast("long"))


def listening_order(paragraphs: DataFrame, by: str, order: list[str], id_: str, anchors: str) -> DataFrame:
    """(by, id, anchor): each paragraph with the first of its anchors that none before it took, null if all are taken."""
    kinds = dict(paragraphs.dtypes)
    inner = kinds[anchors].removeprefix("array<").removesuffix(">")

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        taken = set()
        for name, own in rows:
            free = next((a for a in own if a not in taken), None)
            taken.add(free)
            yield name, free

    listed = paragraphs.withColumn(anchors, F.coalesce(anchors, F.array().cast(kinds[anchors])))
    return _streamed(listed, by, order, [id_, anchors], each, f"{id_} {kinds[id_]}, anchor {inner}")


# ----------------------------------------------------------------------- links
def links_in_order(sections: DataFrame, by: str, order: list[str], id_: str, hits: str, title: str, opening: str) -> DataFrame:
    """(by, id, idx, method) of each section: the first of its hits at or after the last linked place, else its first hit, else that place.

    Titles (boolean column) link to ``opening``, the first place of their chapter. method: title, hit, order or none.
    """
    kind = dict(sections.dtypes)[id_]

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for name, found, is_title, first in rows:
            if is_title:
                place, how = None if pd.isna(first) else int(first), "title"
            elif len(found):
                place, how = next((int(h) for h in found if last is None or h >= last), int(found[0])), "hit"
            else:
                place, how = last, "none" if last is None else "order"
            last = last if place is None else place
            yield name, place, how

    given = sections.withColumns({hits: F.coalesce(F.col(hits).cast("array<long>"), F.array().cast("array<long>")), title: F.coalesce(title, F.lit(False))})
    return _streamed(given, by, order, [id_, hits, title, opening], each, f"{id_} {kind}, idx long, method string")


def inverse_links(links: DataFrame, by: str, order: list[str], target: str) -> DataFrame:
    """(by, targets, first): distinct targets of each group in the order they are first met, combined before the shuffle.

    One row holds the targets of one paragraph, which are few.
    """
    seen = links.where(F.col(target).isNotNull()).groupBy(by, target).agg(F.min(F.struct(*order)).alias("__at"))
    listed = seen.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__at", target))).alias("__l"))
    return listed.select(by, F.col(f"__l.{target}").alias("targets"), F.get(f"__l.{target}", F.lit(0)).alias("first"))


# ---------------------------------------------------------------- fuzzy lookup
def notes_behind(marks: DataFrame, notes: DataFrame, on: list[str], order: list[str], editor: Column, kind: str = "takhrij", least: float = 0.75, k: int = 3, profile: TextProfile = ARABIC) -> DataFrame:
    """The k notes behind each mark (mark_id, on, word) with tier and rank; notes: on, lemma, kind, order.

    Tier 1: the editor's notes whose lemma's last word is like the marked word; 2: any such note; 3: notes of ``kind``. Only the best tier of a mark stays.
    Like words meet through an index of their forms; of the notes with one last word, and of those of ``kind``, only the first k can be behind a mark, so no key's marks and notes are paired.
    """
    last = T.stem(F.try_element_at(T.word_list(T.normalise(F.coalesce("lemma", F.lit("")), profile)), F.lit(-1)), profile)
    given = notes.select("*", F.coalesce(last, F.lit("")).alias("__last"), F.coalesce(editor, F.lit(False)).alias("__editor"))
    asked = marks.select("mark_id", *on, T.match_key("word", profile).alias("__key"))
    first = lambda df, by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")
    like = similar_words(asked, given, "__key", "__last", least)
    named = asked.join(like, "__key").join(first(given.where("__last <> ''"), [*on, "__last", "__editor"]), [*on, "__last"]).withColumn("tier", F.when(F.col("__editor"), 1).otherwise(2))
    kept = asked.join(first(given.where(F.col("kind") == kind), on), on).withColumn("tier", F.lit(3))
    tiered = named.drop("__key").unionByName(kept.drop("__key"))
    w = Window.partitionBy("mark_id").orderBy("tier", *order)
    best = tiered.withColumns({"rank": F.row_number().over(w), "__best": F.min("tier").over(Window.partitionBy("mark_id"))})
    return best.where((F.col("tier") == F.col("__best")) & (F.col("rank") <= k)).drop("__last", "__editor", "__best")


def find_quote(quotes: DataFrame, views: DataFrame, on: list[str], order: list[str], least: float = 0.6, enough: float = 0.75) -> DataFrame:
    """(quote_id, order, score, begins, ends): the best place of each quote (quote_id, on, words) among the views (on, order, tokens).

    The score is the share of words alike; of equal scores the first view and place stand. Quotes under three words and scores under ``least`` find nothing.
    A place counts if its first or second word is like the quote's, so quotes meet tokens through an index of
    like words, and only the places where they meet are compared. A view is named by ``on`` and ``order``.
    """
    asked = quotes.where(F.size("words") >= 3).select("quote_id", *on, "words")
    starts = asked.select("quote_id", *on, F.size("words").alias("__n"), F.posexplode(F.slice("words", 1, 2)).alias("__k", "__q"))
    tokens = views.select(*on, *order, F.size("tokens").alias("__of"), F.posexplode("tokens").alias("__p", "__t"))
    like = similar_words(starts, tokens, "__q", "__t", enough)
    met = starts.join(like, "__q").join(tokens, [*on, "__t"]).withColumn("__at", F.col("__p") - F.col("__k"))
    places = met.where((F.col("__at") >= 0) & (F.col("__at") + F.col("__n") <= F.col("__of"))).groupBy("quote_id", *on, *order).agg(F.collect_set("__at").alias("__at"))
    both = places.join(asked, ["quote_id", *on]).join(views.select(*on, *order, "tokens"), [*on, *order])
    alike = lambda at: F.aggregate(F.zip_with(F.slice("tokens", at + 1, F.size("words")), "words", lambda t, q: (T.similarity(t, q) >= enough).cast("int")), F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform("__at", lambda at: F.struct(alike(at).alias("n"), (-at).alias("at"))))
    found = both.withColumn("__b", best).select("quote_id", *order, (F.col("__b.n") / F.size("words")).alias("score"), (-F.col("__b.at")).alias("begins"), (F.size("words") - F.col("__b.at") - 1).alias("ends"))
    w = Window.partitionBy("quote_id").orderBy(F.desc("score"), *order)
    return found.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) & (F.col("score") >= least)).drop("__n")


# ------------------------------------------------------------------ small sums
def quotes_by_number(sentences: DataFrame, by: list[str], number: str, order: list[str], quote: str) -> DataFrame:
    """(by, number, quotes): kept quotes of one answer by the passage they come from, in order; an answer has few."""
    held = sentences.groupBy(*by, number).agg(F.array_sort(F.collect_list(F.struct(*order, quote))).alias("__l"))
    return held.select(*by, number, F.col(f"__l.{quote}").alias("quotes"))


def complete_cards(cards: DataFrame, by: list[str], front: str, back: str) -> DataFrame:
    """(by, full): cards of a deck with both sides filled."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return cards.groupBy(*by).agg(F.count_if(filled(front) & filled(back)).alias("full"))

"""Named projections and filters of the library: what is shown of a passage, and which rows count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import UNICODE, TextProfile

CITATION = ["book_id", "book", "vol", "page", "pg", "kind", "link", "id"]
SHOWN = ["n", "book_id", "vol", "page", "kind"]


def citation(passages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The eight fields that name a passage."""
    return passages.select(*keep, *CITATION)


def slim_results(results: DataFrame, internal: list[str] = ("calls",)) -> DataFrame:
    """Results without internal fields, their passages (array of struct) reduced to the fields that are stored."""
    slim = F.transform("passages", lambda p: F.struct(*[p[c].alias(c) for c in SHOWN]))
    return results.drop(*internal).withColumn("passages", slim)


def merged(rows: DataFrame, over: dict[str, Column]) -> DataFrame:
    """rows with fields replaced or added; a null replacement keeps what was there."""
    return rows.withColumns({n: F.coalesce(c, F.col(n)) if n in rows.columns else c for n, c in over.items()})


def longer(rows: DataFrame, text: str, over: int, profile: TextProfile = UNICODE) -> DataFrame:
    """Rows whose normalised text is longer than ``over``."""
    return rows.where(F.length(T.normalise(text, profile)) > over)


def heading_part(c: str, most: int = 15, profile: TextProfile = UNICODE) -> Column:
    """Whether a line is short and without digits, and so belongs to the heading."""
    norm = T.normalise(c, profile)
    return (F.length(norm) <= most) & ~norm.rlike("[0-9\u0660-\u0669]")


def headings(rows: DataFrame, level: int = 2, page: int = 80) -> DataFrame:
    return rows.where((F.col("level") <= level) & (F.col("page") <= page))


def scored_items(items: DataFrame, categories: list[str]) -> DataFrame:
    """Items with gold pages in the named categories."""
    return items.where((F.size("gold") > 0) & F.col("category").isin(categories))


def chapter_units(chapters: DataFrame, units: DataFrame, chapter: str) -> DataFrame:
    """One chapter's unit ids, in order, with their rows; an unknown chapter gives none."""
    ids = chapters.where(F.col("id") == chapter).select(F.posexplode("units").alias("seq", "unit"))
    return ids.join(units, "unit").orderBy("seq")


def reference_notes(first: DataFrame, second: DataFrame, kind: Column, about: Column, grades: str, base: str) -> DataFrame:
    """(source, kind, text, grades, link) of notes from two sources: of the first all that are no mere note, of the second those of kind reference that are about a saying."""
    shaped = lambda df, name: df.withColumn("kind", kind).withColumn("source", F.lit(name))
    both = shaped(first, "first").where("kind <> 'note'").unionByName(shaped(second, "second").where((F.col("kind") == "takhrij") & about))
    link = F.when(F.col("kind") == "takhrij", T.search_link(base, "lemma"))
    return both.select("source", "id", "kind", "text", T.all_matches("text", grades).alias("grades"), link.alias("link"))


def low_confidence(method: Column, agree: Column, weak: tuple[str, ...] = ("fuzzy", "none", "struct")) -> Column:
    return F.coalesce(method.isin(*weak), F.lit(False)) | F.coalesce(agree == F.lit(False), F.lit(False))


def available(sources: DataFrame, which: str) -> DataFrame:
    """Sources that are on, or announced, or all."""
    return sources if which == "all" else sources.where(F.col("enabled") == (which == "on"))


def worded(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text is more than dots and blanks."""
    return rows.where(~F.col(text).rlike("^[.\\s…]*$"))


def image_ok(data: Column, most: int = 4_000_000) -> Column:
    """Whether a payload is an image as a data URL of bounded length."""
    return F.coalesce((F.length(data) <= most) & data.rlike("^data:image/(png|jpeg|webp);base64,"), F.lit(False))


def listed(rows: DataFrame, id_: str, ids: list) -> DataFrame:
    """Rows whose id is on a given list; an empty list allows all."""
    return rows.where(F.col(id_).isin(ids)) if ids else rows


def references(rows: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """rows (book_id, pg) with ref: volume, page, place and link of their page; null where the page is unknown."""
    ref = F.struct("vol", "page", "pg", T.link(base, "book_id", "pg").alias("link"))
    return rows.join(pages.select("book_id", "pg", ref.alias("ref")), ["book_id", "pg"], "left")

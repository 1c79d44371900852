"""Ordered folds over lines and paragraphs: sections, chapters, units, greedy chunks, word offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def events(pages: DataFrame, title: str = '<span[^>]*data-type="?title"?[^>]*>(.*?)</span>') -> DataFrame:
    """(book_id, pg, seq, kind, text): titles and lines of each page in reading order."""
    marked = F.regexp_replace(F.regexp_replace("text", f"(?s){title}", "\n\u0001$1\n"), "\r", "")
    lines = pages.select("book_id", "pg", F.posexplode(F.split(marked, "\n", -1)).alias("seq", "raw"))
    kind = F.when(F.col("raw").startswith("\u0001"), "title").otherwise("line")
    return lines.select("book_id", "pg", "seq", kind.alias("kind"), F.trim(F.translate("raw", "\u0001", "")).alias("text")).where("text <> ''")


def chapters(rows: DataFrame, by: list[str], order: list[str], chapter: Column, end: Column | None = None) -> DataFrame:
    """rows with ``chapter``: the last one named so far; rows before the first and from the first end mark on are dropped."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("chapter", F.last(chapter, ignorenulls=True).over(w))
    if end is not None:
        out = out.withColumn("__ended", F.max(F.coalesce(end, F.lit(False)).cast("int")).over(w)).where("__ended = 0").drop("__ended")
    return out.where("chapter is not null")


def sections(rows: DataFrame, by: list[str], order: list[str], opens: Column) -> DataFrame:
    """rows with ``section``: running count of opening rows; rows before the first are dropped."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.sum(opens.cast("int")).over(w)).where("section > 0")


def changed(c: str, by: list[str], order: list[str]) -> Column:
    """Whether a row differs from the one before."""
    return ~F.col(c).eqNullSafe(F.lag(c).over(Window.partitionBy(*by).orderBy(*order)))


def offsets(size: str | Column, by: list[str], order: list[str]) -> Column:
    """Sum of the sizes before the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0))


def chunk_starts(sizes: Column, over: int, gap: int = 1) -> Column:
    """array of piece numbers that begin a chunk: a chunk takes pieces until it is longer than ``over``; ``gap`` characters part pieces unless the chunk is empty so far.

    One walk that holds the current size; what it keeps is one number a chunk.
    """
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("k"), F.lit(True).alias("new"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        held = F.when(s["new"] | (s["held"] == 0), x.cast("long")).otherwise(s["held"] + gap + x)
        return F.struct(held.alias("held"), (s["k"] + 1).alias("k"), (held > over).alias("new"), F.when(s["new"], F.concat(s["out"], F.array(s["k"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def pack(pieces: Column, over: int, join: str = " ") -> Column:
    """array of chunks: pieces are appended to a buffer until it is longer than ``over``, then it is emitted; the rest is flushed, unless it is empty.

    Chunk ends follow from the sizes alone; each text is cut out of the pieces once.
    """
    begins = chunk_starts(F.transform(pieces, lambda p: F.length(p)), over, len(join))
    taken = F.transform(begins, lambda b, i: F.array_join(F.slice(pieces, b + 1, F.coalesce(F.get(begins, i + 1), F.size(pieces)) - b), join))
    # An empty buffer takes the next piece as it is, so a chunk has no joint before its first piece with text.
    bare = F.transform(taken, lambda t: F.regexp_replace(t, f"^(?:{re.escape(join)})+", "")) if join else taken
    return F.filter(bare, lambda t: t != "")


def pack_below(sizes: Column, most: int) -> Column:
    """array of section numbers, one a size: a new section starts where adding the next would exceed ``most``."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["held"] + x > most) & (s["held"] > 0)
        return F.struct(F.when(new, x.cast("long")).otherwise(s["held"] + x).alias("held"), (s["k"] + 1).alias("k"), F.when(new, F.concat(s["out"], F.array(s["k"]))).otherwise(s["out"]).alias("out"))

    opened = F.aggregate(sizes, start, step, lambda s: s["out"])
    # Sections opened up to a place: those of ``opened`` that are no greater.
    ends = F.concat(opened, F.array(F.size(sizes)))
    return F.flatten(F.transform(ends, lambda e, i: F.array_repeat(i, e - F.coalesce(F.get(ends, i - 1), F.lit(0)))))


def fit_budget(rows: Column, most: int) -> Column:
    """rows (array of struct with anchor and size) that fit: anchors always, others skipped where the total would exceed ``most``."""
    start = F.struct(F.filter(rows, lambda _: F.lit(False)).alias("out"), F.lit(0).cast("long").alias("held"))

    def step(s: Column, r: Column) -> Column:
        taken = r["anchor"] | (s["held"] + r["size"] <= most)
        return F.struct(F.when(taken, F.concat(s["out"], F.array(r))).otherwise(s["out"]).alias("out"), F.when(taken, s["held"] + r["size"]).otherwise(s["held"]).cast("long").alias("held"))

    return F.aggregate(rows, start, step, lambda s: s["out"])

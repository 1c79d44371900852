"""Joins of the linking stage: as-of, band, nearest, cascade, keep-if-missing, lemmas over neighbours, notes and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.sequences import word_cover
from docspark.functions.text import word_list
from docspark.operators.matching import substring_join
from docspark.operators.scan import BLOCK, PLACE, in_order, running
from docspark.plans.staging import stage


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its group at or before its time (names prefixed last_).

    One union, one sort a group, no join of ranges. Of right rows at the same
    time the one with the largest values wins.
    """
    held = F.struct(*[F.col(v) for v in values])
    kind = held.alias("__r")
    stream = right.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), kind)
    empty = F.lit(None).cast(stream.schema["__r"].dataType)
    whole = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), empty.alias("__r"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    both = whole.unionByName(stream, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select("__l.*", *[F.col(f"__r.{v}").alias(f"last_{v}") for v in values])


def band_join(left: DataFrame, right: DataFrame, by: list[str], value: str, other: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of equal ``by`` with |value - other| <= width, as an equi-join on value div (2 * width + 1) and its neighbours.

    ``left`` adds the left rows that no right row is close to, with nulls.
    """
    step = 2 * width + 1
    cell = F.floor(F.col(value) / step)
    spread = right.withColumn("__cell", F.explode(F.array_distinct(F.array(F.floor((F.col(other) - width) / step), F.floor((F.col(other) + width) / step)))))
    close = left.withColumn("__cell", cell).join(spread, [*by, "__cell"]).where(F.abs(F.col(value) - F.col(other)) <= width).drop("__cell")
    if how == "inner":
        return close
    # Whether a left row meets any depends on its key and value alone.
    return close.unionByName(left.join(close.select(*by, value).distinct(), [*by, value], "left_anti"), allowMissingColumns=True)


def nearest(hits: DataFrame, by: list[str], index: str, near: str) -> DataFrame:
    """Of each group's hits the index nearest to ``near``, the first of equals; the first at all if near is null."""
    distance = F.when(F.col(near).isNull(), F.lit(0)).otherwise(F.abs(F.col(index) - F.col(near)))
    return hits.groupBy(*by).agg(F.min_by(index, F.struct(distance, F.col(index))).alias(index))


def keep_if_missing(rows: DataFrame, verdicts: DataFrame, on: list[str], flag: str, null_keeps: bool = False) -> DataFrame:
    """Left join on verdicts with ``kept``: a missing verdict keeps; a null one drops unless null_keeps."""
    met = rows.join(verdicts.withColumn("__seen", F.lit(True)), on, "left")
    said = F.coalesce(F.col(flag), F.lit(null_keeps))
    return met.withColumn("kept", F.coalesce(~F.coalesce("__seen", F.lit(False)) | said, F.lit(True))).drop("__seen")


def fallback(rows: DataFrame, tables: list[tuple[DataFrame, str]], on: list[str], into: str) -> DataFrame:
    """First value found in the tables, each joined left, in order."""
    out = rows
    for n, (t, value) in enumerate(tables):
        out = out.join(t.select(*on, F.col(value).alias(f"__v{n}")), on, "left")
    return out.withColumn(into, F.coalesce(*[f"__v{n}" for n in range(len(tables))])).drop(*[f"__v{n}" for n in range(len(tables))])


def resume(matrix: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What of a run matrix is still to do."""
    return matrix.join(done.select(*on).distinct(), on, "left_anti")


def cascade(rows: DataFrame, steps: list[tuple[str, DataFrame]], on: list[str]) -> DataFrame:
    """rows with the match and method of the first step that has one: later steps see only what is left."""
    left, out = rows, None
    for name, found in steps:
        met = left.join(found, on).withColumn("method", F.lit(name))
        out = met if out is None else out.unionByName(met)
        left = left.join(found, on, "left_anti")
    return out.unionByName(left, allowMissingColumns=True)


# ------------------------------------------------------------------ lemmas
def windows(units: DataFrame, size: int) -> DataFrame:
    """(chapter, at, idx, norm, joined, parts) of units (chapter, idx, norm): each with the next ``size`` - 1 of its chapter; parts: (idx, chars) of each.

    Units are numbered along one order of all, and a unit is sent to the windows that hold it, so no chapter is one group.
    """
    numbered = running(in_order(units.select("chapter", "idx", "norm"), ["chapter", "idx", "norm"], "units"), sums={"at": F.lit(1)}).drop(BLOCK, PLACE)
    held = numbered.withColumn("__w", F.explode(F.sequence(F.col("at") - (size - 1), F.col("at"))))
    row = F.array_sort(F.collect_list(F.struct("at", "idx", "norm")))
    met = held.groupBy("chapter", "__w").agg(row.alias("r")).where(F.get("r.at", F.lit(0)) == F.col("__w"))
    parts = F.transform("r", lambda x: F.struct(x["idx"].alias("idx"), F.length(x["norm"]).alias("n")))
    return met.select("chapter", F.col("__w").alias("at"), F.get("r.idx", F.lit(0)).alias("idx"), F.get("r.norm", F.lit(0)).alias("norm"), F.array_join("r.norm", " ").alias("joined"), parts.alias("parts"))


def _shared_words(lemmas: DataFrame, placed: DataFrame, least: float | None) -> DataFrame:
    """(lemma_id, at) of the windows that share a word with a lemma; with ``least``, one of the lemma's rarest words, of which a window that covers that much of it has at least one."""
    posted = placed.select("chapter", "at", F.explode(F.array_distinct(word_list("joined"))).alias("word"))
    own = lemmas.select("lemma_id", "chapter", F.explode(word_list("lemma")).alias("word"))
    if least is not None:
        spread = posted.groupBy("chapter", "word").agg(F.count(F.lit(1)).alias("__df"))
        size = F.size(word_list("lemma"))
        ranked = own.join(spread, ["chapter", "word"], "left").withColumn("__r", F.row_number().over(Window.partitionBy("lemma_id").orderBy(F.coalesce("__df", F.lit(0)), "word")))
        ranked = ranked.join(lemmas.select("lemma_id", (size - F.ceil(F.lit(least) * size - 1e-9) + 1).alias("__most")), "lemma_id")
        own = ranked.where((F.col("__r") <= F.col("__most")) & F.col("__df").isNotNull())
    return own.select("lemma_id", "chapter", "word").distinct().join(posted, ["chapter", "word"]).select("lemma_id", "at").distinct()


def _covered(pairs: DataFrame, lemmas: DataFrame, placed: DataFrame, least: Column) -> DataFrame:
    """(lemma_id, idx, score) of the pairs (lemma_id, at): compared in order only where the lemma's words that occur at all can reach ``least``."""
    met = pairs.join(lemmas.select("lemma_id", word_list("lemma").alias("__l")), "lemma_id").join(placed.select("at", "idx", word_list("joined").alias("__t")), "at")
    most = F.size(F.filter("__l", lambda w: F.array_contains(F.col("__t"), w))) / F.size("__l")
    return met.where(most >= least - 1e-9).withColumn("score", word_cover("__l", "__t")).select("lemma_id", "idx", "at", "score")


def lemma_links(lemmas: DataFrame, units: DataFrame, window: int = 3, least: float = 0.75, use_end: bool = True, score_none: bool = True) -> DataFrame:
    """(lemma_id, idx, method, score): where each lemma (lemma_id, chapter, lemma) is found among the units (chapter, idx, norm) of its chapter.

    In order: inside a unit; inside ``window`` neighbouring units joined, told by
    the unit where the match ends (or begins); the first unit whose window covers
    the most of its words in order, if ``least`` or more. A lemma of one word is
    ``too_short``, one without any place ``none``, with the best score that falls short (0 without ``score_none``, which spares the search for it).

    Word for word matches meet by keys (``substring_join``); others by an index from rare words to windows, and what
    meets is compared in order only where enough of the lemma's words occur.
    """
    lemmas = stage(lemmas.select("lemma_id", "chapter", "lemma"), "lemmas")
    long = lemmas.where(F.size(F.split(F.trim("lemma"), " ")) >= 2)
    short = lemmas.join(long.select("lemma_id"), "lemma_id", "left_anti")
    placed = stage(windows(units, window), "lemma-windows")

    def containing(of: DataFrame, text: str) -> DataFrame:
        pairs = substring_join(of, placed, "lemma", text, ["at"], ["chapter"])
        return of.join(pairs, ["chapter", "lemma"]).join(placed.drop("chapter", "norm"), "at")

    exact = stage(containing(long, "norm").select("lemma_id", "idx", F.lit(1.0).alias("score")), "lemma-exact")
    left = stage(long.join(exact.select("lemma_id"), "lemma_id", "left_anti"), "lemma-left")
    last = F.instr("joined", F.col("lemma")) + F.length("lemma") - 1
    reach = F.transform("parts", lambda x, i: F.struct(x["idx"].alias("idx"), F.aggregate(F.slice("parts", 1, i + 1), F.lit(0), lambda s, y: s + y["n"] + 1).alias("to")))
    end = F.get(F.filter(reach, lambda x: last <= x["to"]), F.lit(0))["idx"]
    span = stage(containing(left, "joined").select("lemma_id", (F.coalesce(end, F.col("idx")) if use_end else F.col("idx")).alias("idx"), F.lit(1.0).alias("score")), "lemma-spans")
    left = stage(left.join(span.select("lemma_id"), "lemma_id", "left_anti"), "lemma-left")

    best = lambda found: found.groupBy("lemma_id").agg(F.max_by(F.struct("idx", "score"), F.struct("score", -F.col("idx"))).alias("b")).select("lemma_id", "b.*")
    fuzzy = stage(best(_covered(_shared_words(left, placed, least), left, placed, F.lit(least))).where(F.col("score") >= least), "lemma-fuzzy")
    nothing = left.join(fuzzy.select("lemma_id"), "lemma_id", "left_anti")
    scores = None
    if score_none:
        # The window with most of the words first; then only those whose words could do better.
        pairs = stage(_shared_words(nothing, placed, None), "lemma-pairs")
        met = pairs.join(nothing.select("lemma_id", word_list("lemma").alias("__l")), "lemma_id").join(placed.select("at", word_list("joined").alias("__t")), "at")
        bound = stage(met.select("lemma_id", "at", (F.size(F.filter("__l", lambda w: F.array_contains(F.col("__t"), w))) / F.size("__l")).alias("__most")), "lemma-bounds")
        first = stage(_covered(bound.groupBy("lemma_id").agg(F.max_by("at", "__most").alias("at")), nothing, placed, F.lit(0.0)), "lemma-first")
        rest = bound.join(first.select("lemma_id", F.col("score").alias("__score")), "lemma_id").where(F.col("__most") > F.col("__score")).select("lemma_id", "at")
        scores = first.unionByName(_covered(rest, nothing, placed, F.lit(0.0))).groupBy("lemma_id").agg(F.max("score").alias("score"))
    kind = dict(units.dtypes)["idx"]
    none = nothing.join(scores, "lemma_id", "left") if scores is not None else nothing.withColumn("score", F.lit(0.0))
    none = none.select("lemma_id", F.lit(None).cast(kind).alias("idx"), F.coalesce("score", F.lit(0.0)).alias("score"))
    few = short.select("lemma_id", F.lit(None).cast(kind).alias("idx"), F.lit(0.0).alias("score"))
    parts = [x.withColumn("method", F.lit(m)) for x, m in ((exact, "exact"), (span, "exact_span"), (fuzzy, "fuzzy"), (none, "none"), (few, "too_short"))]
    return reduce(DataFrame.unionByName, parts).select("lemma_id", "idx", "method", F.round("score", 3).alias("score"))


def marker_notes(markers: DataFrame, notes: DataFrame, on: tuple[str, ...] = ("pg", "n")) -> DataFrame:
    """Each marker with the note of its own page and number; an empty note where there is none."""
    return markers.join(notes.select(*on, "note"), list(on), "left").withColumn("note", F.coalesce("note", F.lit("")))


def resolve_units(ids: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """unit id -> unit row -> paragraph; an unknown id keeps nulls."""
    return ids.join(units, unit, "left")


def attach(parents: DataFrame, children: DataFrame, on: str, order: list[str], into: str) -> DataFrame:
    """parents with their children as an ordered array of structs (empty without any); children without a parent drop out.

    A parent is a paragraph, whose children are few; its array is one row.
    """
    rest = [c for c in children.columns if c not in (on, *order)]
    held = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(into))
    met = parents.join(held, on, "left")
    kind = met.schema[into].dataType
    return met.withColumn(into, F.coalesce(into, F.array().cast(kind)))


def continue_notes(notes: DataFrame, pages: DataFrame, by: list[str], page: str = "pg", number: str = "n", text: str = "note") -> DataFrame:
    """Notes in which each page's number 0 is appended to the highest note of the page before, and goes.

    ``pages`` (by, page) lists all pages: behind one without notes a fragment is dropped. The first page's number 0 has
    nothing to continue and stays. Of several numbers 0 on a page the largest text counts.
    """
    order = Window.partitionBy(*by).orderBy(page)
    listed = pages.select(*by, page).distinct().select(*by, page, F.lag(page).over(order).alias("__before"))
    kept = notes.join(listed, [*by, page], "left").where((F.col(number) > 0) | F.col("__before").isNull())
    last = kept.groupBy(*by, page).agg(F.max(number).alias(number))
    more = notes.where((F.col(number) == 0) & (F.col(text) != "")).groupBy(*by, page).agg(F.max(text).alias("__more"))
    more = more.join(listed, [*by, page]).select(*by, F.col("__before").alias(page), "__more").join(last, [*by, page])
    joint = F.concat(F.regexp_replace(text, "[ =]+$", ""), F.lit(" "), F.regexp_replace("__more", "^[ =]+", ""))
    met = kept.drop("__before").join(more, [*by, page, number], "left")
    return met.withColumn(text, F.when(F.col("__more").isNotNull(), joint).otherwise(F.col(text))).drop("__more")

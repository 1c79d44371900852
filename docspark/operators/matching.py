"""Joins on likeness through indexes: substrings by word keys, words by edits, aligned sequences by anchors.

Each operator turns likeness into equality of keys that any true pair must share, joins on
the keys and checks the pairs that meet, so nothing is compared with everything.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator
from math import floor, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.retrieval import limited_broadcast
from docspark.operators.scan import PLACE, in_order, running
from docspark.plans.staging import stage

# ------------------------------------------------------------------ substrings
#: Inner words in a key, letters of a seam between two words, letters of a one-word key.
INNER, SEAM, LETTERS = 4, 3, 8
#: Keys of a group (``on``) in one row; a group with more has several rows, each of which meets all its texts.
GROUP_KEYS = 4096


def _needle_key(w: Column) -> tuple[Column, Column]:
    """(kind, key) of a needle's words. A needle may begin and end inside words, so only what lies between is sure to be whole."""
    n, a, b = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1))
    i, j, m = (F.least(F.length(x), F.lit(k)) for x, k in ((a, SEAM), (b, SEAM), (a, LETTERS)))
    inner = F.least(n - 2, F.lit(INNER))
    kind = F.when(n >= 3, inner).when(n == 2, 10 + SEAM * i + j).otherwise(100 + m)
    parts = F.when(n >= 3, F.array_join(F.slice(w, 2, inner), " ")).when(n == 2, F.concat(F.right(a, i), F.lit(" "), F.left(b, j))).otherwise(F.left(a, m))
    return kind, F.xxhash64(kind, parts)


def _offers(w: Column, kind: int) -> Column:
    """Keys of one kind that a text's words offer."""
    hashed = lambda x: F.xxhash64(F.lit(kind), x)
    if kind <= INNER:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - kind + 1))
        found = F.transform(starts, lambda i: hashed(F.array_join(F.slice(w, i, kind), " ")))
        return F.when(F.size(w) >= kind, found).otherwise(F.array().cast("array<bigint>"))
    if kind < 100:
        i, j = divmod(kind - 11, SEAM)
        j += 1
        return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), hashed(F.concat(F.right(a, F.lit(i)), F.lit(" "), F.left(b, F.lit(j))))))
    m = kind - 100
    inside = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - m + 1)), lambda p: hashed(F.substr(x, p, F.lit(m))))
    return F.flatten(F.transform(w, inside))


def substring_join(needles: DataFrame, texts: DataFrame, needle: str, text: str, id_: list[str], on: list[str] | None = None) -> DataFrame:
    """(on, id, needle) of every text that contains a needle, anywhere, also inside words; once a pair.

    Both columns are normalised (words parted by single blanks). ``id_`` names a text row uniquely together with ``on``. An empty needle is nowhere.
    A needle's key is its second to fifth word, the seam of its two words, or the first letters of its only word;
    texts offer the kinds of keys that occur, and what meets is compared whole. With ``on`` a text meets the keys of its
    group in arrays, so of what it offers only keys that a needle of its group has become rows.
    """
    on = on or []
    w = T.word_list(needle)
    kind, key = _needle_key(w)
    named = needles.select(*on, F.col(needle).alias("__needle")).where(F.col("__needle") != "").distinct().withColumn(needle, F.col("__needle"))
    keys = stage(named.select(*on, "__needle", F.md5("__needle").alias("__h"), kind.alias("__kind"), key.alias("__key")), "needles")
    kinds = sorted(r[0] for r in keys.select("__kind").distinct().collect())  # a few numbers
    own = texts.select(*on, *id_, F.col(text).alias("__text"))
    words = own.select(*on, *id_, T.word_list("__text").alias("__w"))
    offered = F.array_compact(F.array_distinct(F.concat(*[_offers(F.col("__w"), k) for k in kinds]))) if kinds else F.array().cast("array<bigint>")
    if on:
        own_keys = keys.select(*on, "__key").distinct()
        rows = own_keys.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / GROUP_KEYS).alias("__rows"))
        held = own_keys.join(rows, on).groupBy(*on, F.pmod("__key", "__rows").alias("__row")).agg(F.collect_list("__key").alias("__own"))
        words = words.join(held.select(*on, "__own"), on)
        offered = F.array_intersect(offered, "__own")
    met = words.select(*on, *id_, F.explode(offered).alias("__key")).join(limited_broadcast(keys.select(*on, "__key", "__h"), 20_000), [*on, "__key"])
    pairs = met.select(*on, *id_, "__h").distinct().join(keys.select(*on, "__h", "__needle"), [*on, "__h"])
    return pairs.join(own, [*on, *id_]).where(F.contains("__text", F.col("__needle"))).select(*on, *id_, F.col("__needle").alias(needle))


# ------------------------------------------------------------------ like words
#: Pairs whose longer word has at most SHORT letters meet by deletions, up to LONG by segments, beyond by length.
SHORT, LONG = 11, 64


def _allowed(longer: int, least: float) -> int:
    """Edits that leave a similarity of ``least``."""
    return floor((1 - least) * longer + 1e-9)


def word_forms(word: str, right: bool, least: float) -> set[str]:
    """Keys of a word such that two words at least ``least`` alike share one: deletions, segments against substrings, or a band of lengths."""
    n, out = len(word), set()
    if not n:
        return out
    reach = [m for m in range(floor(n * least), int(n / least) + 2) if m and abs(m - n) <= _allowed(max(m, n), least)]
    if n <= SHORT:
        most = max(_allowed(max(m, n), least) for m in reach if max(m, n) <= SHORT)
        left = {word}
        for _ in range(most + 1):
            out |= {"d" + w for w in left}
            left = {w[:i] + w[i + 1 :] for w in left for i in range(len(w))}
    for m in reach:
        longer = max(m, n)
        if SHORT < longer <= LONG:
            k, parted = _allowed(longer, least), n if right else m
            cuts = [parted * i // (k + 1) for i in range(k + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                places = [a] if right else range(max(0, a - k), min(n - (b - a), a + k) + 1)
                out |= {f"s{parted}:{m if right else n}:{i}:{word[p : p + b - a]}" for p in places}
    if max(reach) > LONG:
        band = int(log(n) / log(1 / least))
        out |= {f"l{band + d}" for d in ((-1, 0, 1) if right else (0,))}
    return out


def _word_keys(df: DataFrame, c: str, right: bool, least: float) -> DataFrame:
    """(c, form) of each word of c with the hashes of its forms. Words are small and their forms dear, so they are dealt over all shuffle partitions."""

    @F.pandas_udf("array<string>")
    def forms(words: pd.Series) -> pd.Series:
        return words.map(lambda w: list(word_forms(w, right, least)))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = df.select(c).where(F.col(c) != "").distinct().repartition(tasks, F.xxhash64(c))  # by c alone it would be the exchange of distinct, and merged again
    return words.select(c, F.explode(forms(c)).alias("__form")).select(c, F.xxhash64("__form").alias("__form"))


def similar_words(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.75) -> DataFrame:
    """(a, b) of the distinct words with similarity (1 - edits / longer length) of ``least`` or more; at least 0.7, as keys of fewer letters part nothing.

    Words meet by hashes of their forms. The left ones are staged, so whether they are sent whole goes by their size as keys, not as words.
    """
    if least < 0.7:
        raise ValueError("the index needs a similarity of at least 0.7")
    asked = stage(_word_keys(left, a, False, least), "word-keys")
    met = asked.join(_word_keys(right, b, True, least), "__form").select(a, b).distinct()
    return met.where(T.similarity(a, b) >= least)


# ---------------------------------------------------------------- nearest text
#: Texts of one group that are compared with all of the group under one key of a join.
ASKED = 64


def _two_least(rows: DataFrame, by: list[str], id_: str) -> DataFrame:
    """(by, __first, __second): the smallest id of each group and the next, null if there is none. Tasks send two ids a group."""
    w = Window.partitionBy(*by).orderBy(id_)
    least = rows.select(*by, id_, F.dense_rank().over(w).alias("__n")).where("__n <= 2")
    return least.groupBy(*by).agg(F.min(id_).alias("__first"), F.min(F.when(F.col("__n") == 2, F.col(id_))).alias("__second"))


def nearest_text(rows: DataFrame, id_: str, text: str, on: list[str]) -> DataFrame:
    """(id_, other, score) of each id: the other id with equal ``on`` whose text is likest, of equally like ones the smallest.

    Scores are similarities rounded to six digits; with a null text they are null and come last. Rows become the distinct texts of their
    group, with the two smallest ids of each. A text of two ids or more is answered by these, as no other text scores 1 (below a million
    letters). So only a text of a single id is compared, with each distinct text of its group once; the texts to compare
    are dealt by ASKED, and a group meets each deal of its own. Rows of few bytes may be many: no join sends a side whole.
    """
    own = rows.select(id_, text, *on).dropna(subset=[id_, *on])
    texts = stage(_two_least(own, [*on, text], id_), "texts")
    other = F.when(F.col(id_) == F.col("__first"), F.col("__second")).otherwise(F.col("__first")).alias("other")
    named, score = F.col(text).isNotNull(), F.lit(None).cast("double").alias("score")
    equal = own.join(texts.where(named & F.col("__second").isNotNull()).hint("merge"), [*on, text]).select(id_, F.lit(1.0).alias("score"), other)

    lone = texts.where(named & F.col("__second").isNull()).select(*on, F.col(text).alias("__text"), F.col("__first").alias(id_))
    deals = stage(lone.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("__deals")), "deals")
    asked = lone.join(deals.hint("merge"), on).withColumn("__deal", F.pmod(F.xxhash64("__text"), F.col("__deals")))
    # Few bytes are many comparisons: joins would gather them in few tasks.
    asked = asked.drop("__deals").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "__deal")
    group = texts.join(deals.hint("merge"), on).select(*on, text, "__first", "__second", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1)).alias("__deal"))
    pairs = asked.join(group.hint("merge"), [*on, "__deal"]).where(~F.col("__text").eqNullSafe(F.col(text)))
    scored = pairs.select(id_, F.when(named, F.round(T.similarity("__text", text), 6)).alias("score"), other).where("other is not null")
    like = scored.groupBy(id_, "score").agg(F.min("other").alias("other"))  # an id has few scores, and these are plain numbers to keep

    unnamed = texts.where(~named).select(*on)
    ids = texts.join(unnamed.hint("merge"), on, "left_semi").select(*on, F.explode(F.array("__first", "__second")).alias(id_)).dropna()
    rest = own.where(~named).join(_two_least(ids, on, id_).hint("merge"), on).select(id_, score, other).where("other is not null")

    found = equal.unionByName(like).unionByName(rest)
    best = found.groupBy(id_).agg(F.min(F.struct(F.col("score").isNull(), -F.col("score"), "other", "score")).alias("__best"))
    return best.select(id_, "__best.other", "__best.score")


# ------------------------------------------------------------------- alignment
def shared_places(x: list, y: list) -> list[tuple[int, int]]:
    """(place in x, place in y) of what two sequences share: the matching runs, and gaps between runs that are equally long in both."""
    found, i, j = [], 0, 0
    for block in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks():
        gap = block.a - i
        if gap == block.b - j:
            found += [(i + k, j + k) for k in range(gap)]
        found += [(block.a + k, block.b + k) for k in range(block.size)]
        i, j = block.a + block.size, block.b + block.size
    return found


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    ends, at, before = [], [], []
    for k, v in enumerate(values):
        p = bisect_left(ends, v)
        before.append(at[p - 1] if p else -1)
        ends[p : p + 1], at[p : p + 1] = [v], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _anchors(a: DataFrame, b: DataFrame, group: list[str], key: str) -> DataFrame:
    """(a_place, b_place): rows whose key occurs once in both sides of the group, the longest run of them that keeps its order.

    A group's anchors stream through one task as two numbers each.
    """
    once = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count(F.lit(1)).alias("__n"), F.min(PLACE).alias(name)).where("__n = 1").drop("__n")
    both = once(a, "a_place").join(once(b, "b_place"), [*group, key]).select(F.xxhash64(*group).alias("__group"), F.struct(*group).alias("__is"), "a_place", "b_place")

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []

        def flush() -> Iterator[pd.DataFrame]:
            keep = longest_increasing([y for _, y in held])
            if keep:
                yield pd.DataFrame([held[k] for k in keep], columns=["a_place", "b_place"])

        for batch in batches:
            for group_, x, y in zip(batch["__name"], batch["a_place"], batch["b_place"]):
                if group_ != name:
                    yield from flush()
                    name, held = group_, []
                held.append((x, y))
        yield from flush()

    named = both.select("__group", F.to_json("__is").alias("__name"), "a_place", "b_place")
    ordered = named.repartition("__group").sortWithinPartitions("__group", "__name", "a_place").select("__name", "a_place", "b_place")
    return ordered.mapInPandas(chosen, "a_place long, b_place long")


def align_sequences(a: DataFrame, b: DataFrame, by: str, order: str, key: str, chapter: str | None = None, rounds: int = 3, small: int = 500) -> DataFrame:
    """(by, a_index, b_index) of the rows that two ordered sequences share: equal runs, and replaced runs of one length.

    Rows whose key is unique on both sides anchor the alignment, as far as they keep
    their order; what lies between two anchors is a group of its own. Groups of more than ``small`` rows are anchored
    again by what is unique inside them, ``rounds`` times at most; then the groups are aligned one by one. No book is ever one group unless
    nothing in it is unique. With ``chapter`` only rows of the same chapter stay. Of rows at one place the smaller key is first.
    """
    held = [by, order, key, *([chapter] if chapter else [])]
    sides = [in_order(x.select(*held), [by, order, key], "aligned") for x in (a, b)]
    done, group = [], [by]
    for r in range(rounds):
        found = stage(_anchors(*sides, group, key), "anchors")
        gap, parted = f"__g{r}", []
        for side, place in zip(sides, ("a_place", "b_place")):
            marked = side.join(found.select(F.col(place).alias(PLACE), F.lit(1).alias("__anchor")), PLACE, "left")
            parted.append(running(marked, sums={gap: F.coalesce("__anchor", F.lit(0))}))
        pair = found
        for side, place, index in zip(sides, ("a_place", "b_place"), ("a", "b")):
            own = side.select(F.col(PLACE).alias(place), *([by] if index == "a" else []), F.col(order).alias(f"{index}_index"), *([F.col(chapter).alias(f"__{index}_chapter")] if chapter else []))
            pair = pair.join(own, place)
        done.append(pair.where(F.col("__a_chapter").eqNullSafe(F.col("__b_chapter"))) if chapter else pair)
        sides = [stage(x.where("__anchor is null").drop("__anchor"), "gaps") for x in parted]
        group = [*group, gap]
        # A further round only where it can part something: a group that is large on both sides.
        large = [x.groupBy(*group).count().where(F.col("count") > small).select(*group) for x in sides]
        if large[0].join(large[1], group, "left_semi").isEmpty():
            break
    out = done[0].select(by, "a_index", "b_index")
    for x in done[1:]:
        out = out.unionByName(x.select(by, "a_index", "b_index"))
    kinds = dict(sides[0].dtypes)

    def one(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values(PLACE), y.sort_values(PLACE)
        pairs = shared_places(y[key].tolist(), x[key].tolist())
        if chapter:
            of_x, of_y = x[chapter].tolist(), y[chapter].tolist()
            pairs = [(i, j) for i, j in pairs if of_y[i] == of_x[j]]
        return pd.DataFrame([(x[by].iloc[j], x[order].iloc[j], y[order].iloc[i]) for i, j in pairs], columns=[by, "a_index", "b_index"])

    rest = sides[0].groupBy(*group).cogroup(sides[1].groupBy(*group)).applyInPandas(one, f"{by} {kinds[by]}, a_index {kinds[order]}, b_index {kinds[order]}")
    return out.unionByName(rest)

"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with at most k edits: k is RATE of its length, rounded down. Cut
into k + 1 pieces (of 5 to 10 characters if k > 0), any such occurrence holds one
piece unchanged. All pieces of a block of items go into one Aho-Corasick automaton.
Short pieces hit often, so a hit must hold in ever longer runs of pieces first: of
the halves of a run of j + 1 pieces with at most j edits, one has no more edits than
pieces less one. A hit that passes gives a window of the text, and Myers'
bit-parallel distance decides. Items and texts are compared in lower case with everything but
letters and digits as single blanks.

Texts are scanned where they lie, nothing of them is shuffled. Items come in
blocks of at most ``block_chars`` characters, which bounds the automaton and
what is sent to the executors; further blocks are further passes over the
texts, so the benchmark may be of any size.

Defined cases: null and empty texts match nothing; an item without letters and
digits matches nothing; an item of fewer than 1 / RATE characters must occur exactly;
equal items are each reported; repeated documents are reported as often as they
occur; a null item_id or doc_id is carried as null; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty

#: A larger MIN_PIECE would lower the budget below RATE.
RATE, MIN_PIECE = 0.1, 1
BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item:int,distance:int,start:int,end:int>>"


def normal(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), "[^\\p{L}\\p{N}]+", " "))


def budget(length: int, rate: float = RATE, min_piece: int = MIN_PIECE) -> int:
    return max(0, min(int(rate * length), length // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces whose lengths differ by one at most."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str, anchored: int = 0) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of text (if ``anchored`` is 1: to any prefix), and where the first such ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = ph << 1 | anchored, mh << 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return best, end


def masks_of(item: str) -> dict[str, int]:
    mask: dict[str, int] = defaultdict(int)
    for j, c in enumerate(item):
        mask[c] |= 1 << j
    return dict(mask)


def runs(j: int, n: int) -> list[tuple[int, int]]:
    """Runs (from, to) of n pieces that hold piece j, each a half of the next; without the piece itself and the whole."""
    out, low, high = [], 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if j < mid else (mid, high)
        out.append((low, high))
    return out[-2::-1]


class Matcher:
    """The items of one block: automaton of all pieces, and per item its budget and bit masks."""

    def __init__(self, items: tuple[str, ...], rate: float, min_piece: int):
        import ahocorasick

        self.items = items
        self.k = [budget(len(t), rate, min_piece) for t in items]
        self.masks: list[dict[str, int]] = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)  # piece: items and numbers
        for i, t in enumerate(items):
            self.masks.append(masks_of(t))
            for j, (_, piece) in enumerate(pieces(t, self.k[i]) if t else []):
                found[piece].append((i, j))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.some = bool(found)

    def holds(self, i: int, j: int, start: int, text: str) -> bool:
        """Whether all runs around piece j of item i can occur with their edits, the item being laid at ``start``."""
        item, n = self.items[i], self.k[i] + 1
        for step, (low, high) in enumerate(runs(j, n)):
            a, b, k = len(item) * low // n, len(item) * high // n, high - low - 1
            if step == 0:
                # The piece itself is unchanged, so all edits lie in what is left of the run: of its k + 1 parts one is unchanged.
                c, d = (len(item) * (j + 1) // n, b) if j == low else (a, len(item) * j // n)
                near = text[max(0, start + c - k) : max(0, start + d + k)]
                if not any(item[c + (d - c) * x // (k + 1) : c + (d - c) * (x + 1) // (k + 1)] in near for x in range(k + 1)):
                    return False
            if myers(masks_of(item[a:b]), b - a, text[max(0, start + a - k) : max(0, start + b + k)])[0] > k:
                return False
        return True

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item within its budget."""
        if not self.some or not text:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (n, owners) in self.automaton.iter(text):
            for i, j in owners:
                start = end + 1 - n - len(self.items[i]) * j // (self.k[i] + 1)
                if start not in begins.get(i, ()) and self.holds(i, j, start, text):
                    begins[i].add(start)
        out = []
        for i, starts in begins.items():
            item, k, m = self.items[i], self.k[i], len(self.items[i])
            best = None
            low = None
            for s in [*sorted(starts), None]:
                if low is not None and (s is None or s - high > 2 * k):
                    a = max(0, low - k)
                    window = text[a : high + m + k]
                    at = window.find(item)
                    d, e = (0, at + m) if at >= 0 else myers(self.masks[i], m, window) if k else (m, 0)
                    if d <= k and (best is None or d < best[0]):
                        # The start: the same pattern and text read backwards from the end.
                        length = myers(masks_of(item[::-1]), m, window[max(0, e - m - d) : e][::-1], 1)[1] if d else m
                        best = (d, a + e - length, a + e)
                    low = None
                    if best and best[0] == 0:
                        break
                if s is not None:
                    low, high = (s, s) if low is None else (low, s)
            if best:
                out.append((i, *best))
        return sorted(out)


@lru_cache(maxsize=2)
def _matcher(items: tuple[str, ...], rate: float, min_piece: int) -> Matcher:
    return Matcher(items, rate, min_piece)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list]:
    """(item_id, normal text) of the items, a block at a time; one block is all the driver holds."""
    items = benchmark.select("item_id", normal("text").alias("text")).where("text <> ''").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n"))
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for b in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == b)
        if rows := own.orderBy("item_id", "text").collect():
            yield rows


def _shared(spark: SparkSession, rows: list, rate: float, min_piece: int):
    return spark.sparkContext.broadcast((tuple(r["text"] for r in rows), rate, min_piece))


def _matches(shared):
    @F.pandas_udf(MATCHES)
    def matches(texts: pd.Series) -> pd.Series:
        m = _matcher(*shared.value)
        return pd.Series([[dict(zip(("item", "distance", "start", "end"), x)) for x in m.search(t)] for t in texts])

    return matches(normal("text"))


def _leaked(shared):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        m = _matcher(*shared.value)
        return pd.Series([bool(m.search(t)) for t in texts], dtype=bool)

    return leaked(normal("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_piece: int = MIN_PIECE, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with item_id, distance, start and end (in the normal form of the text) of each item that occurs."""
    spark, out = docs.sparkSession, None
    for rows in _blocks(benchmark, block_chars):
        found = docs.select(F.struct(*keep).alias("__kept"), F.explode(_matches(_shared(spark, rows, rate, min_piece))).alias("__m"))
        # One row an item of the block, which bounds this broadcast.
        names = spark.createDataFrame([(k, r["item_id"], r["n"]) for k, r in enumerate(rows)], "__item int, __item_id long, __n long")
        found = found.join(F.broadcast(names), F.col("__m.item") == F.col("__item"))
        found = found.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))  # an item as often as the benchmark holds it
        found = found.select(*(F.col("__kept")[c].alias(c) for c in keep), F.col("__item_id").alias("item_id"), "__m.distance", "__m.start", "__m.end")
        out = found if out is None else out.unionAll(found)
    if out is None:
        nothing = F.lit(None)
        out = docs.select(*keep, nothing.cast("long").alias("item_id"), *(nothing.cast("int").alias(c) for c in ("distance", "start", "end"))).limit(0)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which no benchmark item occurs."""
    clean = docs
    for rows in _blocks(table(spark, sf_dir, "benchmark"), BLOCK_CHARS):
        clean = clean.where(~_leaked(_shared(spark, rows, RATE, MIN_PIECE)))
    return clean

"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id, row number of the scan), so equal texts
lie side by side and a group of copies larger than a shard is still split, also where rows
are equal in every way. Splitters are found by counting: every round lays candidate boundaries into the intervals
that still hold a splitter and counts the exact bytes below each of them in one
distributed aggregate, whose result has at most shards * PROBES rows; the bin
that holds the splitter becomes the next interval, shrunk to the keys that occur
in it. When no interval is left the splitters are exact: each boundary lies where
the bytes below it come nearest to its share, so it is off by half a document at
most. Then the rows are exchanged once.

Rounds grow with the logarithm of the row count and read a staged table of the
keys, never the texts. A splitter is three longs, whatever the input.

Defined cases: a null text has size 1 (nothing plus 1); a null doc_id sorts
first; rows equal in text and doc_id are split like others, by row number, and which of them
goes where makes no difference to the result; an empty table gives no rows; further columns are
carried by the stage (a column named shard is replaced) and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty
from docspark.plans.staging import stage

SHARDS, PROBES = 16, 256
NO_ID = -(2**63)
LAW = "bytes"


def text_hash(text: Column) -> Column:
    """60 bits of the text's MD5; never negative, so differences do not overflow."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def with_keys(docs: DataFrame) -> DataFrame:
    text = text_or_empty("text")
    return docs.withColumns({"__h": text_hash(text), "__d": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "__t": F.monotonically_increasing_id(), "__size": (F.octet_length(text) + 1).cast("long")})


KEY = ["__h", "__d", "__t"]


def _bound(key: tuple[int, int, int]) -> Column:
    return F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(key, KEY)))


@dataclass(frozen=True)
class Interval:
    """Keys from low to high (both occur), holding ``own`` bytes, with ``below`` bytes under low."""

    low: tuple[int, int, int]
    high: tuple[int, int, int]
    below: int
    own: int


def _bin(i: Interval) -> Column:
    """Number of the candidate bin in which a key of the interval lies: by hash, by id where only one hash is left, by row number where only one id is."""
    name, a, b = next((n, x, y) for n, x, y in zip(KEY, i.low, i.high) if x != y)
    wide = "cast({} as decimal(38,0))"  # ids may lie further apart than a long can say
    return F.expr(f"({wide.format(name)} - {wide.format(a)}) div {wide.format((b - a) // PROBES + 1)}" if name == "__d" else f"({name} - {a}L) div {(b - a) // PROBES + 1}L")


def _within(i: Interval) -> Column:
    return F.struct(*KEY).between(_bound(i.low), _bound(i.high))


def splitters(keys: DataFrame, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """For s = 1 .. shards - 1 the last key of the shards below s (row numbers begin at 0, so one less is a key before): the bytes up to it come nearest to s / shards of all."""
    first = keys.agg(F.sum("__size"), F.min(F.struct(*KEY)), F.max(F.struct(*KEY))).first()
    total = first[0]
    if total is None:
        return []
    whole = Interval(tuple(first[1]), tuple(first[2]), 0, total)
    open_: dict[int, Interval] = {s: whole for s in range(1, shards)}
    found: dict[int, tuple[int, int, int]] = {}
    while open_:
        for s in [s for s, i in open_.items() if i.low == i.high]:
            i = open_.pop(s)
            found[s] = (*i.low[:2], i.low[2] - 1) if (2 * i.below + i.own) * shards >= 2 * total * s else i.low
        intervals = list(dict.fromkeys(open_.values()))
        if not intervals:
            break
        number, bins = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, i in reversed(list(enumerate(intervals))):
            number = F.when(_within(i), k).otherwise(number)
            bins = F.when(_within(i), _bin(i).cast("long")).otherwise(bins)
        key = F.struct(*KEY)
        counted = (
            keys.select("__size", *KEY, number.alias("__i"), bins.alias("__b"))
            .where("__i is not null")
            .groupBy("__i", "__b")
            .agg(F.sum("__size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"))
            .collect()  # at most (shards - 1) * (PROBES + 1) rows
        )
        by = {k: sorted((r for r in counted if r["__i"] == k), key=lambda r: r["__b"]) for k in range(len(intervals))}
        for s, i in open_.items():
            below = i.below
            for r in by[intervals.index(i)]:
                if (below + r["bytes"]) * shards >= total * s:
                    open_[s] = Interval(tuple(r["low"]), tuple(r["high"]), below, r["bytes"])
                    break
                below += r["bytes"]
    return [found[s] for s in range(1, shards)]


def shard_of(at: list[tuple[int, int, int]]) -> Column:
    """Number of splitters below the key."""
    out = F.lit(0)
    for key in at:
        out = out + F.when(F.struct(*KEY) > _bound(key), 1).otherwise(0)
    return out.cast("int")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (a scan, whose rows keep their numbers when it is read again) with __h, __d, __t, __size and shard."""
    keyed = with_keys(docs)
    keys = stage(keyed.select(*KEY, "__size"), "shard-keys")
    return keyed.withColumn("shard", shard_of(splitters(keys, shards)))


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (with shard and KEY) with slot: the position inside the shard, gapless from 0.

    One range exchange by (shard, key) deals any shard over many tasks; the
    position in a sorted partition plus the rows that earlier partitions hold of
    the shard is the slot. The offsets have a row for each partition and shard
    that meet, at most partitions + shards.
    """
    dealt = rows.repartitionByRange("shard", *KEY).sortWithinPartitions("shard", *KEY)
    held = stage(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", 33)), "shard-slots")
    counts = held.groupBy("shard", "__p").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    offsets = counts.selectExpr("shard", "__p", "__first", "coalesce(sum(__n) over (partition by shard order by __p rows between unbounded preceding and 1 preceding), 0) as __before")
    return held.join(F.broadcast(offsets), ["shard", "__p"]).withColumn("slot", F.col("__at") - F.col("__first") + F.col("__before"))


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = with_keys(docs).select("doc_id", *KEY, "__size", F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"))
    keys = stage(keyed, "shard-keys")
    slotted = with_slots(keys.withColumn("shard", shard_of(splitters(keys))))
    return slotted.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their shard, range-dealt and sorted by shard and key."""
    placed = assign(docs)
    return placed.repartitionByRange("shard", *KEY).sortWithinPartitions("shard", *KEY).select(*[c for c in docs.columns if c != "shard"], "shard")


ORACLE = f"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS of_byte
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
k AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, coalesce(doc_id, {NO_ID}) AS d, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h, CAST(strlen(t) + 1 AS BIGINT) AS size, t FROM k),
c AS (SELECT *, sum(size) OVER (ORDER BY h, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below, sum(size) OVER () AS total FROM h),
s AS (SELECT *, CAST((2 * below + size) * {SHARDS} // (2 * total) AS INT) AS shard FROM c)
SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, of_byte[(xor(a, b) & 255) + 1]))) AS text_crc32, '{LAW}' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY h, d) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM s, crc
"""

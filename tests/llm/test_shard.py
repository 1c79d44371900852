from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from docspark.llm import shard


def brute(rows, shards=shard.SHARDS):
    keyed = sorted(((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), shard.NO_ID if i is None else i, len((t or "").encode()) + 1, i) for i, t in rows), key=lambda x: x[:2])
    total, below, out = sum(x[2] for x in keyed), 0, []
    for x in keyed:
        out.append((x[3], x[2], (2 * below + x[2]) * shards // (2 * total)))
        below += x[2]
    return sorted(out, key=repr)


def check(spark, d, rows):
    got = shard.op7_histogram_sort(spark, d).collect()
    assert sorted(((r["doc_id"], r["size"], r["shard"]) for r in got), key=repr) == brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return got


def test_odd_rows(spark, odd_docs, tables):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = check(spark, tables(documents=odd_docs), rows)
    assert {r["text_crc32"] for r in got} == {zlib.crc32((t or "").encode()) for _, t in rows}


def test_hot_text_is_split(spark, tables):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int")), F.col("id").cast("string"))).alias("text"))
    got = check(spark, tables(documents=docs), [(r[0], r[1]) for r in docs.collect()])
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 2 * max(r["size"] for r in got)


def test_equal_rows_are_split(spark, tables):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("some text "), F.col("id").cast("string"))).alias("text"))
    got = check(spark, tables(documents=docs.repartition(5)), [(r[0], r[1]) for r in docs.collect()])
    sizes = dict.fromkeys(range(16), 0)
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 2 * max(r["size"] for r in got)
    out = shard.write_order(spark, docs, "").groupBy("shard").count().collect()
    assert len(out) == 16 and max(r["count"] for r in out) < 70


def test_far_ids_of_one_text(spark, tables):
    ids = [-(2**63), 2**63 - 1, 0, 5, -7, 2**62, None, 3]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    check(spark, tables(documents=docs), [(i, "t") for i in ids])


def test_empty_native_and_stage(spark, odd_docs, no_docs, tables):
    assert shard.op7_histogram_sort(spark, tables(documents=no_docs)).count() == 0
    out = shard.write_order(spark, odd_docs, "")
    assert out.count() == odd_docs.count() and sorted(out.columns) == sorted(odd_docs.columns) and {r["shard"] for r in out.collect()} <= set(range(16))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docspark.llm import mixing


def brute_targets(sizes: dict, share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_odd(spark, d, rows):
    """As check, where rows share an id: figures of an id's sources."""
    got = mixing.op8_curriculum(spark, d).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = brute_targets(sizes)
    figures = sorted((i is not None, i or 0, sizes[s], round(want[s], 4)) for i, _, s in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["source_size"], round(r["target"], 4)) for r in got) == figures
    assert sum(r["taken"] for r in got) == pytest.approx(sum(want.values()), abs=len(want)) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    return got


def check(spark, d, rows):
    got = mixing.op8_curriculum(spark, d).collect()
    sizes, own = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-5) and 0 <= r["taken"] <= 2 * r["size"]
        own[s] = own.get(s, 0) + r["taken"]
    assert all(abs(own[s] - want[s]) <= 1 for s in own)
    again = mixing.op8_curriculum(spark, d).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    return got


def test_odd_rows(spark, odd_docs, tables):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    got = check_odd(spark, tables(documents=odd_docs), rows)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0} and {r["taken"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}


def test_hot_source_and_capped_targets(spark, tables):
    src = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), src.alias("source"))
    got = check(spark, tables(documents=docs), [tuple(r) for r in docs.collect()])
    assert any(r["target"] == 2 * r["source_size"] for r in got)
    assert all((r["position"] is None) == (r["taken"] == 0) for r in got)
    assert all(0 <= r["position"] <= 1 for r in got if r["position"] is not None)
    twice = [r for r in got if r["taken"] > r["size"]]
    assert twice and all(r["position"] < r["second_position"] <= 1 for r in twice) and all(r["second_position"] is None for r in got if r["taken"] <= r["size"])
    assert max(r["second_position"] for r in twice) > 0.9  # passes of a source with target 2 x size fill the whole of training
    assert [r["position"] or 0 for r in got] == sorted(r["position"] or 0 for r in got)


def test_equal_rows_and_blocks(spark, tables):
    """A third of the rows equal in id and text; the result does not depend on how the scan is cut."""
    rows = [(None, "w w w", "s")] * 300 + [(i, "w " * (i % 9), f"s{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = check_odd(spark, tables(documents=docs.repartition(1)), rows)
        many = check_odd(spark, tables(documents=docs.repartition(7)), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_schedule_is_inverted(spark):
    """At the position of a word the integral of the schedule is the word's share."""
    rows = [(k * 10, 20, 1000, 1000.0, s, 20) for k in range(0, 98) for s in (0.5, -0.5, 0.0)]
    df = spark.createDataFrame(rows, "__start long, __size long, source_size long, target double, slope double, taken long")
    for r in df.select("*", mixing.position(0).alias("t")).collect():
        share = (r["__start"] + 10) / 1000
        assert (1 + r["slope"]) * r["t"] - r["slope"] * r["t"] ** 2 == pytest.approx(share, abs=1e-9)


def test_stage_and_empty(spark, odd_docs, no_docs, tables):
    assert mixing.op8_curriculum(spark, tables(documents=no_docs)).count() == 0
    out = mixing.curriculum(spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    taken = {r["doc_id"]: 0 for r in odd_docs.collect()}
    assert set(n) <= set(taken) and 1 not in n and 2 not in n and 3 not in n
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_only_empty_texts(spark, tables):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.op8_curriculum(spark, tables(documents=docs)).collect()} == {(0.0, 0)}


def test_stage_orders_every_pass_by_its_own_position(spark):
    """The stage's order of documents and their repeats against brute force."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "abc"[i % 3] if i % 2 else "c") for i in range(120)]
    n = {i: 1 + i % 7 for i, _, _ in rows}
    sizes = {s: sum(n[i] for i, _, x in rows if x == s) for s in "abc"}
    target, want = brute_targets(sizes), []
    for k, s in enumerate("abc"):
        slope, before = mixing.SLOPES[k], 0
        own = sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        for pass_ in (0, 1):
            for i in own:
                if before < int(target[s] + 0.5):
                    low, high, share = 0.0, 1.0, min(1.0, (before + n[i] / 2) / target[s])
                    for _ in range(60):
                        mid = (low + high) / 2
                        low, high = (mid, high) if (1 + slope) * mid - slope * mid**2 < share else (low, mid)
                    want.append((low, s, i, pass_))
                before += n[i]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["source"], r["doc_id"]) for r in mixing.curriculum(spark, docs, "").collect()]
    assert any(target[s] == 2 * sizes[s] for s in "abc") and any(p for *_, p in want)
    for s in "abc":
        assert [i for x, i in got if x == s] == [i for _, x, i, _ in sorted(want) if x == s]
    places = {}
    for t, s, i, _ in want:
        places.setdefault((s, i), []).append(t)
    seen = dict.fromkeys(places, 0)
    order = []
    for key in got:
        order.append(places[key][seen[key]])
        seen[key] += 1
    assert len(got) == len(want) and all(b > a - 1e-6 for a, b in zip(order, order[1:]))

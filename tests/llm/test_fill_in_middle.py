from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.llm import fill_in_middle as M


def brute(doc_id, text, seed=7, fim_rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(df, **how):
    out = M.fill_in_middle(df, **how).withColumn("restored", M.restore("output", "form"))
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("how", [{}, {"slice_bytes": 1}, {"slice_bytes": 40}, {"seed": 3, "fim_rate": 60, "spm_rate": 0}])
def test_equals_brute_force_on_random_texts(spark, how):
    rng = random.Random(5)
    bits = ["\n", "\n\n", "a", "bé", "<P", ">", "<", "P>", "<M>", "😀", " ", "\r", " ", "<S>"]
    rows = [(i, "".join(rng.choice(bits if i % 4 else bits[:8]) for _ in range(rng.randrange(0, 30)))) for i in range(400)] + [(7, None), (None, "x\ny\nz"), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kernel = {k: v for k, v in how.items() if k != "slice_bytes"}
    want = sorted(((i, *brute(i, t, **kernel), t or "") for i, t in rows), key=str)
    assert sorted(made(df, **how), key=str) == want


def test_odd_rows_keep_their_own_columns(spark, odd_docs, no_docs):
    out = M.fill_in_middle(odd_docs, keep=("doc_id", "lang", "position", "kept"))
    assert out.columns[:4] == ["doc_id", "lang", "position", "kept"]
    got = sorted(((r.doc_id, *r[4:]) for r in out.collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.doc_id, r.text)) for r in odd_docs.collect()), key=str)
    assert M.fill_in_middle(no_docs).collect() == []
    with pytest.raises(ValueError):
        M.fill_in_middle(odd_docs.withColumn("n", F.lit(1)), keep=("n",))


def test_large_types_and_one_long_line(spark):
    long = "word " * 300_000
    df = spark.createDataFrame([(1, long), (2, long + "\n" + long), (3, "\n" * 50_000)], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert sorted(made(df)) == sorted((r.doc_id, *brute(r.doc_id, r.text), r.text) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_no_exchange(spark, odd_docs):
    assert "Exchange" not in M.fill_in_middle(odd_docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()


def test_query(spark, tables, odd_docs):
    got = M.op11_fill_in_middle(spark, tables(documents=odd_docs)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, *brute(r.doc_id, r.text)[:4], sha(brute(r.doc_id, r.text)[4]), sha(r.text or "")) for r in odd_docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import quality_qda as Q


def texts(n, seed=3):
    """(id, text, quality): prose of invented words, and junk of signs, capitals or repeats."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioursntl"), rng.integers(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [str(x) for x in rng.choice(words, rng.integers(20, 120))]
        for k in range(9, len(w), 10):
            w[k] += ".\n" if k % 20 == 19 else ","
        if i % 4 == 0:
            w = [[x + "%%%" for x in w], [x.upper() + "!!" for x in w], [w[0]] * len(w)][i // 4 % 3]
        out.append((i, " ".join(w).capitalize(), int(i % 4 != 0)))
    return out


def density(x, m, s):
    d = x - m
    return -0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1]


def test_differences_equal_the_densities_written_out(spark):
    rng = np.random.default_rng(1)
    groups = [rng.normal(size=(60, Q.WIDTH)) @ rng.normal(size=(Q.WIDTH, Q.WIDTH)) + k for k in (0, 1)]
    sums = np.stack([np.r_[len(x), x.sum(0), (x.T @ x).ravel()] for x in groups])
    model, a, b = Q.gaussians(sums, 0.3, 0.1), 0.3, 0.1
    means, covs = [x.mean(0) for x in groups], [np.cov(x.T, bias=True) for x in groups]
    pooled = (covs[0] + covs[1]) / 2
    shrunk = [(1 - b) * ((1 - a) * c + a * pooled) + b * np.trace(pooled) / Q.WIDTH * np.eye(Q.WIDTH) for c in covs]
    probe = rng.normal(size=(20, Q.WIDTH))
    want = [density(x, means[1], shrunk[1]) - density(x, means[0], shrunk[0]) for x in probe]
    assert np.allclose(np.sinh(model.differences(probe)), want, rtol=1e-6)


def test_moments_and_histograms_equal_all_rows_at_once(spark):
    rng = np.random.default_rng(2)
    x, f, bad, good = rng.normal(size=(90, Q.WIDTH)), rng.choice(Q.FOLDS, 90), rng.integers(0, 2, 90), rng.integers(0, 3, 90)
    rows = spark.createDataFrame([(int(a), int(b), int(c), d.tolist()) for a, b, c, d in zip(f, bad, good, x)], "fold int, bad long, good long, x array<double>").repartition(4)
    got = Q.moments(rows)
    for k in Q.FOLDS:
        for j, w in enumerate((bad, good)):
            v = np.where(f == k, w, 0)
            assert np.allclose(got[k][j], np.r_[v.sum(), v @ x, ((x * v[:, None]).T @ x).ravel()])
    model = Q.gaussians(sum(got.values()), 0.1, 0.1)
    counts = Q.histograms(rows, {(0, k): model for k in Q.FOLDS}, 1)
    assert counts[0].sum(1).tolist() == [bad.sum(), good.sum()]
    cells = np.clip(((model.differences(x) + Q.REACH) * Q.CELLS / (2 * Q.REACH)).astype(int), 0, Q.CELLS - 1)
    assert (counts[0, 1] == np.bincount(cells, good, Q.CELLS)).all()


def test_statistics_of_long_texts_are_sums_over_blocks():
    part = ("plain words here, again. " * 3000)[: Q.BLOCK]
    one, three = Q._counts(part), Q._counts(part * 3)
    assert np.array_equal(one * 3, three)
    assert np.isfinite(Q.vectors(["", "x", "\n", "%", "1 " * 10, "\ud800", "😀" * 5])).all()
    assert Q.vectors([]).shape == (0, Q.WIDTH)


def test_held_out_accuracy_and_labels_that_never_matter(spark, tables):
    rows = texts(1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumns({"x": F.lit("clash"), "fold": F.lit(9), "quality": F.lit(1)})
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.op13_quality_qda(spark, tables(documents=docs, labels=labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.98 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    turned = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in Q.op13_quality_qda(spark, tables(documents=docs.withColumn("source", F.lit("z")), labels=turned)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_odd_rows(spark, odd_docs, no_docs):
    some = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (5, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    got = Q.score_documents(odd_docs, some).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.doc_id: set() for r in got}
    for r in got:
        same[r.doc_id].add(r.score)
    assert len(same[5]) == 1
    assert Q.score_documents(no_docs, some).collect() == []
    none = Q.score_documents(odd_docs, some.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.0}
    trainable = next(i for i in (4, 5, 6, 7) if zlib.crc32(str(i).encode()) % 4 != 2)
    alone = Q.score_documents(odd_docs, spark.createDataFrame([(trainable, 1)], some.schema)).collect()
    assert {round(r.score, 6) for r in alone} == {1.0}


@pytest.mark.parametrize("repeat", [1, 5])
def test_repeated_rows_weigh_as_often_as_they_occur(spark, repeat):
    docs = spark.createDataFrame([(4, "a b")] * repeat + [(8, "c d e")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (8, 0)], "doc_id long, quality int")
    usable = [i for i in (4, 8) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = Q.labelled(Q.statistics(docs), labels).collect()
    assert sum(r.good for r in rows) == (2 * repeat if 4 in usable else 0)
    assert len(rows) == (repeat if 4 in usable else 0) + (8 in usable)

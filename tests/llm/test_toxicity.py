from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from docspark.llm import toxicity as tox

INSULTS = ["grobnik", "zatterhead", "mufflump"]


def corpus(n: int, seed: int):
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "th", "er", "ou", "in", "es"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                text.insert(r.randrange(len(text)), r.choice(INSULTS))
        out.append((i, " ".join(text), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(400, 1)
    return tox.train([t for _, t, _ in rows], np.array([y for *_, y in rows]), np.array([i % 5 == 0 for i, *_ in rows]), landmarks=120, rounds=2)


def test_held_out_accuracy(model):
    rows = corpus(200, 2)
    said = np.array(model.scores([t for _, t, _ in rows])) >= tox.THRESHOLD
    assert (said == np.array([y for *_, y in rows])).mean() > 0.97


def test_gaps_and_inserted_characters(model):
    plain = "than there in the ou ther an es"
    for insult in ("g.r.o.b.n.i.k", "g r o b n i k", "grobxnik", "zatter-head", "muffxlump"):
        assert model.scores([f"{plain} {insult} {plain}"])[0] > model.scores([f"{plain} theran {plain}"])[0]
    assert model.scores([f"{plain} g.r.o.b.n.i.k {plain}"])[0] >= tox.THRESHOLD


def test_collapsed_table_equals_kernel_sum():
    """The score by table is the weighted sum of kernel values with the landmarks."""
    r = np.random.default_rng(0)
    codes = tox.padded(tox.classes("what a grobnik that zatterhead is"))
    starts = np.arange(len(codes) - tox.WINDOW - tox.REACH)
    ids, weights = tox.features(codes, starts)
    marks, alpha = [0, 5, 9], r.normal(size=3)
    dense = np.zeros((len(starts), 32**tox.ORDER), np.float32)
    for k in range(len(starts)):
        np.add.at(dense[k], ids[k], weights[k])
    by_kernel = (dense @ dense[marks].T) @ alpha
    assert np.allclose(tox.window_sums(codes, (alpha @ dense[marks]).astype(np.float32))[: len(starts)], by_kernel, atol=1e-3)


def test_chunks_of_a_long_text_agree(model, monkeypatch):
    text = " ".join(t for _, t, _ in corpus(60, 3))
    whole = model.margins([text])
    monkeypatch.setattr(tox, "CHUNK", 500)
    assert np.allclose(model.margins([text]), whole, atol=1e-3)


def test_no_labels_of_a_class():
    assert tox.train(["a b"], np.array([0]), np.array([False])).scores(["x"])[0] < 0.01
    assert tox.train([], np.array([]), np.array([], bool)).scores(["", "x"]).tolist() == pytest.approx([0, 0], abs=1e-6)
    assert tox.train(["", ""], np.array([1, 0]), np.array([False, False])).scores(["x"])[0] == pytest.approx(0.5)


def test_other_scripts_and_bounded_sample(spark):
    assert len(set(tox.classes("привет").tolist())) > 3 and tox.classes("a\u201db\u2019c").tolist() == tox.classes("abc").tolist()
    docs = spark.createDataFrame([(1, "one text"), (1, "two texts"), (1, "three texts"), (2, "x" * 500), (3, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    seen = []
    fit, train = tox.fit, tox.train
    try:
        tox.train = lambda texts, toxic, calibrate: seen.append((texts, list(toxic)))
        fit(docs, labels, toxic_rows=2, clean_rows=5, max_chars=100)
    finally:
        tox.train = train
    texts, toxic = seen[0]
    assert sum(toxic) <= 2 and set(texts) <= {"one text", "two texts", "three texts", "clean"} and "x" * 500 not in texts


def test_query_and_stage(spark, odd_docs, no_docs, tables):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i + 100, t) for i, t, _ in rows], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(i + 100, 1, y) for i, _, y in rows] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "0.5 as score", "'x' as text")
    d = tables(documents=docs.selectExpr("*", "'z' as toxic"), labels=labels)
    got = tox.op3_toxicity(spark, d).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    toxic = {i + 100 for i, _, y in rows if y}
    held = [r for r in got if r["held_out"] and r["doc_id"] and r["doc_id"] >= 100]
    assert sum(r["predicted"] == (r["doc_id"] in toxic) for r in held) / len(held) > 0.9
    kept = {r["doc_id"] for r in tox.reject_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert len(kept & toxic) < 0.1 * len(toxic)
    assert tox.score_documents(no_docs, labels.limit(0)).count() == 0


def test_query_and_stage_train_outside_the_driver(spark, tables, monkeypatch):
    rows = corpus(60, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    own, task = tox.fit(docs, labels, 5, 20), tox.fit_in_task(docs, labels, 5, 20)
    assert own.values.any() and np.allclose(own.values, task.values, atol=1e-4)  # a task may sum with fewer threads
    assert np.allclose((own.bias, own.scale, own.shift), (task.bias, task.scale, task.shift), atol=1e-3)

    def never(*_):
        raise AssertionError("the driver trains")

    monkeypatch.setattr(tox, "train", never)
    d = tables(documents=docs, labels=labels)
    assert tox.op3_toxicity(spark, d).count() == 61
    assert tox.reject_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() < 61

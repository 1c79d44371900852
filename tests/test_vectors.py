from __future__ import annotations

import json
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from docspark.operators import retrieval as R
from docspark.operators import vectors as V
from docspark.sources import recorded


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    x[7] = 0
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(9000, None), (9001, [float(v) for v in x[5]])]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4).cache()


@pytest.mark.parametrize("part, queries", [(1 << 14, 4096), (40, 16)])
def test_exact_mode_equals_brute_force(vectors, monkeypatch, part, queries):
    monkeypatch.setattr(V, "PART_ROWS", part)
    monkeypatch.setattr(V, "QUERY_BLOCK", queries)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = rows(R.dense_topk(vectors, asked, 10).select("query_id", "vec_id", "score", "rank"))
    for probes in (1, 5):
        assert rows(V.nearest(V.build_index(vectors), asked, 10, probes=probes).select("query_id", "vec_id", "score", "rank")) == want


def test_recall_of_few_cells_and_rows_in_the_index(vectors):
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.build_index(vectors, sample=400)
    assert index.rows.count() == 1501 and len(index.centroids) == 38
    truth = R.dense_topk(vectors, asked, 10)
    assert V.recall(V.nearest(index, asked, 10, probes=8, exact=False), truth, "query_id", "vec_id") >= 0.9
    assert V.recall(V.nearest(index, asked, 10, probes=38, exact=False), truth, "query_id", "vec_id") == 1.0


def peak_mb(batch, task):
    """Most memory that a task holds over one batch, and the rows of its largest frame."""
    tracemalloc.start()
    most = max((len(frame) for frame in task(iter([batch]))), default=0)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return peak, most


def test_memory_of_a_task_does_not_grow_with_the_cells(vectors, monkeypatch):
    tasks, real = [], type(vectors).mapInPandas
    monkeypatch.setattr(type(vectors), "mapInPandas", lambda df, f, schema: (tasks.append(f), real(df, f, schema))[1])
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    V.nearest(V.build_index(vectors, cells=400), asked, 10)
    x = np.random.default_rng(5).normal(size=(4000, 16))
    batch = pd.DataFrame({"vec_id": range(4000), "query_id": range(4000), "embedding": list(x), "__reach": np.nan})
    assert len(tasks) >= 2
    for task in tasks:
        peak, most = peak_mb(batch, task)
        assert peak < 16 and most <= 4096


class Shared:
    def __init__(self, value):
        self.value = value


def test_memory_of_a_dense_search(vectors):
    rng = np.random.default_rng(5)
    asked, x = rng.normal(size=(4096, 8)), rng.normal(size=(1500, 8))
    x[[3, 700]], x[9] = x[1], np.nan
    asked[5] = np.nan
    task = R._best(Shared((np.arange(4096), asked)), 9, "vec_id", "embedding")
    batch = pd.DataFrame({"vec_id": np.arange(1500)[::-1], "embedding": list(x)})
    assert peak_mb(batch, task)[0] < 48
    found = next(task(iter([batch])))
    scores = np.round(asked @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)[:, ::-1]
    for q in range(0, 4096, 9):
        assert found[1][found[0] == q].tolist() == np.lexsort((np.arange(1500), -scores[q]))[:9].tolist()


def test_memory_of_a_keyword_search():
    docs, terms, queries = 600, 60, 100
    known = [f"t{k:02d}" for k in range(terms)]
    words = pa.array([known * 10] * docs, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.array([1.0] * docs), words], ["doc_id", "__weight", "__t"])
    peak, most = peak_mb(batch, R._term_counts(Shared(known), "doc_id"))
    assert peak < 10 and most < docs
    counted = pa.Table.from_batches(R._term_counts(Shared(known), "doc_id")(iter([batch])))
    assert counted["n"].to_pylist() == [600] * docs and counted["tfs"].to_pylist() == [[10] * terms] * docs
    post = {"names": list(range(queries)), "first": np.arange(terms + 1) * queries, "query": np.tile(np.arange(queries), terms), "qtf": np.ones(terms * queries), "idf": np.ones(terms), "mean": 600.0}
    task = R._best_by_terms(Shared(post), 7, "doc_id", 6)
    assert peak_mb(counted.to_pandas(), task)[0] < 32
    found = next(task(iter([counted.to_pandas()])))
    assert len(found) == 7 * queries and found[1].tolist() == list(range(7)) * queries


def test_no_vectors(vectors):
    asked = vectors.where("vec_id = 20").withColumnRenamed("vec_id", "query_id")
    assert V.nearest(V.build_index(vectors.limit(0)), asked, 3).count() == 0
    assert V.nearest(V.build_index(vectors), asked.limit(0), 3).count() == 0


def test_recorded_answers(spark, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    for n in [1, 2, 3, 6, 7, 11]:
        (folder / f"page_{n:03d}.json").write_text(json.dumps({"text": f"text {n}", "meta": json.dumps({"vol": "1", "page": n + 10})}))
    (folder / "page_012.json").write_bytes(b"\xff\xfe broken")
    (folder / "_ignored.json").write_text("x")
    (folder / "readme.txt").write_text("no number")
    batch = recorded.read(spark, str(folder), per_partition=2)
    assert batch.rdd.getNumPartitions() == 4
    assert [(r["number"], r["error"] is None) for r in batch.orderBy("number").collect()] == [(1, True), (2, True), (3, True), (6, True), (7, True), (11, True), (12, False)]
    assert rows(recorded.gaps(batch)) == [(12, 12), (4, 5), (8, 10)]
    assert [(r["pg"], r["text"], r["meta"]["page"]) for r in recorded.pages(batch).orderBy("pg").collect()][:2] == [(1, "text 1", 11), (2, "text 2", 12)]

    def drain():
        q = recorded.read_stream(spark, str(folder), per_partition=3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        return spark.read.schema(recorded.SCHEMA).parquet(str(tmp_path / "out"))

    assert rows(drain()) == rows(batch)
    (folder / "page_013.json").write_text("{}")
    assert rows(drain()) == rows(recorded.read(spark, str(folder)))
    good = tmp_path / "good"
    good.mkdir()
    (good / "4.json").write_text("{}")
    assert rows(recorded.from_text(spark, str(good))) == rows(recorded.read(spark, str(good)))


def test_recorded_searches(spark, tmp_path):
    hits = json.dumps([{"id": "a", "text": "one"}, {"id": "b", "text": "two"}])
    answer = json.dumps({"jsonrpc": "2.0", "result": {"content": [{"type": "image", "text": None}, {"type": "text", "text": hits}]}})
    (tmp_path / "1.txt").write_text(f"event: message\ndata: {answer}\n\n")
    (tmp_path / "2.txt").write_text(answer)
    (tmp_path / "3.txt").write_text("no answer")
    assert rows(recorded.search_passages(recorded.read(spark, str(tmp_path)))) == [(n, k, i, t) for n in (1, 2) for k, i, t in ((1, "a", "one"), (2, "b", "two"))]
    books = tmp_path / "books"
    books.mkdir()
    (books / "1.json").write_text(json.dumps([{"id": 1, "name": "x", "author": "y"}] * 3))
    (books / "2.json").write_text(json.dumps([{"id": 1, "name": "x", "author": "y"}, {"id": 2, "name": "z", "author": None}]))
    assert rows(recorded.books_found(recorded.read(spark, str(books)))) == [(1, "x", "y", 4), (2, "z", None, 1)]

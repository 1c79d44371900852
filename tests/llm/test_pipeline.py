from __future__ import annotations

import random
from pathlib import Path

import corpus_pipeline
from docspark.llm import queries
from docspark.plans.staging import shared_dir


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]
    assert [next(q for q in queries.QUERIES if q.startswith(f"op{k}_")) for k in range(1, 11)]


def test_run(spark, tables):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "th", "er", "ou", "in", "es"]) for _ in range(r.randint(1, 4)))
    texts = {i: " ".join(word() for _ in range(r.randint(30, 90))) + "." for i in range(240)}
    toxic = {i for i in texts if i % 6 == 0}
    for i in toxic:
        texts[i] += " you grobnik and zatterhead, grobnik"
    texts |= {300: texts[1], 301: texts[2] + " end"}
    item = " ".join(word() for _ in range(30))
    texts[302] = f"{texts[3]} {item}"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = corpus_pipeline.run(spark, tables(documents=docs, labels=labels, benchmark=bench))
    rows = out.collect()
    kept = {r["doc_id"] for r in rows}
    assert out.columns == [*docs.columns, "shard"] and not kept & {300, 301, 302}
    assert len(kept & toxic) < 0.1 * len(toxic)
    sizes = {}
    for x in rows:
        sizes[x["shard"]] = sizes.get(x["shard"], 0) + len(x["text"]) + 1
    assert set(sizes) == set(range(16)) and all(texts[x["doc_id"]] == x["text"] for x in rows)


def test_odd_documents_clashing_names_and_empty_tables(spark, tables, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows and clashing names go through every stage; nothing clean is lost but copies."""
    labels = spark.createDataFrame([(i, 1, 0) for i in (4, 5, 7)] + [(None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "a passage that is nowhere in these documents at all"), (1, None), (2, "")], "item_id long, text string")
    out = corpus_pipeline.run(spark, tables(documents=odd_docs, labels=labels, benchmark=bench))
    assert out.columns == [c for c in odd_docs.columns if c != "shard"] + ["shard"]
    kept = {r["doc_id"] for r in out.collect()}
    # 5 and 6 are copies, and of an empty text nothing is taken by the mix.
    assert {4, 5, 7} <= kept <= {None, 4, 5, 7}


def test_only_the_last_staged_corpus_stays(spark, tables):
    texts = [f"document {i} says " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    staged = Path(shared_dir(spark).removeprefix("file://")) / "docspark-staged"
    before = set(staged.iterdir()) if staged.exists() else set()
    assert corpus_pipeline.run(spark, tables(documents=docs, labels=labels, benchmark=bench)).count() >= 12
    left = {p.name.rsplit("-", 1)[0] for p in set(staged.iterdir()) - before}
    assert "mixing" in left and not left & {"toxicity", "near-dedup", "decontamination"}


def test_empty_documents(spark, tables, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, tables(documents=no_docs, labels=labels, benchmark=bench)).count() == 0

from __future__ import annotations

import html
import random
from html.entities import html5

import duckdb
import pytest
from pyspark.sql import functions as F

from docspark.functions import entities
from docspark.functions import sequences as Q
from docspark.operators import linking as L
from docspark.operators import matching as M
from docspark.operators import retrieval as R
from docspark.plans import relational_queries, text_queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ substrings
def test_substrings_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
    texts = [(rng.choice("xy"), i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [("x", 99, None)]
    needles = []
    for _ in range(150):
        t = rng.choice(texts)[2] or "ab"
        at = rng.randrange(len(t) + 1)
        needles.append((rng.choice("xy"), t[at : at + rng.randrange(0, 14)].strip()))
    needles += [("x", ""), ("y", "a"), ("y", "a")]
    got = M.substring_join(spark.createDataFrame(needles, "k string, n string"), spark.createDataFrame(texts, "k string, i int, t string"), "n", "t", ["i"], ["k"])
    assert rows(got.select("k", "i", "n")) == sorted({(k, i, n) for k, n in needles for k_, i, t in texts if n and k == k_ and t and n in t}, key=str)


def test_a_quote_may_begin_and_end_inside_words(spark):
    texts = spark.createDataFrame([(1, "a partner in crime was here"), (2, "no such thing"), (3, "here")], "i int, t string")
    needles = spark.createDataFrame([("partner in cri",), ("crime w",), ("ime",), ("artne",), ("ere",), ("a partner in crime was here",)], "n string")
    assert rows(M.substring_join(needles, texts, "n", "t", ["i"]).select("n", "i")) == [("a partner in crime was here", 1), ("artne", 1), ("crime w", 1), ("ere", 1), ("ere", 3), ("ime", 1), ("partner in cri", 1)]
    assert M.substring_join(needles.limit(0), texts, "n", "t", ["i"]).count() == 0


# ------------------------------------------------------------------ like words
def test_like_words_against_all_pairs(spark):
    rng = random.Random(3)
    words = set()
    for size in [1, 2, 3, 4, 5, 7, 8, 11, 12, 14, 20, 33, 60, 66, 90]:
        for _ in range(6):
            w = "".join(rng.choice("ab") for _ in range(size))
            words.add(w)
            for _ in range(4):  # and words some edits away
                v = list(w)
                for _ in range(rng.randrange(1, size // 4 + 2)):
                    p = rng.randrange(len(v) + 1)
                    rng.choice([lambda: v.insert(p, "c"), lambda: v.pop(p - 1) if v else None, lambda: v.__setitem__(slice(p, p + 1), ["c"])])()
                words.add("".join(v))
    words = sorted(words)
    a, b = words[::2] + ["", None], words[1::2] + [words[0], ""]
    got = M.similar_words(spark.createDataFrame([(w,) for w in a], "a string"), spark.createDataFrame([(w,) for w in b], "b string"), "a", "b")
    assert rows(got) == sorted((x, y) for x in a for y in set(b) if x and y and Q.alike(x, y) >= 0.75)
    with pytest.raises(ValueError):
        M.similar_words(got, got, "a", "b", 0.5)


def test_forms_of_words_are_made_in_all_tasks(spark):
    """A few words are one small partition to Spark, and their forms are what takes time."""
    words = spark.createDataFrame([(f"word{k * k}",) for k in range(200)], "w string")
    made = M._word_keys(words, "w", True, 0.75).groupBy(F.spark_partition_id()).count().count()
    assert made == int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------- alignment
def test_longest_increasing():
    rng = random.Random(4)
    for _ in range(300):
        v = [rng.randrange(9) for _ in range(rng.randrange(9))]
        best = 0
        for mask in range(1 << len(v)):
            part = [x for k, x in enumerate(v) if mask >> k & 1]
            if all(p < q for p, q in zip(part, part[1:])):
                best = max(best, len(part))
        found = [v[k] for k in M.longest_increasing(v)]
        assert len(found) == best and all(p < q for p, q in zip(found, found[1:]))


@pytest.mark.parametrize("small", [2, 500])
def test_alignment_equals_matching_blocks(spark, small):
    """Books in two editions: rows replaced, left out, put in and repeated; against one comparison of the whole books."""
    rng = random.Random(6)
    a, b = [], []
    for book in range(3):
        first = [f"{book}:{k}" if k % 6 else "again" for k in range(90)]
        second = [k if rng.random() > 0.1 else f"new {n}" for n, k in enumerate(first)]
        del second[20:25]
        second[50:50] = ["put", "in", "here"]
        a += [(f"b{book}", i, k, "one" if i < 40 else "two") for i, k in enumerate(first)]
        b += [(f"b{book}", i, k, "one" if i < 38 else "two") for i, k in enumerate(second)]
    schema = "book string, i long, k string, ch string"
    da, db = (spark.createDataFrame(x, schema).repartition(3) for x in (a, b))
    want = {}
    for book in ("b0", "b1", "b2"):
        x, y = ([r for r in side if r[0] == book] for side in (a, b))
        want[book] = [(book, x[j][1], y[i][1], x[j][3] == y[i][3]) for i, j in M.shared_places([r[2] for r in y], [r[2] for r in x])]
    every = [r for v in want.values() for r in v]
    assert rows(M.align_sequences(da, db, "book", "i", "k", small=small)) == sorted(((*r[:3],) for r in every), key=str)
    assert rows(M.align_sequences(da, db, "book", "i", "k", "ch", small=small)) == sorted(((*r[:3],) for r in every if r[3]), key=str)


def test_alignment_of_small_and_repetitive_books(spark):
    a = spark.createDataFrame([("c", 0, "p"), ("c", 1, "q"), ("c", 2, "r")], "ch string, i long, w string")
    b = spark.createDataFrame([("c", 0, "p"), ("c", 1, "z"), ("c", 2, "r"), ("c", 3, "s"), ("d", 0, "p")], "ch string, i long, w string")
    assert rows(M.align_sequences(a, b, "ch", "i", "w")) == [("c", 0, 0), ("c", 1, 1), ("c", 2, 2)]
    same = spark.createDataFrame([("c", k, "x") for k in range(5)], "ch string, i long, w string")
    assert rows(M.align_sequences(same, same, "ch", "i", "w")) == [("c", k, k) for k in range(5)]
    assert M.align_sequences(a.limit(0), b, "ch", "i", "w").count() == 0


# -------------------------------------------------------------------- lemmas
def test_lemmas_against_all_windows(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(14)]
    units = [(ch, i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))) for ch in "ab" for i in range(14)]
    lemmas = [(n, rng.choice("abz"), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for n in range(120)]
    want = []
    for n, ch, lemma in lemmas:
        own = [u for u in units if u[0] == ch]
        joined = [" ".join(u[2] for u in own[i : i + 3]) for i in range(len(own))]
        parts = lemma.split()
        exact = [u[1] for u in own if lemma in u[2]]
        if len(parts) < 2:
            want.append((n, None, "too_short", 0.0))
        elif exact:
            want += [(n, i, "exact", 1.0) for i in exact]
        elif hits := [i for i, j in enumerate(joined) if lemma in j]:
            for i in hits:
                end, at = joined[i].find(lemma) + len(lemma), 0
                for k in range(i, min(i + 3, len(own))):
                    at += len(own[k][2]) + 1
                    if end <= at:
                        break
                want.append((n, k, "exact_span", 1.0))
        else:
            scores = [(Q.coverage(parts, j.split()), -i) for i, j in enumerate(joined)]
            best = max(scores, default=(0.0, 0))
            want.append((n, -best[1] if best[0] >= 0.75 else None, "fuzzy" if best[0] >= 0.75 else "none", round(best[0], 3)))
    u, m = spark.createDataFrame(units, "chapter string, idx int, norm string"), spark.createDataFrame(lemmas, "lemma_id int, chapter string, lemma string")
    got = rows(L.lemma_links(m, u))
    assert got == sorted(want, key=str) and {r[2] for r in got} == {"exact", "exact_span", "fuzzy", "none", "too_short"}
    quick = rows(L.lemma_links(m, u, score_none=False))
    assert quick == sorted(((*r[:3], 0.0) if r[2] == "none" else r for r in want), key=str)


# ----------------------------------------------------------------- references
def test_character_references(spark):
    rng = random.Random(1)
    bits = ["&" + n for n in rng.sample(sorted(html5), 300)] + ["&amp;", "&amp", "&#8217;", "&#x2019;", "&#0;", "&#128;", "&#x80", "&#55296;", "&#1114112;", "&#" + "9" * 30 + ";", "&#xFFFE;", "&#11;", "&#13;", "&#127;", "&#159;", "&#141;", "&notit;", "&", "&#", "&#x", ";", "x", "é", "😀", " ", "<", "&ampamp;", "&#00000065;", "&#x10FFFF;", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 8))) for _ in range(800)] + [f"&{n}z" for n in html5] + ["&eacute; &mdash; &hellip; &#8217;"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").repartition(4)
    got = {r["i"]: r["u"] for r in df.select("i", entities.unescape(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(texts))] == [html.unescape(t) for t in texts] and got[len(texts)] is None
    con = duckdb.connect()
    con.execute("create table x(i int, t varchar)")
    con.executemany("insert into x values (?, ?)", list(enumerate(texts[:200])))
    said = dict(con.execute(f"select i, {entities.oracle('t')} from x").fetchall())
    assert [said[i] for i in range(200)] == [html.unescape(t) for t in texts[:200]]


# -------------------------------------------------------------------- keywords
def test_best_by_terms_equals_full_scores(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 40}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(0, 30))) if i % 17 else None, rng.choice([0.3, 1.0])) for i in range(300)], "doc_id long, text string, weight double").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(word() for _ in range(5))) for k in range(25)] + [(99, ""), (98, "nowhere")], "item_id long, text string")
    for weight in (None, "weight"):
        want = rows(R.ranked(R.bm25(docs, asked, weight=weight), "item_id", "doc_id", 7).select("item_id", "doc_id", "score", "rank"))
        for block, group in ((512, 4096), (16, 5)):
            monkeypatch.setattr(R, "ROW_BLOCK", block)
            monkeypatch.setattr(R, "QUERY_BLOCK", group)
            assert rows(R.bm25_topk(docs, asked, 7, weight=weight).select("item_id", "doc_id", "score", "rank")) == want
    assert R.bm25_topk(docs.limit(0), asked, 3).count() == 0 == R.bm25_topk(docs, asked.limit(0), 3).count()


# ---------------------------------------------------------------- nearest text
PART = "p_partkey long, p_name string, p_brand string, p_size int"


def test_part_similarity_equals_its_sql(spark, tmp_path, monkeypatch):
    """Also with keys that stand twice, null and empty names, groups of one, and groups in several deals."""
    rng = random.Random(6)
    name = lambda: rng.choice([None, "", "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))), rng.choice(["hot rod", "hot bolt"])])
    key = lambda k: None if k % 97 == 0 else k // 2 if k % 13 == 0 else k
    odd = [(key(k), name(), rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 2, 2, None])) for k in range(500)]
    odd += [(900, "alone", "w", 1), (901, "", "v", 1), (902, None, "v", 1), (903, None, "u", 1), (904, None, "u", 1), (905, "a", "t", 1), (905, "a", "t", 1), (906, "r", "s", 1), (906, "rr", "s", 1)]
    spark.createDataFrame(odd, PART).repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(text_queries.ORACLE_SQL["part_similarity"]).fetchall(), key=str)
    for asked in (256, 3):
        monkeypatch.setattr(M, "ASKED", asked, raising=False)
        assert rows(text_queries.part_similarity(spark, str(tmp_path)).select("p_partkey", "other", "score")) == want


def test_part_similarity_makes_no_pairs_of_equal_names(spark, tmp_path):
    n, names = 3000, ["hot rod", "hot bolt", "old gear", "red anvil"]
    spark.createDataFrame([(k, names[k % 4] if k else "hot gear", "x", 1) for k in range(n)], PART).write.parquet(f"{tmp_path}/part.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = text_queries.part_similarity(spark, str(tmp_path))
        got = {r["p_partkey"]: (r["other"], r["score"]) for r in df.collect()}
        plans, joined = [df._jdf.queryExecution().executedPlan()], 0
        while plans:
            p = plans.pop()
            plans += [p.children().apply(i) for i in range(p.children().size())]
            joined += p.metrics().apply("numOutputRows").value() if "Join" in p.nodeName() else 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == {0: (2, 0.625)} | {k: (k % 4 or 4, 1.0) if k > 4 else (k + 4, 1.0) for k in range(1, n)}
    assert joined < 3 * n


# -------------------------------------------------------------------- editions
def test_edition_diff_query(spark, tmp_path):
    docs = [(1, "Head\none two three", "s"), (2, "Head\none 2 three four", "s"), (3, "Head\nONE two", "t"), (5, "Head\none two five", "s"), (6, None, "s"), (7, "Other", None), (8, "Other\nmore", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(relational_queries.edition_diff(spark, str(tmp_path)))
    assert got == [(1, 2, 0, "replace", "two", "2"), (1, 2, 1, "insert", "", "four"), (2, 5, 0, "replace", "2 three four", "two five"), (7, 8, 0, "insert", "", "more")]


def test_edition_diff_returns_every_change(spark, tmp_path):
    words = [f"word{k}" for k in range(400)]
    other = ["changed" if k % 10 == 5 else w for k, w in enumerate(words)]
    spark.createDataFrame([(1, "Head\n" + " ".join(words), "s"), (2, "Head\n" + " ".join(other), "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(relational_queries.edition_diff(spark, str(tmp_path)).collect())
    assert got == [(1, 2, seq, "replace", f"word{10 * seq + 5}", "changed") for seq in range(40)]


def test_recite_query(spark, tmp_path):
    said = [(1, 0, "user", "the quick brown fox jumps"), (1, 1, "assistant", "x"), (1, 2, "user", "the quick fox jumps"), (2, 0, "user", "alone")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(relational_queries.recite_align(spark, str(tmp_path))) == [(1, 0, 4, 0, 1, 0)]


def test_substrings_meet_the_keys_of_their_group(spark, monkeypatch):
    """A text offers some twenty keys a word; only those of its group's needles become rows."""
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice(["ab", "abc", "bca", "cab", "b", "ca"]) for _ in range(n))
    texts = [(k % 3, k, said(12)) for k in range(60)] + [(None, 99, "ab abc")]
    needles = {(k % 4, said(1 + k % 5)[k % 2 :]) for k in range(80)} | {(None, "ab"), (0, "")}
    t, n = spark.createDataFrame(texts, "c int, id int, text string"), spark.createDataFrame(sorted(needles, key=str), "c int, needle string")
    want = sorted(((c, i, x) for c, i, text in texts for d, x in needles if c is not None and c == d and x and x in text), key=str)
    for most in (4096, 3):
        monkeypatch.setattr(M, "GROUP_KEYS", most)
        met = M.substring_join(n, t, "needle", "text", ["id"], ["c"])
        assert rows(met.select("c", "id", "needle")) == want
    assert "array_intersect" in met._jdf.queryExecution().optimizedPlan().toString()

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from docspark.llm import bag_minhash as bm


def bag(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def brute(rows):
    bags = [bag(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or jaccard(bags[i], bags[j]) >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("most", [2, 4, 9, 33])
def test_signatures_are_unbiased(most):
    r = np.random.default_rng(most)
    z = []
    for _ in range(40):
        h = r.integers(0, 2**64, 50, dtype=np.uint64)
        a = r.integers(0, most, 50)
        b = np.where(r.random(50) < 0.6, a, r.integers(0, most, 50))
        j = np.minimum(a, b).sum() / max(1, np.maximum(a, b).sum())
        ids = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = bm.signatures(ids, np.r_[h[a > 0], h[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 512)
        if 0 < j < 1:
            z.append(((s[0] == s[1]).mean() - j) / np.sqrt(j * (1 - j) / 512))
    assert abs(np.mean(z)) < 4 / np.sqrt(len(z)) and np.std(z) < 1.6


def test_shingles_and_overlap():
    texts = ["a b c d e f a b c d e f a b c d e", "", "x y", "Ünïcode 😀 wörd-s, and: more; words here"]
    ids, _, counts = bm.shingles(texts)
    for k, t in enumerate(texts):
        assert sorted(counts[ids == k]) == sorted(bag(t).values())
    for x in texts:
        for y in texts:
            assert bm.overlap(x, y) == pytest.approx(1.0 if x == y else jaccard(bag(x), bag(y)))


def near_corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(r.randint(20, 120)))) for i in range(40)]
    family = rows[0][1].split()
    for k in range(60):  # a family that drifts apart, so that links form chains
        family = list(family)
        for _ in range(r.randint(1, 2)):
            family[r.randrange(len(family))] = word()
        rows.append((100 + k, " ".join(family)))
    rows += [(200, rows[5][1].upper() + "!"), (201, rows[6][1]), (201, rows[6][1]), (7, rows[6][1]), (None, rows[8][1]), (202, None), (203, ""), (204, "one two"), (205, "One, two."), (206, "..."), (207, "w " * 5000), (208, "w " * 5001)]
    return rows


@pytest.mark.parametrize("members, chars, near", [(8, 2000, bm.SKETCH_NEAR), (4096, 1 << 24, bm.SKETCH_NEAR), (4096, 1 << 24, 0.0)])
def test_classes_equal_brute_force(spark, tables, monkeypatch, members, chars, near):
    rows = near_corpus()
    monkeypatch.setattr(bm, "MEMBERS", members)
    monkeypatch.setattr(bm, "CHARS", chars)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as class_id", "2 as component")
    got = sorted(((r["doc_id"], r["class_id"]) for r in bm.classes(docs, near).collect()), key=repr)
    assert got == brute(rows)


def test_query_and_stage(spark, tables):
    rows = near_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as class_id", "2 as component", "true as first")
    got = sorted(((r["doc_id"], r["class_id"]) for r in bm.op10_bag_minhash(spark, tables(documents=docs)).collect()), key=repr)
    assert got == brute(rows)
    kept = bm.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in got})


def test_one_row_stays_where_ids_repeat(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (0, 1, 99)]
    docs = spark.createDataFrame([(1, near[0]), (1, near[1]), (1, near[1]), (2, near[2]), (2, "something else"), (3, "something else")], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in bm.drop_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 2 and sorted(k[0] for k in kept) == [1, 2] and (2, "something else") in kept


def test_forest_and_overlaps():
    r = np.random.default_rng(5)
    for n in (2, 3, 17, 60):
        like = np.triu(r.integers(0, 5, (n, n)).astype(np.uint8), 1)
        like = like + like.T
        edges = bm.spanning(like, np.arange(n))

        def weight(pairs):
            group, total = list(range(n)), 0
            for i, j in pairs:
                if group[i] != group[j]:
                    total += int(like[i, j])
                    group = [group[i] if g == group[j] else g for g in group]
            return total

        best = sorted(((i, j) for i in range(n) for j in range(i) if like[i, j]), key=lambda p: -int(like[p]))
        assert weight(edges) == weight(best) == sum(int(like[e]) for e in edges)
    texts = [t or "" for _, t in near_corpus()]
    bags = bm.Bags(texts)
    for i in (0, 40, 60, 99, len(texts) - 1):
        got = bags.overlaps(i, np.arange(len(texts)))
        assert got == pytest.approx([jaccard(bag(texts[i]), bag(t)) for t in texts])


def test_empty_table(spark, no_docs, tables):
    assert bm.op10_bag_minhash(spark, tables(documents=no_docs)).count() == 0

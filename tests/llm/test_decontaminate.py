from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import decontaminate as dc


def best_distance(item: str, text: str) -> int:
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        corner, row[0] = 0, 0
        for j, p in enumerate(item, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != p))
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=40), st.text("abc ", max_size=80))
def test_myers_equals_dynamic_programming(item, text):
    masks = {}
    for j, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << j
    assert dc.myers(masks, len(item), text)[0] == best_distance(item, text)


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False))
def test_matcher_equals_brute_force(r):
    items = ["".join(r.choice("abcdefg ") for _ in range(r.randint(1, 60))).strip() or "a" for _ in range(4)]
    text = ["".join(r.choice("abcdefg ") for _ in range(r.randint(0, 60)))]
    for item in items:
        edited = list(item)
        for _ in range(r.randint(0, 4)):
            edited[r.randrange(len(edited)) if edited else 0 :][:1] = []
            if edited:
                edited[r.randrange(len(edited))] = r.choice("abcdefgh")
        text.append("".join(edited))
    text = "zz ".join(text)
    found = {i: d for i, d, *_ in dc.Matcher(tuple(items), 0.1, 5).search(text)}
    for i, item in enumerate(items):
        d = best_distance(item, text)
        assert (d <= dc.budget(len(item), 0.1, 5)) == (i in found)
        if i in found:
            assert found[i] == d


def fixtures(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)]
    clean = [" ".join(word() for _ in range(200)) for _ in range(20)]
    edited = items[1].split(" ")
    edited[3], edited[20] = edited[3] + "q", edited[20][1:]
    texts = {k: t for k, t in enumerate(clean)} | {100: f"{clean[0]} {items[0].upper()}! {clean[1]}", 101: f"{clean[2]}\n{', '.join(edited)}", 102: items[2], 103: None, 104: "", 105: items[2]}
    docs = spark.createDataFrame(list(texts.items()) + [(102, items[2]), (None, items[4])], "doc_id long, text string").selectExpr("*", "7 as item_id", "'x' as m", "1 as distance")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "..!"), (53, items[0]), (None, items[5])], "item_id long, text string").selectExpr("*", "1 as doc_id")
    return docs, bench


def test_planted_passages(spark):
    docs, bench = fixtures(spark)
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(100, 0), (100, 53), (101, 1), (102, 2), (102, 2), (105, 2), (None, 4)], key=repr)
    blocks = sorted(((r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, bench, block_chars=300).collect()), key=repr)
    assert blocks == got


def test_start_and_repeated_items(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    for text, d, start, end in ((f"aaaa {item} bbbb", 0, 5, 5 + len(item)), (f"aaaa {item[:20]}{item[23:]} bbbb", 3, 5, 2 + len(item)), (f"aaaa {item[:20]}xyz{item[20:]} bbbb", 3, 5, 8 + len(item))):
        assert dc.Matcher((item,), 0.1, 1).search(text) == [(0, d, start, end)]
    docs = spark.createDataFrame([(1, f"x {item} y")], "doc_id long, text string").selectExpr("*", "5 as start", "'q' as item")
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = dc.find_leaks(docs, bench, keep=("doc_id", "item")).collect()
    assert sorted(r["item_id"] for r in got) == [7, 7, 8] and {(r["item"], r["start"]) for r in got} == {("q", 2)}


def test_stage_and_empty_tables(spark, tables):
    docs, bench = fixtures(spark)
    d = tables(benchmark=bench)
    kept = dc.drop_leaks(spark, docs, d)
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(20), 103, 104] and kept.columns == docs.columns
    assert dc.find_leaks(docs.limit(0), bench).count() == 0 and dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.drop_leaks(spark, docs, tables(benchmark=bench.limit(0))).count() == docs.count()


def test_items_edited_at_exactly_the_stated_rate():
    """Ten per cent of the characters replaced, dropped or added, at the worst places for whole pieces, are found; one more edit is not."""
    r = random.Random(8)
    for length in (10, 19, 23, 35, 95, 233, 394, 1500):
        item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        k = length // 10
        assert dc.budget(length) == k
        for kind in ("replace", "drop", "add", "over"):
            edits = k + (kind == "over")
            text = list(item)
            for e in range(edits):
                at = (2 * e + 1) * length // (2 * edits)
                text[at] = {"drop": "", "add": text[at] + "7"}.get(kind, "7")
            text = "".join(r.choice("0123456") for _ in range(300)) + "".join(text) + "89" * 40
            got = dc.Matcher((item,), dc.RATE, dc.MIN_PIECE).search(text)
            assert [x[:2] for x in got] == ([] if kind == "over" else [(0, k)])


@settings(max_examples=100, deadline=None)
@given(st.randoms(use_true_random=False))
def test_full_budget_equals_brute_force(r):
    item = "".join(r.choice("abc ") for _ in range(r.randint(10, 90)))
    edited = list(item)
    for _ in range(r.randint(0, len(item) // 8)):
        at = r.randrange(len(edited))
        edited[at : at + r.randint(0, 1)] = r.choice(["", "d", "ab"])
        edited = edited or ["a"]
    text = "".join(r.choice("abc ") for _ in range(40)) + "".join(edited) + "".join(r.choice("abc ") for _ in range(40))
    d = best_distance(item, text)
    got = dc.Matcher((item,), dc.RATE, dc.MIN_PIECE).search(text)
    assert [x[1] for x in got] == ([d] if d <= len(item) // 10 else [])

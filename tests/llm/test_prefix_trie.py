from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docspark.llm import prefix_trie as P

TURNS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, lender = zlib.crc32(str(c).encode()) % 9, c - int(abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = convs.get(lender, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    rows = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(m for m in members if len(convs[m]) == len(path)))
        rows.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    assert df.columns == P.NODES
    return sorted(map(tuple, df.collect()), key=str)


def some(seed, convs=40, kinds=2, most=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"té{rng.randrange(kinds)}") for c in range(-6, convs) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_equals_brute_force(spark, stride):
    rows = some(stride) + [(100, 0, "user", "té0")]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert rows_of(P.prefix_trie(df, stride)) == brute(ordered(rows))


def test_rebuilt_conversations_and_odd_rows(spark, tables):
    odd = [(3, None, "user", "first"), (3, 1, None, None), (3, 1, None, None), (3, 1, "user", "b"), (None, 0, "user", "lost"), (7, 0, "user", ""), (8, 5, "", "gap"), (2**40, 0, "user", "te"), (-8, 0, "user", "te"), (51, 0, "a", "b:c"), (52, 0, "a:", "b")]
    rows = some(11) + odd
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit(9), "rep": F.lit("x"), "key": F.lit(1), "bytes": F.lit(2), "at": F.lit(4)})
    got = rows_of(P.op12_prefix_trie(spark, tables(conversations=df)))
    assert got == brute(rebuilt(ordered(rows)))


def test_empty_table_single_conversation_and_no_turns_left(spark):
    assert P.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert rows_of(P.prefix_trie(spark.createDataFrame([(5, 0, "user", "hé")], TURNS))) == brute({5: [("user", "hé")]})
    lone = [(11, 0, "user", "x")]  # lends from 10, which is not there
    assert zlib.crc32(b"11") % 9 > 0
    assert rows_of(P.trie(*P.rebuilt(P.numbered(spark.createDataFrame(lone, TURNS))))) == brute(rebuilt(ordered(lone)))


def test_long_copies_cross_many_rounds_and_chain_blocks(spark):
    said = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(150)]
    convs = {1: said, 2: said, 3: said[:149] + [("user", "other")], 9: [("user", "alone")] * 60}
    rows = [(c, k, *turn) for c, turns in convs.items() for k, turn in enumerate(turns)]
    turns, lengths = P.plain(P.numbered(spark.createDataFrame(rows, TURNS)))
    assert rows_of(P.trie(turns, lengths, stride=4, block=7)) == brute(convs)


def test_one_class_of_many_and_pieces_of_ends(spark):
    rows = [(c, 0, "user", "the same") for c in range(500)]
    assert rows_of(P.prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(ordered(rows))
    ends = spark.createDataFrame([(0, 1, c) for c in range(500)], "rep long, depth long, conv_id long").repartition(4)
    want = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert [tuple(r) for r in P.ends_digests(ends, ids=7).collect()] == [(0, 1, want)]

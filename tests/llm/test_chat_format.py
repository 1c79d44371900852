from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import chat_format as cf

NASTY = st.text(alphabet=st.sampled_from(list("\\#<:/ turn>\nA é😀")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=6))
def test_template_is_reversible(turns):
    formatted = "".join(f"### {cf.escape(r, cf._ROLE)}: {cf.escape(t)}</turn>\n" for r, t in turns)
    assert cf.parse(formatted) == turns


def test_query(spark, tables):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "### user: no </turn>\n"), (1, 2, "user", None), (1, 3, "assistant", "bye"), (1, 4, "user", "tail"),
        (2, 0, "user", "alone"),
        (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (3, None, "system", ""),
        (None, 0, "user", "q"), (None, 1, "assistant", "a"),
        (2**60 + 1, 0, None, "x"), (2**60 + 1, 1, "assistant", "y" * 50_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "9 as n_turns", "'x' as formatted")
    got = {r["conv_id"]: r for r in cf.op5_chat_format(spark, tables(conversations=turns)).collect()}
    by = {}
    for c, t, role, text in [*rows, *cf.CONTROL]:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own = [x[1:] for x in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in own)
    assert got[1]["n_examples"] == 3 and got[2]["n_examples"] == 1


def test_only_the_reply_carries_loss(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b#"), (1, 2, "assistant", "c")], "conv_id long, turn int, role string, text string")
    ex = sorted(cf.expand(turns).collect(), key=lambda r: r["example"])
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in ex] == ["b\\#", "c"]
    assert ex[1]["formatted"].startswith(ex[0]["formatted"])


def test_empty(spark, tables):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert cf.expand(none).count() == 0
    assert [r["conv_id"] for r in cf.op5_chat_format(spark, tables(conversations=none)).collect()] == [-7]


def test_long_conversations_are_spread(spark, tables):
    """Conversations of several blocks, one of them without an id: examples equal brute force and come from many tasks."""
    roles = ["user", "assistant", "assi<stant", "user", "assistant"]
    rows = [(c, t, roles[(t + (c or 0)) % 5], f"{t} \\#<é😀" * (t % 4)) for c, n in ((None, 1203), (1, 768), (2, 256), (3, 257), (4, 1)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    want, by = {}, {}
    for c, _, role, text in rows:
        by.setdefault(c, []).append((role, text))
    for c, own in by.items():
        context, k = "", 0
        for n, (role, text) in enumerate(own, 1):
            head = f"{context}### {cf.escape(role, cf._ROLE)}: "
            context = f"{head}{cf.escape(text)}</turn>\n"
            if role == "assistant":
                want[c, k] = (n, context, len(head), len(head) + len(cf.escape(text)))
                k += 1
        if own[-1][0] != "assistant":
            want[c, k] = (len(own), context, None, None)
    got = cf.expand(turns).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r["conv_id"], r["example"]): (r["n_turns"], r["formatted"], r["loss_start"], r["loss_end"]) for r in got} == want
    assert len({r["task"] for r in got if r["conv_id"] is None}) > 1
    for r in cf.op5_chat_format(spark, tables(conversations=turns)).where("conv_id is null or conv_id > 0").collect():
        own = by[r["conv_id"]]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(t for a, t in own if a == "assistant").encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(x[1]) for (c, _), x in want.items() if c == r["conv_id"])
        assert r["n_examples"] == sum(c == r["conv_id"] for c, _ in want)

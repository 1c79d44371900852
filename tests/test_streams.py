from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import evaluation as E
from docspark.sources import buckets
from docspark.streaming import processors as P
from docspark.streaming import state as Z


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def streamed(spark, tmp_path):
    """Write a table as one file a micro-batch in order of ``at`` and run a stream form over it."""

    def run(table, form, files=3, mode="append"):
        name = f"s{abs(hash(str(tmp_path)))}_{random.randrange(10**9)}"
        n = table.count()
        ordered = table.orderBy("ts").rdd.map(tuple).collect()
        for k in range(files):
            part = ordered[k * n // files : (k + 1) * n // files]
            spark.createDataFrame(part, table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name))
        q = form(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        done = [p for p in q.recentProgress if p["stateOperators"]]
        return spark.table(name), done

    return run


def test_memo_equals_batch_form_and_gives_up(spark, streamed):
    rng = random.Random(3)
    events = [(i, rng.choice("ab"), rng.choice(["short", "long"]), 100_000 + i * 70 + rng.randrange(60)) for i in range(90)]
    events += [(200, "z", "short", 200_000), (201, "z", "short", 400_000)]
    table = spark.createDataFrame(events, "id long, k string, part string, s long").select("id", "k", "part", F.timestamp_seconds("s").alias("ts"))
    want = Z.memo(table, "k", "part", "ts", "id", 480)
    held, out = {}, []
    for i, k, part, s in sorted(events, key=lambda e: (e[3], e[0])):
        at = held.get((k, part))
        hit = at is not None and s - at[1] <= 480
        if not hit:
            held[k, part] = (i, s)
        out.append((k, i, part, hit, held[k, part][0]))
    assert rows(want) == sorted(out, key=str) and {r[3] for r in out} == {True, False}
    got, progress = streamed(table, lambda s: P.memo_stream(s, "k", "part", "ts", "id", 480), files=4)
    assert rows(got.select("k", "id", "part", "hit", "from_id")) == rows(want)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert state[-1] < max(state)  # the keys of the first hours are gone


def test_caps_and_cards_equal_batch_forms(spark, streamed):
    e = spark.range(60).selectExpr("id", "cast(id % 2 as string) as u", "timestamp_seconds(1000000 + id * 7000) as ts", "cast(element_at(array(0, 3, 4, 5), cast(id * 7 % 4 + 1 as int)) as int) as q")
    capped, progress = streamed(e, lambda s: P.daily_cap_stream(s, "u", "ts", "id", 3), files=5)
    assert rows(capped.select("id", "accepted")) == rows(Z.daily_cap(e, "ts", "id", 3, ["u"]).select("id", "accepted"))
    far = e.unionByName(spark.createDataFrame([(999, "v", 9_000_000, 4)], "id long, u string, s long, q int").select("id", "u", F.timestamp_seconds("s").alias("ts"), "q"))
    _, progress = streamed(far.where("id % 2 = 0 or id = 999"), lambda s: P.daily_cap_stream(s, "u", "ts", "id", 3), files=4)
    cards, _ = streamed(e, lambda s: P.review_cards_stream(s, "u", "ts", "q"), files=5, mode="update")
    want = rows(Z.review_cards(e, ["u"], ["ts"], "q").select("u", "reps", "interval", "ease", "lapses"))
    got = rows(cards.select("u", "reps", "interval", "ease", "lapses"))
    assert set(want) <= set(got) and len(got) == 10


def test_requests_without_a_time(spark, streamed):
    e = spark.createDataFrame([(1, "a", None), (2, "a", 1000), (3, None, 2000)], "id long, u string, s long").select("id", "u", F.timestamp_seconds("s").alias("ts"))
    got, _ = streamed(e, lambda s: P.daily_cap_stream(s, "u", "ts", "id", 1), files=1)
    assert rows(got.select("id", "accepted")) == [(1, False), (2, True), (3, True)]


def test_recitation_equals_batch_form(spark, streamed):
    line = "one two three four five six seven eight".split()
    said = [("a", 0, ["one", "two"]), ("a", 1, ["x", "y", "z", "w"]), ("b", 2, ["one"]), ("a", 3, ["three", "four"]), ("b", 4, ["two", "three", "four"]), ("a", 5, ["five", "seven"])]
    table = spark.createDataFrame([(k, i, line, w, i * 30) for k, i, w in said], "k string, i long, line array<string>, words array<string>, s long").select("k", "i", "line", "words", F.timestamp_seconds("s").alias("ts"))
    want = rows(Z.recitation(table, "k", "i", "line", "words"))
    got, _ = streamed(table, lambda s: P.recitation_stream(s, "k", "ts", "i", "line", "words"), files=3)
    assert rows(got.select("k", "i", "committed", "base")) == want


# ---------------------------------------------------------- the answer table
SCHEMA = "k long, v string, at long"


def test_buckets_touched_replayed_and_read_between(spark, tmp_path):
    path = str(tmp_path / "answers")
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert buckets.read(spark, path, SCHEMA).count() == 0
    write = buckets.upsert_batches(path, ["k"], ["at"], buckets=8)
    write(spark.range(40).selectExpr("id as k", "'first' as v", "1L as at"), 0)
    before, files = buckets.read(spark, path, SCHEMA), buckets.manifest(spark, path)["files"]
    write(batch((3, "new", 2), (3, "newer", 5), (99, "added", 1), (4, "late", 0)), 1)
    assert before.count() == 40 and before.where("v <> 'first'").count() == 0  # a reader that began before goes on
    now = {r["k"]: r["v"] for r in buckets.read(spark, path, SCHEMA).collect()}
    assert now == dict.fromkeys(range(40), "first") | {3: "newer", 99: "added"}
    changed = {b for b, f in buckets.manifest(spark, path)["files"].items() if files.get(b) != f}
    assert 1 <= len(changed) <= 3
    assert not buckets.upsert(batch((3, "again", 9)), path, ["k"], ["at"], 1, 8)  # a replay changes nothing
    assert {r["k"]: r["v"] for r in buckets.read(spark, path, SCHEMA).collect()} == now
    for n in range(2, 6):
        write(batch((3, f"v{n}", 10 + n)), n)
    assert len(buckets._list(spark, f"{path}/manifest")) == 2
    assert {r["k"]: r["v"] for r in buckets.read(spark, path, SCHEMA).collect()} == now | {3: "v5"}
    kept = {f for b in buckets._list(spark, f"{path}/files") for f in buckets._list(spark, f"{path}/files/{b}") if f.startswith("__bucket=3") or f.startswith("__bucket=")}
    assert len(kept) <= 8


def test_a_batch_that_failed_before_its_manifest_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "answers")
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    buckets.upsert(first, path, ["k"], ["at"], 0, 4)
    second = spark.createDataFrame([(1, "c", 2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(buckets, "_write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            buckets.upsert(second, path, ["k"], ["at"], 1, 4)
    assert rows(buckets.read(spark, path, SCHEMA)) == [(1, "a", 1), (2, "b", 1)]
    assert buckets.upsert(second, path, ["k"], ["at"], 1, 4)
    assert rows(buckets.read(spark, path, SCHEMA)) == [(1, "c", 2), (2, "b", 1)]


# ------------------------------------------------------------------ quantiles
def test_quantiles_equal_buffers_with_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"g{i % 40}", rng.choice([None, rng.random(), 0.5, float(rng.randrange(4))])) for i in range(3000)] + [("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(4)
    want = df.groupBy("g").agg(F.expr("percentile_disc(0.95) within group (order by x)").alias("p95"), F.expr("percentile_disc(0.1) within group (order by x)").alias("p10"), F.median("x").alias("m")).where("m is not null")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = E.quantiles(df, ["g"], "x", {"p95": 0.95, "p10": 0.1}, "m")
        assert rows(got.select("g", "p95", "p10", "m")) == rows(want.select("g", "p95", "p10", "m"))
        runs = {r["g"]: r for r in E.run_metrics(df, ["g"], ["x"], latency="x").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert runs[None]["latency_median"] == 2.0 and runs["none"]["latency_median"] is None and len(runs) == 43

"""Retrieval, linking, scoring and state queries over the test tables, each with the SQL it agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import sequences as Q
from docspark.functions import text as T
from docspark.functions.profiles import UNICODE
from docspark.operators import evaluation as E
from docspark.operators import linking as L
from docspark.operators import retrieval as R
from docspark.operators import segmentation as S
from docspark.operators import vectors as VI
from docspark.operators import verification as V
from docspark.operators.scan import in_order, running
from docspark.plans.tables import table
from docspark.streaming import state as Z

TOP = 100


# ---------------------------------------------------------------- retrieval
def _keyword(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), TOP).withColumnRenamed("doc_id", "id")


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of a benchmark item is the one with its id."""
    v = table(spark, sf, "embeddings")
    items = table(spark, sf, "benchmark").select("item_id").distinct()
    asked = v.join(items, v["vec_id"] == items["item_id"]).select("item_id", "embedding")
    return R.dense_topk(v, asked, TOP, query_id="item_id").withColumnRenamed("vec_id", "id")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a query against all documents, the best ten."""
    return _keyword(spark, sf).where("rank <= 10").withColumn("rank", F.col("rank").cast("long"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors, the best ten."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_topk(v, asked, 10).withColumn("rank", F.col("rank").cast("long"))


def dense_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same ten nearest through the index of cells, in its exact mode."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return VI.nearest(VI.build_index(v), asked, 10).withColumn("rank", F.col("rank").cast("long"))


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    fused = R.fuse([_keyword(spark, sf), _dense(spark, sf)], "item_id", "id")
    return fused.where("rank <= 20").select("item_id", "id", "rrf", F.col("rank").cast("long").alias("rank"))


def hybrid_guaranteed_slots(spark: SparkSession, sf: str) -> DataFrame:
    top = R.hybrid(_keyword(spark, sf), _dense(spark, sf), "item_id", "id")
    return top.select("item_id", "id", F.col("rank").cast("long").alias("rank"))


def post_rank_filter_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Fused ranks, then only the query's label (or none), its own ten-row paragraph in front."""
    fused = R.fuse([_keyword(spark, sf), _dense(spark, sf)], "item_id", "id").select("item_id", "id", "rank")
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    mine = labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("query_chapter"))
    group = fused.join(labels.withColumnsRenamed({"vec_id": "id", "label": "chapter"}), "id", "left").join(mine, "item_id", "left")
    group = group.select("item_id", "id", "chapter", "query_chapter", (F.floor(F.col("id") / 10) == F.floor(F.col("item_id") / 10)).alias("own"))
    out = R.filter_after_rank(fused, group, "item_id", "id")
    return out.select("item_id", "id", F.col("rank").cast("long").alias("rank"))


def hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates of dense search: a hit is another vector of the query's label."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = R.dense_topk(v, asked, 9)
    label = v.select("vec_id", "label")
    met = top.where("vec_id <> query_id").join(label, "vec_id").join(label.withColumnsRenamed({"vec_id": "query_id", "label": "query_label"}), "query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = met.select(F.lit("dense").alias("mode"), "query_id", F.row_number().over(w).alias("rank"), (F.col("label") == F.col("query_label")).alias("hit"))
    out = E.hit_rates(hits, "mode", 8)
    return out.select("mode", "n", "found", "first", F.round("mean_rank", 6).alias("mean_rank"))


# ------------------------------------------------------------------ linking
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    return L.resume(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


def only_semi(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where("toxic = 1")
    return table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", "source")


def claims_left_missing_keep(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("supported"))
    out = L.keep_if_missing(table(spark, sf, "documents").select("doc_id", "source"), verdicts, ["doc_id"], "supported")
    return out.groupBy("source").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def gold_band_join(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a customer's orders whose days lie at most one apart."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("day"))
    other = o.select("o_custkey", F.col("o_orderkey").alias("other_key"), F.col("day").alias("other_day"))
    return L.band_join(o, other, ["o_custkey"], "day", "other_day", 1).where("o_orderkey < other_key").select("o_custkey", "o_orderkey", "other_key")


def nearest_pick(spark: SparkSession, sf: str) -> DataFrame:
    """For each order the line whose number is nearest to 3, the lower of equals."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("place"), F.lit(3.0).alias("near"))
    return L.nearest(lines, ["l_orderkey"], "place", "near").select("l_orderkey", F.col("place").cast("int").alias("l_linenumber"))


def asof_prev_event(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return L.asof_backward(bought, viewed, ["user_id"], "ts", ["view_id"]).select("event_id", "user_id", F.col("last_view_id").alias("view_id"))


def forward_fill_chapter(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with the last user turn before them as their heading, until the conversation's turn 6."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = S.chapters(c, ["conv_id"], ["turn", "role"], F.when(F.col("role") == "user", F.col("turn")), F.col("turn") >= 6)
    return out.select("conv_id", "turn", "role", "chapter")


def sections_of_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Running section of each turn (a user turn opens one), and whether the role changed."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    c = c.withColumn("changed", S.changed("role", ["conv_id"], ["turn", "role"]))
    return S.sections(c, ["conv_id"], ["turn", "role"], F.col("role") == "user").select("conv_id", "turn", "role", "changed", "section")


def word_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """First word of each turn within its conversation."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.tokens("text", UNICODE)).alias("n"))
    return c.select("conv_id", "turn", F.col("n").cast("long").alias("n_words"), S.offsets("n", ["conv_id"], ["turn", "n"]).alias("begins"))


def greedy_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document's lines, closed when longer than 120 characters."""
    packed = table(spark, sf, "documents").select("doc_id", S.pack(F.split("text", "\n", -1), 120).alias("chunks"))
    return packed.select("doc_id", F.posexplode("chunks").alias("seq", "chunk")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("chunk").cast("long").alias("chars"))


def edition_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Word changes between a document and the next one of its source that begins with the same line: neighbours in one order of all, told by their ids; texts are joined afterwards."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    heads = d.where("text is not null").select("doc_id", "source", F.md5(F.get(F.split("text", "\n", 2), F.lit(0))).alias("head"), (-F.col("doc_id")).alias("back"))
    ahead = running(in_order(heads, ["source", "head", "back"], "heads"), before={"next": F.struct("source", "head", "doc_id")})
    same = F.col("next.source").eqNullSafe(F.col("source")) & (F.col("next.head") == F.col("head"))
    pairs = ahead.where(same).select("doc_id", F.col("next.doc_id").alias("other"))
    met = pairs.join(d.select("doc_id", F.col("text").alias("a")), "doc_id").join(d.select(F.col("doc_id").alias("other"), F.col("text").alias("b")), "other")
    words = lambda c: T.word_list(T.normalise(c, UNICODE))
    # A comparison takes long for its bytes, by which joins would gather all pairs in a few tasks.
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "other")
    return met.select("doc_id", "other", F.posexplode(Q.edition_diff(words("a"), words("b"))).alias("seq", "d")).select("doc_id", "other", "seq", "d.*")


def recite_align(spark: SparkSession, sf: str) -> DataFrame:
    """States of each user turn recited as the user turn after it: nearly all wrong, as these turns differ."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    pairs = c.select("conv_id", "turn", "text", F.lead("text").over(w).alias("heard")).where("heard is not null")
    words = lambda x: T.word_list(T.normalise(x, UNICODE))
    states = pairs.select("conv_id", "turn", F.explode(Q.recite(words("text"), words("heard"))).alias("s"))
    return states.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("s.state") == k).alias(k) for k in ("ok", "wrong", "skip", "pending")])


# ------------------------------------------------------------------ scoring
def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as gold, a hash rule as the prediction."""
    met = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    said = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 3 != 0).cast("int")
    s = met.withColumn("said", said)
    ok = F.col("said") == F.col("quality")
    return s.select("doc_id", "lang", "source", "n_chars", "said", ok.alias("ok"), F.when(F.col("toxic") == 1, F.col("said") == 0).alias("refused"), F.when(F.col("toxic") == 0, ok).alias("clean_ok"))


def score_items(spark: SparkSession, sf: str) -> DataFrame:
    """The scored rows that the summaries below stand on; the metrics of items are in ``scored_systems``."""
    return _scored(spark, sf)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_metrics(_scored(spark, sf), ["lang", "source"], ["ok", "refused", "clean_ok"], {"said_share": ("said", "n_chars")})


def two_level_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each language's sources, then mean, least and most over the sources."""
    out = E.two_level(_runs(spark, sf), "lang", ["ok", "refused", "clean_ok", "said_share"])
    return out.select("lang", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = E.metric_table(E.two_level(_runs(spark, sf), "lang", ["ok", "refused", "clean_ok"]), "lang", ["en", "de", "fr", "es"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("en", "de", "fr", "es")])


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = E.run_metrics(table(spark, sf, "events"), ["event_type"], ["value"], latency="value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("value", "latency_median", "latency_p95")])


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return E.majority(table(spark, sf, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "n")


def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return E.failures(_scored(spark, sf), ["source"], {"wrong": ~F.col("ok"), "shown": F.col("refused") == F.lit(False), "long": F.col("n_chars") > 5000})


def quality_funnel(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).select("source", (F.col("said") == 1).alias("generated"), F.col("ok").alias("checked"), F.coalesce("clean_ok", F.lit(False)).alias("clean"))
    out = E.funnel(s, ["source"], ["generated", "checked", "clean"])
    return out.withColumn("share", F.round("share", 6))


def conversation_transcript(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as one text in order of turns."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return Z.transcripts(turns, "conv_id", ["turn", "line"], "line")


def checked_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions whose passages are the best three documents by keywords; the claims quote the item, its beginning and its end, one of them a passage that is not there.

    Claims go through the quote check, verdicts (an item's label of that document, if it has one) and the answer's status.
    """
    items = table(spark, sf, "benchmark").select("item_id", "text")
    top = _keyword(spark, sf).where("rank <= 3").select(F.col("item_id").alias("question_id"), "id", F.col("rank").cast("int").alias("n"))
    passages = top.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("question_id", "n", "text")
    third = (F.length("text") / 3).cast("int")
    made = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), quote.alias("quote")) for k, (label, quote) in enumerate([("P1", F.col("text")), ("[P2]", F.substring("text", 1, 40)), ("P1", F.substr(F.col("text"), third, third)), ("P7", F.substring("text", 1, 20))])])
    claims = items.select(F.col("item_id").alias("question_id"), F.concat(F.lit("said of "), F.substring("text", 1, 10)).alias("text"), F.explode(made).alias("c")).select("question_id", "text", "c.*")
    verdicts = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).join(top.withColumnRenamed("id", "doc_id"), "doc_id").where("n = 1").select("question_id", F.lit(2).alias("k"), (F.col("q") == 1).alias("supported"))
    said = items.select(F.col("item_id").alias("question_id"), F.element_at(F.array(*map(F.lit, V.STATUSES)), (F.col("item_id") % 4 + 1).cast("int")).alias("status"), (F.col("item_id") % 5 == 0).alias("personal"), F.when(F.col("item_id") % 3 == 0, False).alias("premise_correct"))
    out = V.answers(V.judge(V.check_quotes(claims, passages), verdicts), said, "a|e")
    return out.select("question_id", "status", F.coalesce("message", F.lit("")).alias("message"), "n_kept", "n_dropped")


# -------------------------------------------------------------------- state
def rate_limit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """At most three admitted events of a user in 24 hours; rejected ones leave no trace."""
    return Z.rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", 3, 86400)


def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    return Z.daily_cap(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", "event_id", 5, ["user_id"]).select("event_id", "accepted")


def sm2_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user and type as grades of one card, in order."""
    q = F.when(F.col("value") < 5, 0).when(F.col("value") < 20, 3).when(F.col("value") < 60, 4).otherwise(5)
    graded = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", q.alias("q"))
    return Z.review_cards(graded, ["user_id", "event_type"], ["ts", "event_id"], "q").select("user_id", "event_type", "reps", "interval", F.round("ease", 6).alias("ease"), "lapses")


def activity_days(spark: SparkSession, sf: str) -> DataFrame:
    out = Z.activity_week(table(spark, sf, "events"), "ts", F.lit(1))
    return out.select(F.col("day").cast("string").alias("day"), F.col("total").cast("long").alias("total"))


def latest_wins_cache(spark: SparkSession, sf: str) -> DataFrame:
    return Z.latest_wins(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, dense_topk, dense_cells, hybrid_rrf, hybrid_guaranteed_slots, post_rank_filter_boost, hit_at_k,
        resume_anti, only_semi, claims_left_missing_keep, gold_band_join, nearest_pick, asof_prev_event, forward_fill_chapter,
        sections_of_turns, word_offsets, greedy_pack, edition_diff, recite_align,
        score_items, two_level_summary, metric_pivot, latency_percentiles, majority_vote, failure_reasons, quality_funnel,
        conversation_transcript, checked_answers, rate_limit_decisions, daily_cap, sm2_schedule, activity_days, latest_wins_cache,
    )
}

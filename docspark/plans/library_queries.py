"""Queries of the library's own pipeline (passages, links, answers, scores, reports) over the test tables, each with the SQL it agrees with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import UNICODE
from docspark.operators import evaluation as E
from docspark.operators import linking as L
from docspark.operators import passages as P
from docspark.operators import projections as J
from docspark.operators import segmentation as S
from docspark.operators import verification as V
from docspark.operators import walk as W
from docspark.plans import relational_queries as Q
from docspark.plans.staging import stage
from docspark.plans.tables import table
from docspark.sources import io
from docspark.streaming import state as Z

REFUSALS = {"other_madhhab": "Other schools are not covered.", "contemporary": "New questions are not covered.", "not_in_library": "The library has nothing on this."}
SCOPES = ["answerable", "personal_fatwa", *REFUSALS]
RULES = [("([a-z]{3,}) is ([a-z ]{3,40})", "", "def"), ("([a-z]{3,}) means ([a-z ]{3,40})", "means ", "gloss")]


def passage_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as paragraphs: user turns are units, assistant turns notes, their lines section lines, region names the contents."""
    c = table(spark, sf, "conversations").withColumn("para", F.col("conv_id").cast("string"))
    paras = c.groupBy("para").agg(F.lit("c").alias("chapter"), F.min("turn").alias("pg"), F.lit("bare").alias("text"))
    user = c.where("role = 'user'").select("para", F.col("turn").alias("seq"), F.col("turn").alias("pg"), "text").where("para % 3 <> 0")
    notes = c.where("role = 'assistant'").select("para", F.lit(2).alias("book_id"), F.col("turn").alias("pg"), F.col("turn").cast("int").alias("n"), "text")
    lines = c.where("role = 'assistant'").select("para", F.col("turn").cast("string").alias("heading"), F.col("turn").alias("pg"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    toc = table(spark, sf, "region").agg(F.array_join(F.array_sort(F.collect_list("r_name")), ", ").alias("text")).select(F.lit(1).alias("book_id"), F.lit(1).alias("pg"), "text")
    rows = P.weighted(P.passages(user, paras, [notes], lines, toc, 1, 3), 1, "Et|The|La")
    return rows.select("kind", "book_id", "para", F.col("pg").cast("long").alias("pg"), "heading", F.md5("norm").alias("norm_md5"), F.size("tokens").cast("long").alias("n_tokens"), "weight")


def lemma_links(spark: SparkSession, sf: str) -> DataFrame:
    """Words out of each assistant turn sought in the conversation's turns: four in a row, four with a gap, with one or two of them replaced, and the first word alone of some."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.normalise("text", UNICODE).alias("norm"))
    units = c.select(F.col("conv_id").cast("string").alias("chapter"), F.col("turn").cast("int").alias("idx"), "norm")
    w = F.split("norm", " ")
    at = lambda k: F.get(w, F.lit(k))
    row = F.when(F.col("turn") == 3, F.array(at(2), at(3), at(5), at(6))).when(F.col("turn") == 5, F.array(at(2), F.lit("zzz"), at(4), at(5))).when(F.col("turn") == 7, F.array(at(2), F.lit("zzz"), F.lit("yyy"), at(5))).otherwise(F.slice(w, 3, 4))
    part = F.when((F.col("turn") + F.col("conv_id")) % 10 == 3, at(0)).otherwise(F.array_join(row, " "))
    lemmas = c.where("turn % 2 = 1 and norm <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("lemma_id"), F.col("conv_id").cast("string").alias("chapter"), part.alias("lemma")).where("lemma <> ''")
    return L.lemma_links(lemmas, units).select("lemma_id", F.col("idx").cast("long").alias("idx"), "method", "score")


def _commented(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as chapters of three books: turns that open them are titles, commas are note marks, sentence ends core text."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 3).cast("int").alias("book_id"), F.col("conv_id").cast("string").alias("chapter"), (F.col("conv_id") * 4 + F.floor(F.col("turn") / 2)).cast("int").alias("pg"), F.col("turn").cast("int").alias("seq"), "text")
    marked = F.replace(F.replace("text", F.lit(", "), F.concat(F.lit(" ("), (F.col("seq") % 4).cast("string"), F.lit(") "))), F.lit(". "), F.lit(" (the end) "))
    text = F.when(F.col("seq") == 0, F.substring("text", 1, 20)).when(F.col("seq") == 4, F.substring(F.regexp_replace("text", "[(),.]", ""), 1, 12)).otherwise(marked)
    return c.select("book_id", "chapter", "pg", "seq", F.when(F.col("seq") == 0, "title").otherwise("line").alias("kind"), text.alias("text"))


def unit_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the commented conversations: where each begins, its core and its text over paragraphs and pages."""
    w = W.walk(_commented(spark, sf), UNICODE)
    return w.units.select("book_id", "unit", "chapter", "para", "pg", "core", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def marker_links(spark: SparkSession, sf: str) -> DataFrame:
    """Note marks of the commented conversations with the note of their own page and number, their lemma, and the units of their chapter in whose text the lemma is found."""
    w = W.walk(_commented(spark, sf), UNICODE)
    notes = table(spark, sf, "conversations").select((F.col("conv_id") % 3).cast("int").alias("book_id"), (F.col("conv_id") * 4 + F.floor(F.col("turn") / 2)).cast("int").alias("pg"), (F.col("turn") % 4).cast("int").alias("n"), F.md5("text").alias("note"))
    marks = stage(L.marker_notes(w.markers, notes.groupBy("book_id", "pg", "n").agg(F.min("note").alias("note")), ("book_id", "pg", "n")).withColumn("mark", F.concat_ws(":", "book_id", "pg", "place")), "marks")
    units = w.units.select("chapter", F.col("unit").cast("int").alias("idx"), T.normalise("text", UNICODE).alias("norm"))
    links = L.lemma_links(marks.select(F.col("mark").alias("lemma_id"), "chapter", "lemma"), units, score_none=False).where("method in ('exact', 'exact_span')").groupBy("lemma_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("idx").alias("first"))
    met = marks.join(links.withColumnRenamed("lemma_id", "mark"), "mark", "left")
    return met.select("book_id", "chapter", "para", "pg", F.col("n").cast("long").alias("n"), "lemma", "how", "unit", "unit_pg", "note", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.col("first").cast("long").alias("first"))


def note_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines as an ordered array, their customer's row, and the note of the line of their own number."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", "l_returnflag")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("cust"))
    tree = L.attach(orders, lines, "order", ["l_linenumber"], "lines")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), "c_mktsegment")
    notes = lines.select(F.col("order").alias("pg"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("note"))
    met = L.marker_notes(L.resolve_units(tree, customers, "cust").withColumns({"pg": F.col("order"), "n": (F.col("order") % 7 + 1).cast("int")}), notes.dropDuplicates(["pg", "n"]))
    flags = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return met.select("order", "c_mktsegment", flags.alias("flags"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("note") == "", "-").otherwise("found").alias("note"))


def continued_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as notes of pages of two: a page's first one continues the page before, and every fifth page has no notes."""
    c = table(spark, sf, "conversations").withColumn("pg", F.floor(F.col("turn") / 2))
    n = c.where((F.col("conv_id") + F.col("pg")) % 5 != 0).select("conv_id", "pg", (F.col("turn") % 2).cast("int").alias("n"), F.concat(F.md5("text"), F.lit(" =")).alias("note"))
    return L.continue_notes(n, c.select("conv_id", "pg"), ["conv_id"]).select("conv_id", "pg", F.col("n").cast("long").alias("n"), "note")


def library_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each source's documents by what they are."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")), "doc_id", "left")
    lang = {f"in_{x}": F.col("lang") == x for x in ("en", "fr", "de", "es")}
    size = {"short": F.col("n_chars") < 500, "long": F.col("n_chars") >= 5000, "with_lines": F.contains("text", F.lit("\n"))}
    return E.counts_by(d, ["source"], lang | size | {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1, "unlabelled": F.col("toxic").isNull()})


def search_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The three modes of search, and hybrid without vectors, for every item: ranks of the passage with the item's own id or the next."""
    keyword, dense = Q._keyword(spark, sf), Q._dense(spark, sf)
    found = {m: P.search(m, keyword, dense, "item_id", "id") for m in ("keyword", "dense", "hybrid")} | {"no_vectors": P.search("hybrid", keyword, None, "item_id", "id")}
    items = table(spark, sf, "benchmark").select("item_id")
    gold = items.select("item_id", F.explode(F.array("item_id", F.col("item_id") + 1)).alias("id"))
    hits = P.first_hits(found, gold, "item_id", "id")
    return hits.select("item_id", *[F.col(m).cast("long").alias(m) for m in found])


def glossary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions that documents give by 'is' or 'means', looked up for every word of three letters or more of every benchmark item."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("para"), F.col("lang").alias("chapter"), F.lower("text").alias("text"), F.array("lang").alias("context"))
    entries = P.entries(d, RULES)
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    words = asked.select(F.concat_ws(":", "item_id", "word").alias("query_id"), "word", F.lit("web").alias("para"), F.lit("en").alias("chapter"))
    return P.lookup(entries, words, ["def", "gloss"]).select("query_id", F.col("rank").cast("long").alias("rank"), "word", "definition", "kind", "id")


def answer_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of answers: scope from the gate, refusals, errors that leave a search, costs and times summed."""
    e = table(spark, sf, "events")
    scope = F.element_at(F.array(*map(F.lit, [*SCOPES, "unknown"])), (F.col("event_id") % 6 + 1).cast("int"))
    asked = F.concat(F.when(F.col("event_id") % 4 == 0, "may i ").otherwise("is "), "event_type")
    gated = V.scope_gate(scope, asked, "(^| )i ", SCOPES)
    calls = e.select("user_id", F.col("event_id").alias("call"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "content_filter").otherwise("timeout")).alias("error"),
                     gated.alias("scope"), V.provisional_personal(F.when(F.col("event_id") % 3 == 0, scope), asked, "(^| )i ").alias("personal"),
                     F.when(F.col("value") > 10, F.col("value") / 1000).alias("cost"), F.length("props").alias("tokens_in"), F.length("event_type").alias("tokens_out"), F.col("value").alias("seconds"), F.lit("supported").alias("status"))
    calls = V.degraded(calls)
    out = V.envelope(calls, "user_id", F.coalesce(V.refusal(F.col("scope"), REFUSALS), "status"), {"supported": "Supported by the library.", "not_found": "Not found."})
    flags = E.counts_by(calls, ["user_id"], {"search_only": F.col("search_only"), "refused": V.refusal(F.col("scope"), REFUSALS).isNotNull(), "personal_scope": F.col("scope") == "personal_fatwa", "personal_prompt": F.col("personal")})
    return out.join(flags, "user_id").select("user_id", "status", "status_text", "cost", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), "seconds", "search_only", "refused", "personal_scope", "personal_prompt")


def prompt_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as the numbered passages of one prompt."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").cast("int").alias("n"), F.lit("Book").alias("book"), F.lit("1").alias("vol"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("int")).alias("page"), F.col("role").alias("kind"), "text")
    return V.context(c).select(F.col("question_id").alias("conv_id"), F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("chars"))


def scored_systems(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as answers of two systems, scored item by item in every metric."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    pick = lambda values, of: F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))
    i = F.col("doc_id")
    cite = lambda k: F.struct(F.lit(1).alias("book_id"), (i + k).cast("int").alias("page"))
    sentence = lambda k, ok, judged: F.struct(cite(k).alias("cite"), ok.alias("quote_ok"), judged.alias("judge_ok"))
    raw = F.array(sentence(0, F.col("quality") == 1, F.col("toxic") == 0), sentence(5, F.lit(True), F.lit(None).cast("boolean")))
    results = d.select("doc_id", pick(["answerable", "differing", "out_of_library", "false_premise", "personal_fatwa"], i).alias("category"), (i % 2 == 0).alias("critical"),
                       pick(["answerable", "not_in_library", "personal_fatwa"], i).alias("scope"), pick(["answerable", "not_in_library"], i).alias("expected_scope"), pick(V.STATUSES, i).alias("status"), pick(["supported", "not_found", "differing"], i).alias("expected_status"),
                       F.when(i % 3 == 0, "partial").alias("model_status"), raw.alias("raw_sentences"), F.filter(raw, lambda s: s["quote_ok"] & F.coalesce(s["judge_ok"], F.lit(True))).alias("sentences"),
                       (F.col("quality") + F.col("toxic")).alias("n_dropped"), F.when(i % 4 > 0, F.array(F.struct(F.lit(1).alias("book_id"), (i + i % 3).cast("int").alias("page")))).otherwise(F.array().cast("array<struct<book_id:int,page:int>>")).alias("gold"),
                       (i % 5 == 3).alias("premise_false"), F.when(i % 2 == 1, False).alias("premise_correct"))
    both = E.shown_unverified(E.systems(results)).withColumn("cites", E.citations(F.col("sentences")))
    out = E.score_items(both)
    flags = ["refused", "scope_ok", "status_ok", "correct_refusal", "false_refusal", "invented_on_refusal", "citation_hit", "premise_caught", "referral", "differing_shown", "critical_pass"]
    return out.select("doc_id", "system", "status", *flags, F.round("cited_on_gold_share", 6).alias("cited_on_gold_share"), F.col("n_shown").cast("long").alias("n_shown"), F.col("unverified_shown").cast("long").alias("unverified_shown"), F.col("n_dropped").cast("long").alias("n_dropped"))


def failing_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items (source, n_chars by thousands) that fail in some language's run, with reasons and the failed ids."""
    s = Q._scored(spark, sf).withColumn("item", F.concat_ws("-", "source", (F.col("doc_id") % 50).cast("string")))
    bad = {"wrong": ~F.col("ok"), "shown": F.col("refused") == F.lit(False)}
    runs = E.failing_runs(s, ["item"], "lang", bad)
    return runs.join(E.failed_ids(s, ["item"], "doc_id", ~F.col("ok")), "item", "left")


def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One line a figure: task table, precision, totals, coverage, mismatches and segments of several tables, as a report prints them."""
    e, d, lab = table(spark, sf, "events"), table(spark, sf, "documents"), table(spark, sf, "labels")
    tasks = E.task_table(e, "event_type", F.col("value") < 20, "value").select(F.concat(F.lit("task "), "event_type").alias("name"), F.col("succeeded").cast("double").alias("a"), F.col("median_seconds").alias("b"))
    precise = E.shares(d.join(lab, "doc_id", "left"), ["lang"], F.col("quality") == 1, F.col("quality").isNotNull()).select(F.concat(F.lit("precision "), "lang").alias("name"), F.col("labelled").cast("double").alias("a"), F.col("precision").alias("b"))
    totals = E.counts_by(Q._scored(spark, sf), ["source"], {"ok": F.col("ok")}).select(F.concat(F.lit("total "), "source").alias("name"), F.col("n").cast("double").alias("a"), F.col("ok").cast("double").alias("b"))
    cover = E.coverage(d.select("doc_id"), lab, "doc_id").select(F.lit("coverage").alias("name"), F.col("n").cast("double").alias("a"), F.col("covered").cast("double").alias("b"))
    page = E.mismatches(d.select("doc_id", "lang"), lab.select("doc_id", F.when(F.col("quality") == 1, "en").alias("said")), ["doc_id"], "lang", "said").select(F.lit("mismatch").alias("name"), F.col("n").cast("double").alias("a"), F.col("differing").cast("double").alias("b"))
    core = E.segment_count(d, "text", "[0-9]+").select(F.lit("segments").alias("name"), F.col("segments").cast("double").alias("a"), F.col("rows_with").cast("double").alias("b"))
    out = tasks
    for df in (precise, totals, cover, page, core):
        out = out.unionByName(df)
    return out.select("name", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def run_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Three systems, two runs and every benchmark item, without what is done already (items with an even id in run 1)."""
    items = table(spark, sf, "benchmark").select("item_id")
    systems = spark.createDataFrame([("full",), ("no_retrieval",), ("no_verify",)], "system string")
    every = E.matrix(systems, 2, items)
    return L.resume(every, every.where("run = 1 and item_id % 2 = 0"), ["system", "run", "item_id"]).select("system", F.col("run").cast("long").alias("run"), "item_id")


def best_and_due(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's best value so far, and whether the user's card is due at the end of the table."""
    e = table(spark, sf, "events")
    best = E.best_so_far(e.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    q = F.when(F.col("event_id") % 4 == 0, 0).otherwise(4)
    cards = Z.review_cards(e.select("user_id", "ts", "event_id", q.alias("q")), ["user_id"], ["ts", "event_id"], "q", "ts")
    due = Z.due_cards(cards, F.lit("2024-01-25").cast("timestamp")).select("user_id", F.lit(True).alias("due"))
    return best.join(due, "user_id", "left").select("event_id", "best", F.coalesce("due", F.lit(False)).alias("due"))


def newest_events(spark: SparkSession, sf: str) -> DataFrame:
    """The history list: the newest fifty events."""
    return E.history(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", "event_id").select("event_id", "user_id")


def projected_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Projections and filters over documents: weights of lines, headings, worded lines, confidence, quiz validity, links."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", "lang", "source", "n_chars", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    rows = J.worded(lines, "line").select("doc_id", "seq", F.col("doc_id").alias("book_id"), (F.col("seq") + 1).alias("pg"), "line",
        J.heading_part("line").alias("heading"), J.low_confidence(F.when(F.col("doc_id") % 5 == 0, "fuzzy").otherwise("exact"), F.when(F.col("doc_id") % 7 == 0, False)).alias("low"),
        V.quiz_valid(F.split("line", " "), (F.col("doc_id") % 9).cast("int")).alias("quiz"))
    pages = d.select(F.col("doc_id").alias("book_id"), F.lit(1).alias("pg"), F.col("lang").alias("vol"), F.col("n_chars").alias("page"))
    met = J.references(J.merged(rows, {"line": F.when(F.col("seq") == 0, F.concat(F.lit("> "), "line"))}), pages, "https://example.org/")
    return met.select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("line").alias("line_md5"), "heading", "low", "quiz", F.col("ref.vol").alias("vol"), F.col("ref.page").alias("page"), F.col("ref.link").alias("link"))


def body_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Body paragraphs of documents, and the plain passages of two of three sources with benchmark items as notes."""
    d = table(spark, sf, "documents")
    body = P.body_paragraphs(d.select("doc_id", "text"), 40).select(F.lit("body").alias("kind"), F.col("doc_id").alias("id"), F.md5("text").alias("md5"))
    pages = d.select((F.col("doc_id") % 3).cast("int").alias("book_id"), F.col("doc_id").alias("pg"), "text")
    notes = table(spark, sf, "benchmark").select(F.lit(9).alias("book_id"), F.col("item_id").alias("pg"), "text")
    plain = P.plain_passages(pages, notes, [1]).select(F.lit("plain").alias("kind"), F.col("pg").alias("id"), F.md5("text").alias("md5"))
    return body.unionByName(plain)


def folded_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Every third turn as a tool call, folded into the next message."""
    c = table(spark, sf, "conversations")
    tool = F.col("turn") % 3 == 1
    lines = c.select("conv_id", "turn", F.when(tool, "tool").otherwise("message").alias("kind"), "role", F.when(tool, T.tool_line(F.lit("search"), F.substring("text", 1, 20))).otherwise(F.col("text")).alias("text"))
    b = io.transcript_blocks(lines, "conv_id", "turn")
    return b.select("conv_id", F.col("block").cast("long").alias("block"), "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.md5("tools").alias("tools_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        passage_corpus, lemma_links, unit_walk, marker_links, note_trees, continued_notes, library_stats, search_modes, glossary_lookup, answer_envelopes, prompt_contexts, scored_systems, failing_items,
        report_tables, run_matrix, best_and_due, newest_events, projected_passages, body_lines, folded_transcripts,
    )
}

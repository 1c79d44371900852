"""Scoring of runs: per-item metrics, two-level summaries, pivots, failures, hit rates, usability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import ascii_digits
from docspark.operators.scan import in_order, running
from docspark.operators.verification import REFUSAL_SCOPES


def page_hit(cites: Column, gold: Column) -> Column:
    """Whether any cited (book_id, page) lies within one page of a gold one."""
    return F.exists(cites, lambda c: F.exists(gold, lambda g: (g["book_id"] == c["book_id"]) & (F.abs(g["page"] - c["page"]) <= 1)))


def score_items(items: DataFrame) -> DataFrame:
    """Metric columns of joined items and results; a metric that does not apply is null, so means skip it.

    Needs: category, critical, scope, expected_scope, status, expected_status,
    cites, gold, n_shown, premise_false, premise_correct.
    """
    refused = F.col("scope").isin(REFUSAL_SCOPES) | (F.col("n_shown") == 0)
    refuse = (F.col("category") == "out_of_library") | (F.col("expected_status") == "not_found")
    hit = F.when(F.size("gold") > 0, page_hit(F.col("cites"), F.col("gold")))
    on_gold = F.size(F.filter("cites", lambda c: page_hit(F.array(c), F.col("gold")))) / F.nullif(F.size("cites"), F.lit(0))
    out = items.withColumns(
        {
            "refused": F.coalesce(refused, F.lit(False)),
            "scope_ok": F.coalesce(F.col("scope") == F.col("expected_scope"), F.lit(False)),
            "status_ok": F.coalesce(F.col("status") == F.col("expected_status"), F.lit(False)),
            "citation_hit": F.when(~refuse, hit),
            "cited_on_gold_share": F.when(F.size("gold") > 0, on_gold),
            "premise_caught": F.when(F.col("premise_false"), F.coalesce(F.col("premise_correct") == F.lit(False), F.lit(False))),
            "referral": F.when(F.col("category") == "personal_fatwa", F.coalesce(F.col("scope") == "personal_fatwa", F.lit(False))),
            "differing_shown": F.when(F.col("category") == "differing", F.col("status") == "differing"),
        }
    )
    out = out.withColumns({"correct_refusal": F.when(refuse, F.col("refused")), "false_refusal": F.when(~refuse, F.col("refused")), "invented_on_refusal": F.when(F.col("category") == "out_of_library", F.col("n_shown") > 0)})
    rule = (
        F.when((F.col("category") == "out_of_library") | (refuse & (F.col("category") != "personal_fatwa")), F.col("refused"))
        .when(F.col("category") == "false_premise", F.coalesce("premise_caught", F.lit(False)) & ~F.col("refused"))
        .when(F.col("category") == "personal_fatwa", F.coalesce("referral", F.lit(False)))
        .otherwise(F.coalesce(hit, F.lit(False)) & ~F.col("refused"))
    )
    return out.withColumn("critical_pass", F.when(F.col("critical"), rule))


def quantiles(rows: DataFrame, by: list[str], value: str, nearest: dict[str, float], median: str | None = None) -> DataFrame:
    """(by, names): exact quantiles of each group's values that are not null: nearest rank (the least value with that share of the values up to it), and the mean of the middle two.

    Values are ranked along one order of all rows and picked by rank, so no group's values meet in one task or buffer.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    ranked = running(in_order(kept, [*by, "__x"], "quantiles"), sums={"__n": F.lit(1)})
    groups = ranked.groupBy(*by).agg((F.min("__n") - 1).alias("__base"), F.count(F.lit(1)).alias("__of"))
    wanted = [F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("__of") - 1e-9)).cast("long").alias("at")) for name, share in nearest.items()]
    wanted += [F.struct(F.lit(median).alias("name"), F.expr(at).cast("long").alias("at")) for at in ("(__of + 1) div 2", "__of div 2 + 1")] if median else []
    picks = groups.withColumn("__w", F.explode(F.array(*wanted))).select(*by, "__w.name", (F.col("__base") + F.col("__w.at")).alias("__n"))
    found = picks.join(ranked.select("__n", "__x"), "__n")
    names = [*nearest, *([median] if median else [])]
    return found.groupBy(*by).agg(*[F.avg(F.when(F.col("name") == n, F.col("__x"))).alias(n) for n in names])


def _null_safe_left(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(named, cond, "left").drop(*[f"__r_{k}" for k in by])


def run_metrics(scored: DataFrame, by: list[str], means: list[str], ratios: dict[str, tuple[str, str]] | None = None, latency: str | None = None) -> DataFrame:
    """One row a run: null-skipping means, guarded ratios of sums, median and nearest-rank 95th percentile."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in means]]
    aggs += [(F.sum(F.col(a).cast("double")) / F.nullif(F.sum(F.col(b).cast("double")), F.lit(0.0))).alias(name) for name, (a, b) in (ratios or {}).items()]
    out = scored.groupBy(*by).agg(*aggs)
    if latency:
        out = _null_safe_left(out, quantiles(scored, by, latency, {"latency_p95": 0.95}, "latency_median"), by)
    return out


def two_level(runs: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, metric, mean, min, max) over the runs of each system."""
    long = runs.unpivot([by], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def metric_table(summary: DataFrame, by: str, systems: list[str]) -> DataFrame:
    return summary.groupBy("metric").pivot(by, systems).agg(F.first("mean"))


def majority(rows: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """Most frequent value of each group; of equals the one seen first."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first", value)
    return counted.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__first")


def failures(scored: DataFrame, by: list[str], reasons: dict[str, Column]) -> DataFrame:
    """(by, n_failing, reasons) of every group with a failing row, reasons distinct and sorted."""
    listed = F.filter(F.array(*[F.when(c, name) for name, c in reasons.items()]), lambda r: r.isNotNull())
    hit = scored.withColumn("__r", listed).where(F.size("__r") > 0)
    return hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n_failing"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__r")))), ", ").alias("reasons"))


def hit_rates(ranked: DataFrame, by: str, k: int) -> DataFrame:
    """(by, n, found, first, mean_rank) of the first hit of each query; ``ranked``: by, query_id, rank, hit."""
    best = ranked.groupBy(by, "query_id").agg(F.min(F.when(F.col("hit") & (F.col("rank") <= k), F.col("rank"))).alias("best"))
    return best.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count("best").alias("found"), F.count_if(F.col("best") == 1).alias("first"), F.avg("best").alias("mean_rank"))


def usability(answers: Column) -> Column:
    """System usability score of ten answers from 1 to 5; null if one is missing or no number."""
    numbers = F.transform(answers, lambda x: x.try_cast("int"))
    part = F.transform(numbers, lambda x, i: F.when(i % 2 == 0, x - 1).otherwise(5 - x))
    total = F.aggregate(part, F.lit(0), lambda a, x: a + x) * 2.5
    return F.when((F.size(numbers) == 10) & ~F.exists(numbers, lambda x: x.isNull()), total)


def funnel(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Counts of a chain of yes/no stages, each among those of the stage before, and the share that came through."""
    cond, aggs = F.lit(True), []
    for s in stages:
        cond = cond & F.coalesce(F.col(s), F.lit(False))
        aggs.append(F.count_if(cond).alias(s))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs).withColumn("share", F.col(stages[-1]) / F.nullif(F.col("n"), F.lit(0)))


# ------------------------------------------------------- runs, systems, tables
def systems(results: DataFrame) -> DataFrame:
    """Each result as itself and as ``no_verify``: the raw sentences before any check, with the model's status; a refused scope finds nothing."""
    both = results.withColumn("system", F.explode(F.array(F.lit("full"), F.lit("no_verify"))))
    raw = F.col("system") == "no_verify"
    status = F.when(raw & F.col("scope").isin(REFUSAL_SCOPES), "not_found").when(raw, F.coalesce("model_status", "status")).otherwise(F.col("status"))
    dropped = F.when(raw, 0).otherwise(F.col("n_dropped"))
    return both.withColumns({"status": status, "sentences": F.when(raw, F.col("raw_sentences")).otherwise(F.col("sentences")), "n_dropped": dropped})


def citations(sentences: Column, closed: Column | None = None, books: list[tuple[str, int]] = ()) -> Column:
    """array of (book_id, page): the citations of sentences; those of a closed-book answer are read from the texts book and page."""
    cited = F.transform(F.filter(sentences, lambda s: s["cite"].isNotNull()), lambda s: F.struct(s["cite"]["book_id"].cast("int").alias("book_id"), s["cite"]["page"].cast("int").alias("page")))
    if closed is None:
        return cited

    def read(s: Column) -> Column:
        book = F.lit(None).cast("int")
        for name, number in reversed(list(books)):
            book = F.when(F.contains(s["book"], F.lit(name)), number).otherwise(book)
        return F.struct(book.alias("book_id"), ascii_number(s["page"]).alias("page"))

    return F.when(closed, F.transform(sentences, read)).otherwise(cited)


def ascii_number(c: Column) -> Column:
    digits = F.regexp_extract(ascii_digits(F.coalesce(c, F.lit(""))), "(\\d+)", 1)
    return F.when(digits != "", digits).cast("int")


def shown_unverified(scored: DataFrame) -> DataFrame:
    """scored with n_shown and unverified_shown: of no_verify the sentences with a failed quote or verdict, of a closed book all."""
    bad = F.filter("sentences", lambda s: ~F.coalesce(s["quote_ok"], F.lit(False)) | F.coalesce(s["judge_ok"] == F.lit(False), F.lit(False)))
    n = F.when(F.col("system") == "no_verify", F.size(bad)).when(F.col("system") == "no_retrieval", F.size("sentences")).otherwise(0)
    return scored.withColumns({"n_shown": F.size("sentences"), "unverified_shown": n})


def failed_ids(scored: DataFrame, by: list[str], id_: str, failed: Column) -> DataFrame:
    """(by, failed): the ids that failed in any run, distinct and sorted; a report's list of test items."""
    return scored.where(failed).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(id_).cast("string"))), ",").alias("failed"))


def failing_runs(scored: DataFrame, by: list[str], run: str, reasons: dict[str, Column]) -> DataFrame:
    """(by, n_runs, reasons) of items that fail in some run, most runs first, then by item."""
    named = F.filter(F.array(*[F.when(c, name) for name, c in reasons.items()]), lambda r: r.isNotNull())
    hit = scored.withColumn("__r", named).where(F.size("__r") > 0)
    out = hit.groupBy(*by).agg(F.count_distinct(run).alias("n_runs"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__r")))), "; ").alias("reasons"))
    return out.orderBy(F.desc("n_runs"), *by)


def counts_by(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row a group: n and how often each flag holds; null counts as no."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()])


def shares(rows: DataFrame, by: list[str], right: Column, labelled: Column) -> DataFrame:
    """(by, labelled, right, precision): precision among the labelled rows, null without any."""
    out = rows.where(labelled).groupBy(*by).agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.coalesce(right, F.lit(False))).alias("right"))
    return out.withColumn("precision", F.col("right") / F.col("labelled"))


def coverage(keys: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """(n, covered): how many keys have an entry."""
    return keys.join(found.select(on).distinct().withColumn("__f", F.lit(1)), on, "left").agg(F.count(F.lit(1)).alias("n"), F.count("__f").alias("covered"))


def task_table(tasks: DataFrame, by: str, success: Column, seconds: str) -> DataFrame:
    counted = tasks.groupBy(by).agg(F.count_if(F.coalesce(success, F.lit(False))).alias("succeeded"))
    return _null_safe_left(counted, quantiles(tasks, [by], seconds, {}, "median_seconds"), [by])


def mismatches(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """(n, differing): rows that meet, and how many of them differ; null differs from a value."""
    return left.join(right, on).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("differing"))


def segment_count(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    return rows.agg(F.sum(F.regexp_count(text, F.lit(pattern))).cast("long").alias("segments"), F.count_if(F.col(text).rlike(pattern)).alias("rows_with"))


def best_so_far(rows: DataFrame, by: list[str], order: list[str], score: str) -> DataFrame:
    """rows with the best score of their group up to here."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("best", F.max(score).over(w))


def history(rows: DataFrame, at: str, id_: str, k: int = 50) -> DataFrame:
    """The newest k rows: a report's list."""
    return rows.orderBy(F.desc(at), F.desc(id_)).limit(k)


def matrix(systems_: DataFrame, runs: int, items: DataFrame, most: int = 1000) -> DataFrame:
    """Every system, run and item; systems and runs are short lists given as parameters, so each item is repeated in place. More than ``most`` systems are refused."""
    names = [r[0] for r in systems_.distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} systems")
    pairs = F.array(*[F.struct(F.lit(n).alias("system"), F.lit(k).alias("run")) for n in sorted(names) for k in range(1, runs + 1)])
    return items.withColumn("__p", F.explode(pairs)).select("*", "__p.*").drop("__p")

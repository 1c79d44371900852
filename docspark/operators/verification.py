"""Claims checked against passages: verbatim quotes, judge verdicts, recomputed status, messages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.profiles import UNICODE, TextProfile

STATUSES = ["supported", "partial", "differing", "not_found"]
REFUSAL_SCOPES = ["other_madhhab", "contemporary", "not_in_library"]


class ModelProvider(Protocol):
    """A model that answers prompts; the stub below is deterministic."""

    def ask(self, prompt: str) -> str: ...


class StubModel:
    """Supports a claim when it shares a word of four letters with its quote."""

    def ask(self, prompt: str) -> str:
        claim, _, quote = prompt.partition("\n")
        shared = {w for w in claim.lower().split() if len(w) > 3} & set(quote.lower().split())
        return "supported" if shared else "unsupported"


def ask_model(rows: DataFrame, prompt: str, provider: ModelProvider, into: str = "answer") -> DataFrame:
    """rows with the provider's answers; a failure becomes an error column, not a failed job."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"`{into}` string", "error string"])

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for p in batch[prompt]:
                try:
                    answers.append(provider.ask(p))
                    errors.append(None)
                except Exception as e:  # the row carries the failure
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(**{into: answers, "error": errors})

    return rows.mapInPandas(asked, schema)


def check_quotes(claims: DataFrame, passages: DataFrame, profile: TextProfile = UNICODE) -> DataFrame:
    """claims (question_id, k, label, quote, ...) with quote_ok and reason; passages: question_id, n, text.

    The label's number must name a passage and the normalised quote, not empty, must occur in it.
    """
    known = passages.select("question_id", "n", T.normalise("text", profile).alias("__norm"))
    met = claims.withColumn("n", T.label_number("label")).join(known, ["question_id", "n"], "left")
    quote = T.normalise("quote", profile)
    ok = F.coalesce(F.contains("__norm", quote) & (quote != ""), F.lit(False))
    reason = F.when(F.col("__norm").isNull(), "no such passage").when(~ok, "quote is not in the passage")
    return met.withColumn("quote_ok", ok).withColumn("reason", reason).drop("__norm")


def judge(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """checked with kept: the quote holds and no verdict (question_id, k, supported) denies it; a null verdict denies."""
    met = checked.join(verdicts.withColumn("__seen", F.lit(True)), ["question_id", "k"], "left")
    denied = F.coalesce("__seen", F.lit(False)) & ~F.coalesce("supported", F.lit(False))
    out = met.withColumn("kept", F.col("quote_ok") & ~denied)
    return out.withColumn("reason", F.when(F.col("quote_ok") & denied, "the quote does not support the claim").otherwise(F.col("reason"))).drop("__seen", "supported")


def status(said: Column, n_kept: Column, n_dropped: Column, attributed: Column) -> Column:
    """The status that the kept claims bear out; the order of the rules matters."""
    valid = F.when(said.isin(STATUSES), said).otherwise("not_found")
    named = F.when((valid == "differing") & ~attributed, "supported").otherwise(valid)
    partial = F.when(n_dropped > 0, "partial").otherwise("supported")
    return F.when(n_kept == 0, "not_found").when((named == "supported") | (named == "not_found"), partial).otherwise(named)


def message(n_kept: Column, personal: Column, premise_correct: Column) -> Column:
    return F.when((n_kept == 0) & personal, "personal_nothing").when(n_kept == 0, "not_in_library").when(personal, "personal_prefix").when(premise_correct == F.lit(False), "premise_prefix")


def answers(judged: DataFrame, said: DataFrame, attribution: str) -> DataFrame:
    """One row a question: status, message, kept and dropped claims. ``said``: question_id, status, personal, premise_correct."""
    names = F.coalesce(F.lower(F.concat_ws(" ", "text", "quote")).rlike(attribution), F.lit(False))
    per = judged.groupBy("question_id").agg(F.count_if(F.col("kept")).alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"), F.coalesce(F.bool_or(F.col("kept") & names), F.lit(False)).alias("__attributed"))
    met = said.join(per, "question_id", "left").fillna(0, ["n_kept", "n_dropped"]).fillna(False, ["__attributed"])
    out = met.withColumn("final", status(F.col("status"), F.col("n_kept"), F.col("n_dropped"), F.col("__attributed")))
    return out.select("question_id", F.col("final").alias("status"), message(F.col("n_kept"), F.coalesce("personal", F.lit(False)), F.col("premise_correct")).alias("message"), "n_kept", "n_dropped")


# -------------------------------------------------------- the answer pipeline
def scope_gate(said: Column, question: Column, first_person: str, scopes: list[str]) -> Column:
    """The scope of a question: what the model said if it is known, else answerable; an answerable one in the first person is personal."""
    known = F.when(said.isin(scopes), said).otherwise("answerable")
    return F.when((known == "answerable") & F.coalesce(question.rlike(first_person), F.lit(False)), "personal_fatwa").otherwise(known)


def provisional_personal(scope: Column, question: Column, first_person: str) -> Column:
    """Whether the personal prompt is used: by the scope, and while that is unknown by the first person alone."""
    return F.coalesce(scope == "personal_fatwa", question.rlike(first_person), F.lit(False))


def refusal(scope: Column, texts: dict[str, str]) -> Column:
    """Fixed text of a refused scope, else null."""
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(scope == name, text).otherwise(out)
    return out


def depth_rule(depth: Column, rules: dict[str, str], default: str = "") -> Column:
    """What the prompt says about length."""
    return refusal(depth, rules) if not default else F.coalesce(refusal(depth, rules), F.lit(default))


def context(passages: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, context): the numbered passages of a question (n, book, vol, page, kind, text) as the prompt shows them; a question has few."""
    line = F.format_string("[P%d] %s, %s, %s (%s):\n%s", "n", F.coalesce("book", F.lit("")), F.coalesce("vol", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("")), F.coalesce("kind", F.lit("")), "text")
    listed = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return passages.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("context"))


def keep_all(checked: DataFrame) -> DataFrame:
    """Without verification every claim is kept."""
    return checked.withColumn("kept", F.lit(True))


def closed_book(claims: DataFrame) -> DataFrame:
    """Claims of an answer given without passages: nothing is checked and no citation exists."""
    return claims.withColumns({"quote_ok": F.lit(None).cast("boolean"), "kept": F.lit(True), "n": F.lit(None).cast("int")})


def degraded(answers_: DataFrame, error: str = "error", filtered: str = "content_filter") -> DataFrame:
    """answers with search_only and status: a filtered one finds nothing but shows its passages, any other error leaves the search alone."""
    bad = F.col(error).isNotNull()
    hidden = F.coalesce(F.contains(F.col(error), F.lit(filtered)), F.lit(False))
    return answers_.withColumns({"search_only": bad & ~hidden, "status": F.when(bad, "not_found").otherwise(F.col("status"))})


def envelope(calls: DataFrame, by: str, status: str | Column, texts: dict[str, str]) -> DataFrame:
    """One row an answer: status text, cost, tokens and latency summed over its calls; sums of nothing are null."""
    sums = [F.round(F.sum("cost"), 6).alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("seconds"), 6).alias("seconds")]
    out = calls.groupBy(by).agg(F.max_by(status, "call").alias("status"), *sums)
    return out.withColumn("status_text", refusal(F.col("status"), texts))


def quiz_valid(options: Column, answer: Column) -> Column:
    """A question of a quiz has two options or more and an answer among them."""
    return F.coalesce((F.size(options) >= 2) & (answer >= 0) & (answer < F.size(options)), F.lit(False))


def study_items(items: DataFrame, passages: DataFrame, verdicts: DataFrame, profile: TextProfile = UNICODE) -> DataFrame:
    """(section, generated, quote_ok, judge_ok) of study items (section, k, label, quote, options, answer): valid, quoted word for word, not denied."""
    valid = items.where(F.col("options").isNull() | quiz_valid(F.col("options"), F.col("answer")))
    named = {"section": "question_id"}
    judged = judge(check_quotes(valid.withColumnsRenamed(named), passages.withColumnsRenamed(named), profile), verdicts.withColumnsRenamed(named))
    counts = judged.groupBy("question_id").agg(F.count(F.lit(1)).alias("generated"), F.count_if("quote_ok").alias("quote_ok"), F.count_if("kept").alias("judge_ok"))
    return counts.withColumnRenamed("question_id", "section")

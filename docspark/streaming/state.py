"""Keyed state: rate limit, daily cap, review schedule, activity, latest-wins table; batch form and stream form."""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docspark.functions import sequences as Q


def admit(times: Iterator[float], kept: deque, most: int, window_s: float) -> Iterator[bool]:
    """Whether each request is admitted: fewer than ``most`` admitted ones lie at most window_s back. A rejected one leaves no trace."""
    for t in times:
        while kept and t - kept[0] > window_s:
            kept.popleft()
        ok = len(kept) < most
        if ok:
            kept.append(t)
        yield ok


def rate_limit(requests: DataFrame, key: str, at: str, id_: str, most: int = 6, window_s: float = 60) -> DataFrame:
    """(key, id, accepted): rows of a key stream through one generator in order; what it holds is the key's last admitted times."""
    kinds = dict(requests.dtypes)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["__t"]):
                if k != current:
                    current, kept = k, deque()
                out += admit([t], kept, most, window_s)
            yield batch[[key, id_]].assign(accepted=out)

    seconds = (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__t")
    ordered = requests.select(key, id_, seconds).repartition(key).sortWithinPartitions(key, "__t", id_)
    return ordered.mapInPandas(decide, f"{key} {kinds[key]}, {id_} {kinds[id_]}, accepted boolean")


def rate_limit_stream(requests: DataFrame, key: str, at: str, id_: str, most: int = 6, window_s: float = 60, late: str = "10 minutes") -> DataFrame:
    """Stream form of rate_limit: the admitted times of a key are its state, given up once the watermark has passed the window after the last one.

    Admission and time-out both go by event time, so a backlog after a pause is
    judged as if it had come at once. Requests of one micro-batch are judged in
    order. Spark drops those that come more than ``late`` behind the newest one.
    """
    kinds = dict(requests.dtypes)

    def decide(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        whole = pd.concat(list(batches)).sort_values(["__t", id_])
        accepted = list(admit(whole["__t"], kept, most, window_s))
        if kept:
            state.update((list(kept),))
            state.setTimeoutTimestamp(max(int((kept[-1] + window_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: group[0], id_: whole[id_].to_numpy(), "accepted": accepted})

    time = F.col(at).cast("timestamp")
    shifted = requests.withColumn("__at", time + F.expr("interval 1 millisecond"))  # what lies exactly at the watermark is in time
    timed = shifted.withWatermark("__at", late).select(key, id_, "__at", (F.unix_micros(time) / 1e6).alias("__t"))
    return timed.groupBy(key).applyInPandasWithState(decide, f"{key} {kinds[key]}, {id_} {kinds[id_]}, accepted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def daily_cap(requests: DataFrame, at: str, id_: str, most: int, by: list[str] | None = None) -> DataFrame:
    """requests with ``accepted``: the first ``most`` of each day. With ``by`` the cap holds for each of its values."""
    w = Window.partitionBy(F.to_date(at), *(by or [])).orderBy(at, id_)
    return requests.withColumn("accepted", F.row_number().over(w) <= most)


#: The interval's factors by grade and the terms of the ease.
INTERVAL_FACTORS, FIRST_INTERVALS = {3: 0.8, 5: 1.3}, {0: 1, 1: 3}


def next_review(card: tuple, q: int) -> tuple:
    """(reps, interval in days, ease, lapses) after one more grade; the interval is computed with the ease before it, halves round up."""
    reps, interval, ease, lapses = card
    if q < 3:
        return 0, 0, ease, lapses + 1
    grown = min(math.floor(interval * ease * INTERVAL_FACTORS.get(q, 1.0) + 0.5), 2**62)
    return reps + 1, FIRST_INTERVALS.get(reps, grown), max(1.3, ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))), lapses


def review_cards(graded: DataFrame, keys: list[str], order: list[str], grade: str, at: str | None = None) -> DataFrame:
    """(keys, reps, interval, ease, lapses, due) of each card after its grades in order; rows stream through one generator that holds one card.

    ``due``: the last grade's time plus the interval in days, or ten minutes after a lapse; null without ``at`` and beyond a million days.
    """
    kinds = dict(graded.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "reps int, interval long, ease double, lapses int, __last double"])
    names = [*keys, "reps", "interval", "ease", "lapses", "__last"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, card, last = None, (0, 0, 2.5, 0), None
        for batch in batches:
            done = []
            for key, q, t in zip(zip(*(batch[k] for k in keys)), batch["__q"], batch["__t"]):
                if key != current:
                    if current is not None:
                        done.append((*current, *card, last))
                    current, card = key, (0, 0, 2.5, 0)
                card, last = next_review(card, int(q)), t
            if done:
                yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([(*current, *card, last)], columns=names)

    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 if at else F.lit(None).cast("double")
    ordered = graded.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col(grade).alias("__q"), seconds.alias("__t"))
    out = ordered.mapInPandas(follow, schema)
    days = F.when(F.col("interval") <= 1_000_000, F.col("interval"))  # further intervals lie beyond the calendar
    due = F.timestamp_seconds(F.col("__last") + F.when(F.col("interval") == 0, 600).otherwise(days * 86400))
    return out.withColumn("due", due).drop("__last")


def due_cards(cards: DataFrame, now: Column) -> DataFrame:
    """Cards that are due, the longest due first."""
    return cards.where(F.col("due") <= now).orderBy("due")


def transcripts(turns: DataFrame, by: str, order: list[str], line: str) -> DataFrame:
    """(by, transcript_md5, chars) of each group's lines joined in order; the lines stream, so a group may be of any length."""
    kind = dict(turns.dtypes)[by]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, chars, some = None, hashlib.md5(), 0, False
        for batch in batches:
            done = []
            for k, text in zip(batch[by], batch["__line"]):
                if not some or k != current:
                    if some:
                        done.append((current, held.hexdigest(), chars))
                    current, held, chars, some = k, hashlib.md5(text.encode()), len(text), True
                else:
                    held.update(b"\n" + text.encode())
                    chars += 1 + len(text)
            if done:
                yield pd.DataFrame(done, columns=[by, "transcript_md5", "chars"])
        if some:
            yield pd.DataFrame([(current, held.hexdigest(), chars)], columns=[by, "transcript_md5", "chars"])

    ordered = turns.repartition(by).sortWithinPartitions(by, *order).select(by, F.col(line).alias("__line"))
    return ordered.where("__line is not null").mapInPandas(digest, f"{by} {kind}, transcript_md5 string, chars long")


def fresh(entries: DataFrame, at: str, now: Column, seconds: int = 480) -> DataFrame:
    """Entries of a cache that are younger than their time to live."""
    return entries.where(F.col(at).cast("timestamp") > now - F.make_dt_interval(secs=F.lit(seconds)))


def recited(line: list[str], words: list[str], base: int) -> tuple[bool, int]:
    """Whether an utterance counts, and how far the session has come after it; a rejected one leaves the place where it was."""
    states = Q.follow(line[base:], words)
    ok = Q.accepted(states)
    return ok, base + (sum(s != "pending" for s, _ in states) if ok else 0)


def recitation(utterances: DataFrame, key: str, order: str, expected: str, heard: str) -> DataFrame:
    """(key, order, committed, base): how far each utterance of a recitation brings its session.

    ``expected`` (words of the whole line) and ``heard`` (words of one final utterance) are arrays; the state of a session is its place.
    """
    kinds = dict(utterances.dtypes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, base = object(), 0
        for batch in batches:
            out = []
            for k, line, words in zip(batch[key], batch[expected], batch[heard]):
                if k != current:
                    current, base = k, 0
                ok, base = recited(list(line), list(words), base)
                out.append((ok, base))
            yield batch[[key, order]].assign(committed=[x[0] for x in out], base=[x[1] for x in out])

    ordered = utterances.select(key, order, expected, heard).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(each, f"{key} {kinds[key]}, {order} {kinds[order]}, committed boolean, base int")


def memo(requests: DataFrame, key: str, part: str, at: str, id_: str, seconds: float) -> DataFrame:
    """(key, id, part, hit, from_id): which request each one is answered from: the last one of its key and part that was answered anew at most ``seconds`` before, or itself.

    Rows of a key stream through one generator in order of time; it holds the last answer of each of the key's parts.
    """
    kinds = dict(requests.dtypes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), {}
        for batch in batches:
            out = []
            for k, p, i, t in zip(batch[key], batch[part], batch[id_], batch["__t"]):
                if k != current:
                    current, held = k, {}
                out.append(answered(held, p, i, t, seconds))
            yield batch[[key, id_, part]].assign(hit=[x[0] for x in out], from_id=[x[1] for x in out])

    ordered = requests.select(key, id_, part, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("__t")).repartition(key).sortWithinPartitions(key, "__t", id_)
    return ordered.mapInPandas(each, f"{key} {kinds[key]}, {id_} {kinds[id_]}, {part} {kinds[part]}, hit boolean, from_id {kinds[id_]}")


def answered(held: dict, part, id_, t: float, seconds: float) -> tuple[bool, object]:
    """(hit, from whom); a request without an answer that is young enough becomes one."""
    if part in held and t - held[part][1] <= seconds:
        return True, held[part][0]
    held[part] = id_, t
    return False, id_


def activity_week(rows: DataFrame, at: str, amount: Column, first_day: str = "Saturday") -> DataFrame:
    """(day, total) of every day from the week's first day before the earliest row to the end of the latest row's week."""
    shift = {"Saturday": 5, "Sunday": 6, "Monday": 0}[first_day]
    day = F.to_date(at)
    weekday = lambda d: F.pmod(F.weekday(d) - shift, F.lit(7))
    sums = rows.groupBy(day.alias("day")).agg(F.sum(amount).alias("total"))
    span = sums.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence(F.date_sub("a", weekday(F.col("a"))), F.date_add("b", 6 - weekday(F.col("b"))))).alias("day"))
    return spine.join(sums, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"))


def latest_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One struct maximum a key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__m"))
    return best.select(*key, *[F.col(f"__m.{c}").alias(c) for c in [*order, *[c for c in rest if c not in order]]])


def hourly_activity(stream: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Counts of an event stream by hour, closed when the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")

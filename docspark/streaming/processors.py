"""Stream forms of keyed state as stateful processors: value and map state, given up by timers of event time.

Each agrees with its batch form in ``streaming.state`` as long as rows come in order of time, or late by no more
than ``late``; Spark drops what is later. State never outlives its use: a timer is set for the time after
which it can change nothing, and when the watermark has passed that, the state goes.
Rows of one key in one micro-batch are sorted in memory, so the trigger bounds them (files, offsets or rates).

The RocksDB state store is needed; ``with_state_store`` sets it on a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from docspark.streaming.state import answered, next_review, recited

DAY_MS = 86_400_000
_NO_DAY = 1 - 2**31


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Keyed(StatefulProcessor):
    """State of a key as one row (``schema``) or, with ``part``, as rows by part.

    ``step(state, rows)`` takes the state (None or a tuple; with ``part`` a dict) and the key's rows in order, and returns
    the new state, the time in milliseconds after which it is of no use (None: keep no state), and the rows of the result.
    """

    def __init__(self, key: str, order: list[str], schema: str, step: Callable, part: str | None = None):
        self.key, self.order, self.schema, self.step, self.part = key, order, schema, step, part

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")
        self.state = handle.getMapState("state", self.part, self.schema) if self.part else handle.getValueState("state", self.schema)

    def _load(self):
        if self.part:
            return {k[0]: tuple(v) for k, v in self.state.iterator()}
        return tuple(self.state.get()) if self.state.exists() else None

    def _save(self, old, new) -> None:
        if not self.part:
            self.state.update(new)
            return
        for k in old.keys() - new.keys():
            self.state.removeKey((k,))
        for k, v in new.items():
            if old.get(k) != v:
                self.state.updateValue((k,), v)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(self.order)
        old = self._load()
        state, until, out = self.step(dict(old) if self.part else old, whole)
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        if until is None:
            self._clear()
        else:
            self._save(old, state)
            until = max(int(until), timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(until)
            self.until.update((until,))
        if len(out):
            yield out.assign(**{self.key: key[0]})

    def _clear(self) -> None:
        self.state.clear()
        self.until.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, at: str, late: str, columns: list[str], order: list[str], schema: str, step: Callable, result: str, mode: str = "append", part: str | None = None) -> DataFrame:
    """The processor over rows with their time: event_us in microseconds; event_at, a millisecond later, is the event time, so that what lies exactly at the watermark is in time. (Names with leading underscores do not reach a processor.)"""
    with_state_store(rows.sparkSession)
    time = F.col(at).cast("timestamp")
    timed = rows.withColumn("event_at", time + F.expr("interval 1 millisecond")).withWatermark("event_at", late).withColumn("event_us", F.unix_micros(time))
    return timed.select(key, "event_at", "event_us", *columns).groupBy(key).transformWithStateInPandas(Keyed(key, order, schema, step, part), result, mode, "eventTime")


def daily_cap_stream(requests: DataFrame, key: str, at: str, id_: str, most: int, late: str = "10 minutes") -> DataFrame:
    """Stream form of daily_cap by a key: the day and how many requests it has used, given up when the day is over; an earlier day is over, a request without a time is not accepted and leaves no trace."""
    kinds = dict(requests.dtypes)

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple:
        day, used = state or (_NO_DAY, 0)
        accepted = []
        for d in rows["event_day"]:
            if d > day:
                day, used = int(d), 0
            ok = d == day and used < most
            used += ok
            accepted.append(bool(ok))
        out = pd.DataFrame({id_: rows[id_].to_numpy(), "accepted": accepted})
        return (day, int(used)), (day + 1) * DAY_MS + 1, out

    result = f"{key} {kinds[key]}, {id_} {kinds[id_]}, accepted boolean"
    timed = requests.where(F.col(at).isNotNull()).withColumn("event_day", F.unix_date(F.to_date(F.col(at).cast("timestamp"))))
    taken = _run(timed, key, at, late, [id_, "event_day"], ["event_us", id_], "day int, used int", step, result)
    return taken.unionByName(requests.where(F.col(at).isNull()).select(key, id_, F.lit(False).alias("accepted")))


def review_cards_stream(graded: DataFrame, key: str, at: str, grade: str, late: str = "10 minutes", keep_days: int = 3650) -> DataFrame:
    """Stream form of review_cards: every micro-batch that grades a card gives its new state. A card not graded for ``keep_days`` is given up and would begin anew."""
    kind = dict(graded.dtypes)[key]

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple:
        card = state or (0, 0, 2.5, 0)
        for q in rows["event_grade"]:
            card = next_review(card, int(q))
        return card, rows["event_us"].max() // 1000 + keep_days * DAY_MS, pd.DataFrame([card], columns=["reps", "interval", "ease", "lapses"])

    schema = "reps int, interval long, ease double, lapses int"
    return _run(graded.withColumn("event_grade", F.col(grade)), key, at, late, ["event_grade"], ["event_us", "event_grade"], schema, step, f"{key} {kind}, {schema}", "update")


def recitation_stream(utterances: DataFrame, key: str, at: str, order: str, expected: str, heard: str, late: str = "1 minute", idle: float = 3600) -> DataFrame:
    """Stream form of recitation: the place of a session, given up when nothing has been said for ``idle`` seconds; it would begin anew."""
    kinds = dict(utterances.dtypes)

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple:
        base, out = state[0] if state else 0, []
        for line, words in zip(rows[expected], rows[heard]):
            ok, base = recited(list(line), list(words), base)
            out.append((ok, base))
        said = pd.DataFrame({order: rows[order].to_numpy(), "committed": [x[0] for x in out], "base": [x[1] for x in out]})
        return (base,), rows["event_us"].max() // 1000 + int(idle * 1000), said

    return _run(utterances, key, at, late, [order, expected, heard], [order], "base int", step, f"{key} {kinds[key]}, {order} {kinds[order]}, committed boolean, base int")


def memo_stream(requests: DataFrame, key: str, part: str, at: str, id_: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """Stream form of memo: the last answer of each part of a key as map state; an answer older than ``seconds`` at the key's next request goes, and all when the youngest is."""
    kinds = dict(requests.dtypes)

    def step(state: dict, rows: pd.DataFrame) -> tuple:
        out = [answered(state, p, i, t / 1e6, seconds) for p, i, t in zip(rows[part], rows[id_], rows["event_us"])]
        young = {p: (int(i), float(t)) for p, (i, t) in state.items() if rows["event_us"].max() / 1e6 - t <= seconds}
        said = pd.DataFrame({id_: rows[id_].to_numpy(), part: rows[part].to_numpy(), "hit": [x[0] for x in out], "from_id": [x[1] for x in out]})
        return young, int((max(t for _, t in young.values()) + seconds) * 1000) + 1, said

    result = f"{key} {kinds[key]}, {id_} {kinds[id_]}, {part} {kinds[part]}, hit boolean, from_id {kinds[id_]}"
    return _run(requests, key, at, late, [id_, part], ["event_us", id_], "id long, t double", step, result, part=f"part {kinds[part]}")

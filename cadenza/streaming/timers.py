"""Pings and ticks by event time: a clock that tests and reruns can rely on, as it moves with the events' own times.

`transformWithState` keeps a few numbers for each job. What falls between two events of a job is told when the second one is read;
what comes after a job's last event is told by timers as the watermark passes. So the same events give the same pings in one batch or
many, except that the tail reaches as far as the watermark did. The session needs the RocksDB state store (`state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import IDLE_MS, LAST_EVENTS, tick_value

ROCKS, PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that timers need, for streams started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Timed(StatefulProcessor):
    """Rows of a job in the order of time and seq, one after the other; then one timer at the next thing to tell."""

    columns: list[str] = []

    def in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """A batch's rows of one job: a few columns of what a trigger admits."""
        parts = [pdf[["at_ms", "seq", *self.columns]] for pdf in rows]
        return pd.concat(parts, ignore_index=True).sort_values(["at_ms", "seq"]).itertuples(index=False, name=None)

    def rearm(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Heartbeats(_Timed):
    """Each event up to a job's last one, and a ping whenever `idle` has passed since the event or ping before."""

    columns = ["event"]

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "last long, done boolean")

    def _pings(self, last: int, before: int) -> list[int]:
        return list(range(last + self.idle, before, self.idle))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, done = self.held.get() if self.held.exists() else (None, False)
        out = []
        for at, _, event in self.in_order(rows):
            if done:
                break
            if last is not None:
                pings = self._pings(last, at)
                out += [("ping", p) for p in pings]
            out.append((event, at))
            last, done = max(at, last) if last is not None else at, event in LAST_EVENTS
        self.held.update((last, done))
        self.rearm(None if done else last + self.idle)
        if out:
            yield pd.DataFrame({"job_id": key[0], "event": [e for e, _ in out], "at_ms": [t for _, t in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, done = self.held.get()
        pings = self._pings(last, timerValues.getCurrentWatermarkInMs() + 1)
        if pings and not done:
            self.held.update((pings[-1], False))
            self.handle.registerTimer(pings[-1] + self.idle)
            yield pd.DataFrame({"job_id": key[0], "event": "ping", "at_ms": pings})


class Ticks(_Timed):
    """What a ticker says at whole multiples of `every` after a job's first event, until an event that ends it or its stage."""

    columns = ["event", "percent", "eta_seconds"]

    def __init__(self, every: int, cap: float) -> None:
        self.every, self.cap = every, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "began long, told long, eta double, real double, done boolean")

    def _ticks(self, began: int, told: int, before: int, eta: float | None, real: float | None) -> list[tuple[int, float | None]]:
        return [(at, tick_value(real, (at - began) / 1000, eta, self.cap)) for at in range(told + self.every, before, self.every)]

    def _frame(self, key: tuple, ticks: list[tuple[int, float | None]]) -> Iterator[pd.DataFrame]:
        said = [(t, p) for t, p in ticks if p is not None]
        if said:
            yield pd.DataFrame({"job_id": key[0], "at_ms": [t for t, _ in said], "percent": [p for _, p in said]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, told, eta, real, done = self.held.get() if self.held.exists() else (None, None, None, None, False)
        out: list[tuple[int, float | None]] = []
        for at, _, event, percent, eta_seconds in self.in_order(rows):
            if done:
                break
            began, told = (at, at) if began is None else (began, told)
            now = self._ticks(began, told, at, eta, real)
            out, told = out + now, now[-1][0] if now else told
            eta = float(eta_seconds) if pd.notna(eta_seconds) else eta
            real = float(percent) if event == "stage_progress" and pd.notna(percent) else real
            done = event in LAST_EVENTS or event == "stage_completed"
        self.held.update((began, told, eta, real, done))
        self.rearm(None if done else told + self.every)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, told, eta, real, done = self.held.get()
        now = self._ticks(began, told, timerValues.getCurrentWatermarkInMs() + 1, eta, real)
        if now and not done:
            self.held.update((began, now[-1][0], eta, real, False))
            self.handle.registerTimer(now[-1][0] + self.every)
            yield from self._frame(key, now)


def _timed(events: DataFrame, late: str, processor: _Timed, schema: str) -> DataFrame:
    rows = events.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(processor, schema, "append", "eventTime")


def with_heartbeats(events: DataFrame, idle_ms: int = IDLE_MS, late: str = "0 seconds") -> DataFrame:
    """job_id, event, at_ms: every event up to a job's last one, and a ping for each `idle_ms` of its silence, by event time.

    A silence ends just before the next event: a ping that would fall on it is not sent. `late` is how far events may be out of order.
    """
    return _timed(events, late, Heartbeats(idle_ms), "job_id string, event string, at_ms long")


def with_ticks(events: DataFrame, every_ms: int = 5_000, cap: float = 0.99, late: str = "0 seconds") -> DataFrame:
    """job_id, at_ms, percent of jobs in `events` (EVENTS plus eta_seconds): the last reported share, before the first the elapsed part
    of the eta, nothing without either; never over `cap`. An event at the time of a tick is read first if it came before it."""
    return _timed(events, late, Ticks(every_ms, cap), "job_id string, at_ms long, percent double")

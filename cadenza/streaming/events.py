"""Structured Streaming over job events (job_id, seq, ts, event, stage, percent): progress, duplicates, heartbeats, state.

State is kept per job and stage: a few numbers, dropped after a terminal event or when a job is silent for long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job_id string, seq long, ts timestamp, event string, stage string, percent double"
# The events after which a job sends no more.
LAST_EVENTS = ["job_completed", "error", "stream_end"]
IDLE_MS, FORGET_MS = 30_000, 86_400_000


def in_order(frames: Iterable[pd.DataFrame], *columns: str) -> pd.DataFrame:
    """A batch's rows of one job by seq: of what a trigger admits, just the columns that are looked at."""
    parts = [pdf[["seq", *columns]] for pdf in frames]
    return pd.concat(parts, ignore_index=True).sort_values("seq", kind="stable")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (job_id, seq) once, however often it is delivered within `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "seq"])


def emitted_progress(events: DataFrame, step: float = 0.02) -> DataFrame:
    """job_id, stage, percent of the stage_progress events that are sent on: never falling, `step` apart, or 1.

    The higher of several sources wins. A batch's events are taken in the order of seq.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else (0.0, 0.0)
        out = []
        for p in in_order(frames, "percent")["percent"]:
            p = min(1.0, max(0.0, float(p)))
            if p >= seen:
                seen = p
                if p - last >= step or p >= 1.0:
                    last = p
                    out.append(p)
        state.update((seen, last))
        state.setTimeoutDuration(FORGET_MS)
        yield pd.DataFrame({"job_id": key[0], "stage": key[1], "percent": out})

    known = events.filter((F.col("event") == "stage_progress") & F.col("percent").isNotNull())
    return known.groupBy("job_id", "stage").applyInPandasWithState(run, "job_id string, stage string, percent double", "seen double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_heartbeats(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """job_id, event: every event up to a job's terminal one, and a ping whenever it has been silent for `idle_ms`."""

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((False,))
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"job_id": [key[0]], "event": ["ping"]})
            return
        if state.exists and state.get[0]:
            return
        rows = in_order(frames, "event")
        over = rows["event"].isin(LAST_EVENTS).to_numpy()
        kept = rows.iloc[: int(over.argmax()) + 1] if over.any() else rows
        state.update((bool(over.any()),))
        if not over.any():
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"job_id": key[0], "event": kept["event"].to_numpy()})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id string, event string", "done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tick_value(real: float | None, elapsed: float, eta: float | None, cap: float = 0.99) -> float | None:
    """The share a tick reports: the service's own where there is one, else the part of the eta that has passed."""
    if real is not None:
        return min(cap, real)
    return min(cap, elapsed / eta) if eta and eta > 0 else None


def with_ticks(events: DataFrame, every_ms: int = 5_000, cap: float = 0.99) -> DataFrame:
    """job_id, percent of jobs in `events` (EVENTS plus eta_seconds), each `every_ms` until a terminal or stage_completed event.

    The last stage_progress event's percent counts; before the first, the time since the first event against its eta.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            began, eta, real = state.get
            state.setTimeoutDuration(every_ms)
            value = tick_value(real, now / 1000 - began, eta, cap)
            if value is not None:
                yield pd.DataFrame({"job_id": [key[0]], "percent": [value]})
            return
        rows = in_order(frames, "ts", "event", "percent", "eta_seconds")
        if rows["event"].isin([*LAST_EVENTS, "stage_completed"]).any():
            if state.exists:
                state.remove()
            return
        began, eta, real = state.get if state.exists else (rows["ts"].iloc[0].timestamp(), None, None)
        etas, shares = rows["eta_seconds"].dropna(), rows.loc[rows["event"] == "stage_progress", "percent"].dropna()
        eta = float(etas.iloc[-1]) if len(etas) else eta
        real = float(shares.iloc[-1]) if len(shares) else real
        state.update((began, eta, real))
        state.setTimeoutDuration(every_ms)

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id string, percent double", "began double, eta double, real double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def wait(query: StreamingQuery, seconds: float) -> int:
    """0 if the query ended by itself, 1 if it failed, 2 if it still runs after so long; it is left running."""
    try:
        return 0 if query.awaitTermination(seconds) else 2
    except StreamingQueryException:
        return 1


def stage_board(events: DataFrame) -> DataFrame:
    """The last event of each stage, for an update sink that patches a board by (job_id, stage)."""
    last = F.max_by(F.struct("seq", "event", "percent"), "seq").alias("last")
    return events.filter(F.col("stage").isNotNull()).groupBy("job_id", "stage").agg(last).select("job_id", "stage", "last.*")


def daily(events: DataFrame, key: str, value: str, late: str = "1 day") -> DataFrame:
    """Counts and sums per key and day of an event stream."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("sum")).select(key, F.col("w.start").alias("day"), "n", "sum")

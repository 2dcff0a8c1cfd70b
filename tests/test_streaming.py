"""Streams over files of events, batch by batch, until all is read."""

import datetime
import time

import pytest

from cadenza.streaming import events as ev

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    def go(rows_by_batch, build, mode="append"):
        source = tmp_path / "in"
        for n, rows in enumerate(rows_by_batch):
            spark.createDataFrame([(j, s, T0 + datetime.timedelta(seconds=s), e, st, p) for j, s, e, st, p in rows], ev.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ev.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        name = f"out_{tmp_path.name.replace('-', '_')}"
        q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
        rows, until = sum(map(len, rows_by_batch)), time.monotonic() + 60
        try:  # a query with timers never runs out of batches
            while sum(p.numInputRows for p in q.recentProgress) < rows and q.isActive and time.monotonic() < until:
                time.sleep(0.2)
        finally:
            q.stop()
        return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]

    return go


def test_progress_never_falls_and_is_throttled(run):
    rows = [[("a", 0, "stage_progress", "tts", 0.5), ("a", 1, "stage_progress", "tts", 0.3), ("a", 2, "stage_progress", "tts", 0.51), ("a", 3, "stage_progress", "tts", 0.6), ("a", 4, "stage_progress", "tts", 1.0), ("b", 0, "job_started", None, None)]]
    assert sorted(run(rows, ev.emitted_progress)) == [("a", "tts", 0.5), ("a", "tts", 0.6), ("a", "tts", 1.0)]


def test_duplicates_go(run):
    rows = [[("a", 0, "job_started", None, None)], [("a", 0, "job_started", None, None), ("a", 1, "stream_end", None, None)]]
    assert sorted(r[:2] for r in run(rows, ev.deduplicated)) == [("a", 0), ("a", 1)]


def test_nothing_follows_a_terminal_event(run):
    rows = [[("a", 0, "job_started", None, None), ("a", 1, "job_completed", None, None), ("a", 2, "stage_progress", "mux", 0.1)]]
    assert [r for r in sorted(run(rows, ev.with_heartbeats)) if r[1] != "ping"] == [("a", "job_completed"), ("a", "job_started")]


def test_board_shows_the_last_event(run):
    rows = [[("a", 0, "stage_started", "tts", None), ("a", 1, "stage_completed", "tts", 1.0), ("a", 2, "stage_started", "mux", None)]]
    assert sorted(r[:4] for r in run(rows, ev.stage_board, "complete")) == [("a", "mux", 2, "stage_started"), ("a", "tts", 1, "stage_completed")]

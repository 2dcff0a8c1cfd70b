"""Progress files, event streams, caches, array dumps, large codebooks, hypotheses and timers against plain versions."""

import datetime
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import sse
from cadenza.operators import hypotheses, nearest, vectors
from cadenza.operators.ordered import Timeline
from cadenza.plans.streams import finished
from cadenza.sinks import published
from cadenza.sources import files, progress
from cadenza.streaming import events as ev
from cadenza.streaming import timers

# progress files


def write(folder, job, text):
    os.makedirs(f"{folder}/{job}", exist_ok=True)
    with open(f"{folder}/{job}/{progress.FILE}", "w") as f:
        f.write(text)


def doc(percent, phase="denoise"):
    return json.dumps({"phase": phase, "percent": percent, "timestamp": 1.5})


def test_progress_stream_survives_restarts_and_half_files(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("jobs", "out", "state"))
    os.makedirs(folder)

    def follow():
        q = progress.progress_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.job_id, r.percent) for r in spark.read.parquet(out).collect())

    write(folder, "a", doc(0.1))
    write(folder, "b", doc(0.2)[:15])
    write(folder, "c", '{"phase": 3}')
    write(folder, "d", "[1]")
    os.makedirs(f"{folder}/empty")
    assert follow() == [("a", 0.1)]
    time.sleep(0.02)
    write(folder, "a", doc(0.3))
    write(folder, "a", doc(0.4))  # only what stands is seen
    write(folder, "b", doc(0.5))
    assert follow() == [("a", 0.1), ("a", 0.4), ("b", 0.5)]
    assert follow() == [("a", 0.1), ("a", 0.4), ("b", 0.5)]  # nothing changed
    last = progress.latest_progress(spark.read.parquet(out))
    assert sorted(map(tuple, last.collect())) == [("a", "denoise", 0.4), ("b", "denoise", 0.5)]
    assert sorted((r.job_id, r.percent) for r in progress.progress(spark, folder).collect()) == [("a", 0.4), ("b", 0.5)]
    assert progress.progress(spark, str(tmp_path / "none")).count() == 0


def test_progress_is_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x", 0.1), ("a", 3, "y", 0.9), ("a", 2, "x", 0.5), ("b", 1, None, 0.2)], "job_id string, seq long, phase string, percent double")
    for _ in range(2):
        progress.overwrite_progress(rows, str(tmp_path), "seq")
    assert sorted((r.job_id, r.phase, r.percent) for r in progress.progress(spark, str(tmp_path)).collect()) == [("a", "y", 0.9), ("b", None, 0.2)]
    assert sorted(os.listdir(tmp_path / "a")) == [progress.FILE]
    with pytest.raises(Exception, match="no job name"):
        progress.overwrite_progress(rows.withColumn("job_id", F.lit("../x")), str(tmp_path), "seq")


# server-sent events

WIRE = "﻿id: 1\nevent: stage_progress\ndata: {\"p\": 1}\n\n: ping\n\ndata:two\r\ndata: lines é\r\n\r\nevent: lost\n\nid\ndata\n\nid: a\0b\rdata: cr\r\rretry: 5\nother: x\ndata:  two spaces\n\ndata: never ended".encode()
WANT = [("1", "stage_progress", '{"p": 1}'), ("1", "message", "two\nlines é"), ("", "message", ""), ("", "message", "cr"), ("", "message", " two spaces")]


def test_events_are_the_same_in_any_pieces():
    assert list(sse.Parser().feed(WIRE)) == WANT
    for cut in range(len(WIRE) + 1):
        parser = sse.Parser()
        got = list(parser.feed(WIRE[:cut]))
        got += list(parser.feed(b""))
        got += list(sse.Parser(parser.state()).feed(WIRE[cut:]))  # as from a state store
        assert got == WANT, cut
    parser = sse.Parser()
    assert [e for b in WIRE for e in parser.feed(bytes([b]))] == WANT


@pytest.mark.parametrize("size", [1, 5, 1_000])
def test_frames_are_parsed_back(spark, size):
    sent = [(1, "job_started", '{"a": 1}'), (2, None, "two\nlines\r\nthree"), (3, "bad\nname", ""), (4, "ping", None)]
    rows = spark.createDataFrame(sent, "id long, event string, data string")
    wire = "".join(r.f for r in rows.select("id", sse.frame(F.col("event"), F.col("data"), F.col("id")).alias("f")).orderBy("id").collect()).encode()
    chunks = spark.createDataFrame([(k, i, wire[i : i + size]) for k in ("x", None) for i in range(0, len(wire), size)] + [("x", -1, None)], "conn string, at long, chunk binary")
    got = sorted((r.conn or "", r.n, r.id, r.event, r.data) for r in sse.parsed(chunks, ("conn",), "at", "chunk").collect())
    want = [(0, "1", "job_started", '{"a": 1}'), (1, "2", "message", "two\nlines\nthree"), (2, "3", "bad name", ""), (3, "4", "ping", "")]
    assert got == sorted((k, *w) for k in ("x", "") for w in want)
    assert sse.parsed(chunks.limit(0), ("conn",), "at", "chunk").count() == 0


# caches and dumps


def test_cache_commits_or_leaves_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "key string, value long"
    held = lambda: sorted(map(tuple, published.published(spark, path, "key", schema).collect()))
    assert held() == []
    rows = lambda *r: spark.createDataFrame(list(r), schema).repartition(3)
    assert published.publish(rows(("a", 1), ("b", 2), ("c", None)), path)
    assert held() == [("a", 1), ("b", 2)]
    dying = rows(*[(k, i) for i, k in enumerate("abcdefgh")]).withColumn("value", F.when(F.col("key") == "h", F.raise_error(F.lit("dies"))).otherwise(F.col("value") + 100))
    staged = len(os.listdir(f"{path}/staged"))
    assert not published.publish(dying, path)
    assert held() == [("a", 1), ("b", 2)] and len(os.listdir(f"{path}/commits")) == 1
    with open(f"{path}/staged/killed.parquet", "wb") as f:  # what a killed process leaves is in no manifest
        f.write(open(f"{path}/staged/{sorted(os.listdir(f'{path}/staged'))[0]}", "rb").read())
    assert published.publish(rows(("b", 3), ("d", 4)), path)
    assert held() == [("a", 1), ("b", 3), ("d", 4)] and staged
    with pytest.raises(Exception, match="dies"):
        published.publish(dying, path, best_effort=False)


def test_array_dumps(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {(f, n): rng.normal(size=(rows, width)) for (f, n), rows, width in zip([(f, n) for f in ("j1", "j2") for n in files.DUMPS], range(1, 9), [6, 6, 4, 4] * 2)}
    rows = [(f, n, i, [float(x) for x in v]) for (f, n), a in made.items() for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "folder string, name string, idx long, values array<double>").repartition(5)
    published.dump_arrays(df, str(tmp_path))
    for (f, n), a in made.items():
        assert np.array_equal(np.load(tmp_path / f / f"{n}.npy"), a)
    back = {(r.folder.split("/")[-1], r["name"], r.idx): r["values"] for r in files.arrays(spark, str(tmp_path)).collect()}
    assert back == {(f, n, i): v for f, n, i, v in rows}
    uneven = df.unionByName(spark.createDataFrame([("j3", "x", 0, [1.0]), ("j3", "x", 1, [1.0, 2.0])], df.schema))
    with pytest.raises(Exception, match="rows of"):
        published.dump_arrays(uneven, str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*.npy") if "staged" not in str(p)]


def test_subtitle_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1_500, 2_000, " one --> two "), ("a", 0, 1_500, "first"), ("b", 3_600_000, 3_601_001, None)], "f string, s long, e long, t string").repartition(3)
    published.subtitle_files(rows, str(tmp_path), "f", "s", "e", "t")
    read = lambda n: (tmp_path / n).read_text()
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["a.srt", "a.txt", "a.vtt", "b.srt", "b.txt", "b.vtt"]
    assert read("a.txt") == "first\none --> two\n" and read("b.txt") == "\n"
    assert read("a.vtt") == "WEBVTT\n\n00:00.000 --> 00:01.500\nfirst\n\n00:01.500 --> 00:02.000\none -> two\n\n"
    assert read("b.srt") == "1\n01:00:00,000 --> 01:00:01,001\n\n\n"


def test_ladder(spark):
    assert hypotheses.temperature_ladder() == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0]) and hypotheses.temperature_ladder(0.3, None) == [0.3]
    rows = [("a", 0.0, 3.0, -0.5, 0.1), ("a", 0.2, 2.0, -0.5, 0.1), ("a", 0.4, 1.0, -0.1, 0.1), ("b", 0.0, 1.0, -2.0, 0.9), ("b", 0.2, 1.0, -1.5, 0.7), ("c", 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "k string, t double, r double, p double, q double")
    got = {x.k: (x.t, x.failed, x.silent) for x in hypotheses.accepted(df, ["k"], "t", "r", "p", "q").collect()}
    assert got == {"a": (0.2, False, False), "b": (0.2, True, True), "c": (0.0, False, False)}
    assert {x.k: x.t for x in hypotheses.accepted(df, ["k"], "t", "r", "p", "q", None, None, None).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


# codebooks


@pytest.mark.parametrize("pivots, block", [(1, 5), (7, 5), (60, 2_048)])
def test_nearest_by_pivots(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearest, "SHARE_ROWS", 50)
    rng = np.random.default_rng(pivots)
    book = np.round(rng.normal(size=(60, 3)) * 4) / 4  # on a grid, so that there are ties
    asked = np.round(rng.normal(size=(200, 3)) * 4) / 4
    codes = spark.createDataFrame([(i * 3, [float(x) for x in v]) for i, v in enumerate(book)] + [(999, None)], "code int, v array<double>").repartition(4)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)] + [(-1, None)], "id long, v array<double>").repartition(4)
    d = ((asked[:, None] - book[None]) ** 2).sum(axis=2)
    want = {i: int(a) * 3 for i, a in enumerate(d.argmin(axis=1))} | {-1: None}
    assert {r.id: r.code for r in nearest.nearest_by_pivots(rows, codes, "id", "code", "v", pivots).collect()} == want
    monkeypatch.setattr(vectors, "CODEBOOK_ROWS", 10)
    assert {r.id: r.code for r in vectors.nearest_code(rows, codes, "id", "code", "v").collect()} == want
    assert {r.code for r in nearest.nearest_by_pivots(rows, codes.limit(0), "id", "code", "v").collect()} == {None}
    assert nearest.nearest_by_pivots(rows.limit(0), codes, "id", "code", "v", pivots).count() == 0


# hypotheses and token rules


def plain_beam(steps, width, pool, end):
    """Every candidate in one list, sorted whole."""
    live, ended = [((), 0.0)] * width, []
    for scores in steps:
        found = {}
        for b, (tokens, total) in enumerate(live):
            own = sorted([(-p, t) for bb, t, p in scores if bb == b and p is not None])[: width + 1]
            for p, t in own:
                found[tokens + (t,)] = total - p
        order = [t for t, _ in sorted(found.items(), key=lambda x: -x[1])]
        keep = [t for t in order if t[-1] != end][:width]
        last = order.index(keep[-1]) if len(keep) == width else len(order)
        for t in order[:last]:
            if t[-1] == end and len(ended) < pool:
                ended.append((t, found[t], True))
        live = [(t, found[t]) for t in keep]
    spare = sorted(range(len(live)), key=lambda i: (-live[i][1], -i))
    while len(ended) < width and spare:
        tokens, total = live[spare.pop(0)]
        ended.append((tokens + (end,), total, False))
    return ended


@pytest.mark.parametrize("patience", [1.0, 2.0])
def test_hypotheses(spark, patience):
    rng = np.random.default_rng(9)
    rows = [(s, k, b, t, float(np.round(rng.normal() - 2, 2))) for s in ("x", "y", "z") for k in range(5) for b in range(3) for t in range(6) if rng.random() < 0.8] + [("n", 0, 0, 1, None), ("n", 0, 0, 2, -1.0)]
    df = spark.createDataFrame(rows, "s string, step int, beam int, token long, p double").repartition(3)
    got = {}
    for r in hypotheses.selected(df, "s", "step", "beam", "token", "p", 3, 0, patience).orderBy("s", "rank").collect():
        got.setdefault(r.s, []).append((tuple(r.tokens), pytest.approx(r.sum_logprob), r.ended))
    for s in ("x", "y", "z", "n"):
        steps = [[(b, t, p) for ss, k, b, t, p in rows if ss == s and k == at] for at in sorted({k for ss, k, *_ in rows if ss == s})]
        assert got[s] == plain_beam(steps, 3, round(3 * patience), 0)
    assert hypotheses.selected(df.limit(0), "s", "step", "beam", "token", "p", 3, 0).count() == 0


@pytest.mark.parametrize("width", [1, 3, 1_000])
def test_timestamp_masks(spark, width):
    rng = np.random.default_rng(4)
    tokens = {k: [int(t) for t in rng.choice([5, 10, 50, 60, 61, 99], n)] for k, n in (("a", 40), ("b", 1), ("c", 2), ("d", 11))}
    df = spark.createDataFrame([(k, 2 * i, t) for k, ts in tokens.items() for i, t in enumerate(ts)], "k string, pos long, token int").repartition(3)
    got = hypotheses.timestamp_masks(df, Timeline(("k",), ("pos",), width), "token", 60, 50).collect()
    assert len(got) == sum(map(len, tokens.values()))
    for r in got:
        before = tokens[r.k][: r.idx]
        last, pair = bool(before) and before[-1] >= 60, len(before) < 2 or before[-2] >= 60
        assert (r.pos, r.timestamps_masked, r.text_masked) == (2 * r.idx, last and pair, last and not pair)


# timers

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def streamed(spark, tmp_path, batches, build):
    source = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame([(j, s, T0 + datetime.timedelta(seconds=at), e, None, p, eta) for j, s, at, e, p, eta in rows], ev.EVENTS + ", eta_seconds double").coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema(ev.EVENTS + ", eta_seconds double").option("maxFilesPerTrigger", 1).parquet(str(source))
    with timers.state_store(spark):
        got = finished(build(stream), "timers").collect()
    return sorted((r.job_id, (r.at_ms - int(T0.timestamp() * 1000)) // 1000, r[1] if "event" in r else r.percent) for r in got)


ROWS = [("a", 0, 0, "job_started", None, None), ("a", 1, 25, "stage_progress", 0.5, None), ("b", 0, 3, "job_started", None, 100.0), ("a", 2, 26, "job_completed", None, None), ("a", 3, 50, "late", None, None), ("c", 0, 60, "job_started", None, None), ("b", 1, 60, "stage_progress", 0.995, None)]


@pytest.mark.parametrize("cuts", [[7], [2, 7], [1, 2, 3, 4, 7]])
def test_heartbeats_by_event_time(spark, tmp_path, cuts):
    batches = [ROWS[a:b] for a, b in zip([0, *cuts], cuts)]
    got = streamed(spark, tmp_path, batches, lambda s: timers.with_heartbeats(s, 10_000))
    events = [("a", 0, "job_started"), ("a", 25, "stage_progress"), ("a", 26, "job_completed"), ("b", 3, "job_started"), ("b", 60, "stage_progress"), ("c", 60, "job_started")]
    assert got == sorted(events + [("a", 10, "ping"), ("a", 20, "ping")] + [("b", t, "ping") for t in (13, 23, 33, 43, 53)])


@pytest.mark.parametrize("cuts", [[7], [1, 2, 3, 4, 7]])
def test_ticks_by_event_time(spark, tmp_path, cuts):
    batches = [ROWS[a:b] for a, b in zip([0, *cuts], cuts)]
    got = streamed(spark, tmp_path, batches, lambda s: timers.with_ticks(s, 20_000))
    assert got == [("b", 23, 0.2), ("b", 43, 0.4)]

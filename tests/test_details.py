"""Index arithmetic, recurrences, gates and messages against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from cadenza.functions import signal, text
from cadenza.operators import faces, gather, jobs, routing, series
from cadenza.operators.ordered import Timeline


def test_slices_are_those_of_a_list(spark):
    bounds, steps = [None, -9, -3, -1, 0, 1, 2, 5, 9], [-3, -1, 1, 2]
    rows = [(i, n, a, z, s) for i, (n, a, z, s) in enumerate(itertools.product([0, 1, 5], bounds, bounds, steps))]
    df = spark.createDataFrame(rows, "i int, n long, a long, z long, s long")
    got = {i: [] for i, *_ in rows}
    for r in gather.slice_indexes(df, F.col("a"), F.col("z"), F.col("s"), "at").orderBy("i", F.when(F.col("s") > 0, F.col("at")).otherwise(-F.col("at"))).collect():
        got[r.i].append(r["at"])
    assert got == {i: list(range(*slice(a, z, s).indices(n))) for i, n, a, z, s in rows}


def test_negative_index(spark):
    features = spark.createDataFrame([("a", i, i * 10) for i in range(4)], "k string, idx long, v long")
    asked = spark.createDataFrame([("a", 4, i) for i in (-5, -4, -1, 0, 3, 4)], "k string, n long, idx long")
    got = {r.asked: (r.ok, r.v) for r in gather.at_index(asked, features, ("k",), "idx").collect()}
    assert got == {-5: (False, None), -4: (True, 0), -1: (True, 30), 0: (True, 0), 3: (True, 30), 4: (False, None)}


def test_triples(spark):
    rows = [(k, i, float((i * 7 + len(k)) % 5)) for k in ("a", "bb") for i in range(9)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(3)
    line = Timeline(("k",), ("i",), 4)
    for r in series.triples(df, line, "x").collect():
        own = {i: x for k, i, x in rows if k == r.k}
        assert (r.before, r.after) == (own.get(r.i - 1), own.get(r.i + 1))


def test_pads_trims_and_joins(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 5, 9.0), ("b", 1, 4.0)], "k string, i long, x double")
    assert sorted(map(tuple, series.padded(df, ("k",), "i", "x", 3).collect())) == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 0.0), ("b", 0, 0.0), ("b", 1, 4.0), ("b", 2, 0.0)]
    chunks = spark.createDataFrame([("a", 2, 0), ("a", 0, 1), ("a", 0, 0), ("a", 2, 1), ("a", 1, 0)], "k string, chunk long, pos long")
    assert {(r.chunk, r.pos): r["at"] for r in series.joined_chunks(chunks, ("k",), "chunk", "pos").collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 2, (2, 0): 3, (2, 1): 4}


def test_gates(spark):
    rows = [(True, "running", True), (True, "completed", True), (True, "running", False), (None, None, None), (True, None, True), (False, "running", True)]
    df = spark.createDataFrame(rows, "known boolean, status string, live boolean")
    assert [r[0] for r in df.select(jobs.cancel_outcome(F.col("known"), F.col("status"), F.col("live"))).collect()] == [200, 409, 404, 404, 200, 404]
    shown = spark.createDataFrame([("completed", "done", "a.mp4"), ("completed", "done", ""), ("completed", None, "a"), ("failed", "done", "a")], "s string, m string, p string")
    assert [r[0] for r in shown.select(jobs.result_path(F.col("s"), F.col("m"), F.col("p"))).collect()] == ["a.mp4", None, None, None]
    flags = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "k string, ok boolean")
    assert dict(map(tuple, jobs.all_ok(flags, ("k",), F.col("ok")).collect())) == {"a": False, "b": True}


def test_messages_and_numbers(spark):
    one = spark.range(1)
    said = lambda status, body: one.select(text.http_message(F.lit(status), F.lit(body))).first()[0]
    assert said(422, '{"detail": {"error": "no face"}}') == "could not process the clip: no face"
    assert said(400, '{"detail": "bad size"}') == "rejected request: bad size" and said(418, "teapot") == "failed (HTTP 418): teapot"
    assert said(501, '{"detail": {"message": "soon", "phase": "two"}}') == "not implemented (two): soon"
    assert one.select(text.utc_iso(F.lit(1_700_000_000_000_000))).first()[0] == "2023-11-14T22:13:20+00:00"
    with pytest.raises(Exception, match="no whole ratio"):
        one.select(signal.whole_ratio(F.lit(7), F.lit(2))).collect()
    assert [one.select(routing.held_number(F.lit(x), 0.02, 0.3, 0.04)).first()[0] for x in (" 0.5 ", "0.001", "x", None)] == [0.3, 0.02, 0.04, 0.04]
    assert one.select(signal.frame_padding(F.lit(1_000), 800, 200)).first()[0] == (600, 600)


def test_faces(spark):
    boxes = [("f", 0, (0, 0, 2, 2)), ("f", 1, (0, 0, 4, 1)), ("f", 2, (0, 0, 1, 1)), ("g", 0, (5, 5, 5, 9)), ("h", 0, None)]
    df = spark.createDataFrame(boxes, "frame string, pos int, box struct<x1:int,y1:int,x2:int,y2:int>")
    assert dict(map(tuple, faces.largest(df, ("frame",), "pos", F.col("box")).collect())) == {"f": 0, "g": 0, "h": None}
    assert [r[0] for r in df.orderBy("frame", "pos").select(faces.active(F.col("box"))).collect()] == [True, True, True, False, False]
    points = spark.createDataFrame([(1, i, float(i), float(-i)) for i in range(106)], "frame int, landmark long, x double, y double")
    got = {r.anchor: (r.x, r.y) for r in faces.anchors(points, ("frame",), "landmark", faces.ANCHORS).collect()}
    assert got["left_eye"] == pytest.approx((48.2, -48.2)) and got["right_eye"] == pytest.approx((103.0, -103.0)) and got["nose"] == pytest.approx((80.0, -80.0))

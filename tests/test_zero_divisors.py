"""Divisors that are 0, null or NaN give a value or null, never an error."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.functions import signal
from cadenza.operators import vectors

NAN = float("nan")
DIVIDED = {
    "face": (lambda a, b: signal.face_ok(a, b, F.lit(0.9)), {(60.0, 0.0): False, (60.0, 100.0): True, (60.0, None): None, (60.0, 300.0): True, (50.0, 260.0): False}),
    "length": (signal.length_normalised, {(-3.0, 0.0): None, (-3.0, 2.0): -1.5, (-3.0, None): None}),
    "alpha": (lambda a, b: signal.length_normalised(a, b, 1.0), {(-3.0, -5.0): None, (-3.0, 1.0): -3.0}),
    "clip": (signal.clip_seconds, {(50.0, 0.0): None, (50.0, 25.0): 2.0, (50.0, NAN): NAN}),
    "stretch": (lambda a, b: signal.stretch(b, a), {(1.0, 0.0): None, (9.0, 10.0): 0.9, (1.0, 10.0): None}),
    "sample": (lambda a, b: signal.unnoised(a, F.lit(0.5), b), {(0.5, 0.0): None, (0.5, 1.0): 0.5}),
}


@pytest.mark.parametrize("name", sorted(DIVIDED))
def test_divisors(spark, name):
    of, cases = DIVIDED[name]
    rows = spark.createDataFrame([(i, *pair) for i, pair in enumerate(cases)], "i int, a double, b double")
    got = {r.i: r.v for r in rows.select("i", of(F.col("a"), F.col("b")).alias("v")).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == want or isinstance(want, float) and (math.isnan(want) and math.isnan(got[i]) or got[i] == pytest.approx(want))


def test_zero_vectors(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, None)], "id int, v array<double>")
    got = {r.id: r.u for r in rows.select("id", vectors.unit(F.col("v")).alias("u")).collect()}
    assert got == {0: [None, None], 1: [0.6, 0.8], 2: None}
    codes = spark.createDataFrame([(7, [0.0, 0.0]), (8, [3.0, 4.0]), (9, [-3.0, -4.0])], "code int, v array<double>")
    top = vectors.cosine_top(rows.filter("id < 2"), codes, "id", "code", "v", 2)
    assert sorted((r.id, r.rank, r.code) for r in top.collect()) == [(0, 1, 7), (0, 2, 8), (1, 1, 8), (1, 2, 7)]

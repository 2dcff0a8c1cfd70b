"""Recurrences and throttles cut into any slices against plain loops."""

import numpy as np
import pytest

from cadenza.operators import scans

RNG = np.random.default_rng(5)
SIGNAL = [(k, i, float(x)) for k, n in (("a", 1_000), ("b", 1), ("c", 130)) for i, x in enumerate(RNG.normal(size=n))] + [(None, i, 1.0) for i in range(3)]


def plain_recurrence(xs, decay, gain, first_gain):
    out = []
    for x in xs:
        out.append(gain * x + decay * out[-1] if out else first_gain * x)
    return out


@pytest.mark.parametrize("width", [1, 143, 100_000])
@pytest.mark.parametrize("decay, gain, first_gain", [(0.97, 1.0, 1.0), (0.2, 0.8, 1.0), (0.0, 2.0, 1.0), (-1.0, 0.5, 3.0)])
def test_recurrence(spark, width, decay, gain, first_gain):
    """Slices of 1, 7 and 1,000 a key, and one of all."""
    df = spark.createDataFrame(SIGNAL, "k string, i long, x double").repartition(5)
    got = {(r.k, r.i): r.y for r in scans.recurrence(df, ("k",), "i", "x", "y", decay, gain, first_gain, width).collect()}
    for k in ("a", "b", "c", None):
        for i, y in enumerate(plain_recurrence([x for kk, _, x in SIGNAL if kk == k], decay, gain, first_gain)):
            assert got.pop((k, i)) == pytest.approx(y, abs=1e-9)
    assert not got and scans.recurrence(df.limit(0), ("k",), "i", "x", "y", 0.5).count() == 0


def plain_progress(values, step=0.02):
    seen = last = 0.0
    out = []
    for i, p in enumerate(values):
        if p is None:
            continue
        p = min(1.0, max(0.0, p))
        if p >= seen:
            seen = p
            if p - last >= step or p >= 1.0:
                last = p
                out.append((i, p))
    return out


def progress():
    """Noisy, dense, coarse, falling, repeated, complete and null shares; hundredths, whose differences are not exact."""
    yield "noisy", [round(float(v), 3) for v in np.sort(RNG.random(700)) + RNG.normal(0, 0.05, 700)]
    yield "dense", [float(v) for v in np.sort(RNG.random(1_000))]
    yield "hundredths", [i / 100 for i in range(101)]
    yield "sums", [float(v) for v in np.cumsum(np.full(120, 0.01))]
    yield "falling", [1 - i / 50 for i in range(50)]
    yield "ends", [0.5, 0.5, 1.0, 0.9, 1.0, 2.0, None, -3.0, 1.0]
    yield None, [0.3, None, 0.31, 0.32, 0.319, 0.34]
    yield "nothing", [None, 0.0, 0.01, 0.019]
    yield "ulp", [0.02, 0.06 - 0.02, 0.04, 0.06, np.nextafter(0.06, 1), 0.08]


@pytest.mark.parametrize("width, long_key", [(1, 1_000_000), (143, 1_000_000), (100_000, 1_000_000), (143, 0), (143, 40)])
def test_throttled(spark, width, long_key):
    """In slices of 1, 143 and all; no key, every key and only the larger ones by their pointers."""
    keys = {k: vs for k, vs in progress()}
    df = spark.createDataFrame([(k, i, None if v is None else float(v)) for k, vs in keys.items() for i, v in enumerate(vs)], "k string, i long, v double").repartition(4)
    got = scans.throttled(df, ("k",), "i", "v", width=width, long_key=long_key).collect()
    assert {k: sorted((r.i, r.emitted) for r in got if r.k == k) for k in keys} == {k: plain_progress(vs) for k, vs in keys.items()}
    assert scans.throttled(df.limit(0), ("k",), "i", "v").count() == 0


def test_goals_are_the_least():
    v = np.concatenate([np.arange(100) / 100, RNG.random(1_000)])
    g = scans.goals(v, 0.02)
    assert (g - v >= 0.02).all() and (np.nextafter(g, 0) - v < 0.02).all()

"""One pass over slices against the single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import jobs, ordered
from cadenza.operators.ordered import Timeline


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    some = lambda: None if rng.random() < 0.4 else float(rng.integers(0, 9))
    made = [(k, int(at), i, some(), some() if k != "c" else None, str(rng.integers(0, 3))) for k, n in (("a", 60), ("b", 1), ("c", 20), (None, 7)) for i, at in enumerate(np.sort(rng.integers(0, 40, n)))]
    return spark.createDataFrame(made, "k string, at long, i long, x double, y double, s string").repartition(5)


@pytest.mark.parametrize("width", [1, 7, 1_000])
def test_framed_is_all_at_once(rows, width):
    t = Timeline(("k",), ("at", "i"), width)
    got = ordered.framed(rows, t, "idx", ("x", "y"), "n", {"px": "x", "ps": "s"})
    want = ordered.previous(ordered.counted(ordered.filled(ordered.numbered(rows, t), t, ["x", "y"]), t), t, {"px": "x", "ps": "s"})
    order = ["k", "at", "i"]
    assert got.orderBy(*order).select(want.columns).collect() == want.orderBy(*order).collect()
    assert ordered.framed(rows.limit(0), t).count() == 0


@pytest.mark.parametrize("width", [1, 7, 1_000])
def test_stage_elapsed(rows, width):
    t = Timeline(("k",), ("at", "i"), width)
    got = {(r.k, r.i): r.elapsed for r in jobs.stage_elapsed(rows, t, "s", "at").collect()}
    seen = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k or "", r["at"], r.i)):
        stage, start = seen.get(r.k, (None, None))
        seen[r.k] = (r.s, r["at"] if stage != r.s else start)
        assert got[r.k, r.i] == r["at"] - seen[r.k][1]


def test_running_max(rows):
    t = Timeline(("k",), ("at", "i"), 7)
    got = {(r.k, r.i): r.top for r in ordered.running_max(rows, t, {"top": F.col("x")}).collect()}
    best = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k or "", r["at"], r.i)):
        assert got[r.k, r.i] == best.get(r.k)
        best[r.k] = max([v for v in (best.get(r.k), r.x) if v is not None], default=None)

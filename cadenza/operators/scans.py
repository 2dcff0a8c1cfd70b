"""Scans whose every value needs the one before, over keys that may be longer than a task.

A linear recurrence is an affine map, and maps compose: each slice of a key is reduced to one pair of numbers, the pairs are run
through in order, and each slice is then worked on from its own start. A throttle has no such small map; what it may send is sorted out
slice by slice, and of keys that still hold very much, a chain of "the first value far enough on" pointers is followed by doubling.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import KEY, SLICE, Timeline, last_known, running_max, sliced
from .shared import cut

BLOCK = 64


def affine(u: np.ndarray, start: float, decay: float) -> np.ndarray:
    """y[t] = u[t] + decay * y[t - 1] with y[-1] = `start`, a block at a time."""
    n = len(u)
    blocks = np.zeros((-(-n // BLOCK), BLOCK))
    blocks.ravel()[:n] = u
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    own = blocks @ np.where(lag >= 0, float(decay) ** np.maximum(lag, 0), 0.0).T
    starts, whole = np.empty(len(blocks)), float(decay) ** BLOCK
    for b, last in enumerate(own[:, -1]):
        starts[b] = start
        start = last + whole * start
    return (own + np.outer(starts, float(decay) ** np.arange(1, BLOCK + 1))).ravel()[:n]


def _runs(frames: Iterable[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The stretches of equal `by` values in sorted frames; a stretch may come in several parts."""
    for pdf in frames:
        if len(pdf):
            other = np.zeros(len(pdf), bool)
            for c in by:
                v, before = pdf[c], pdf[c].shift()
                other |= ~((v == before) | (v.isna() & before.isna())).to_numpy(bool)
            other[0] = True
            cuts = [*np.flatnonzero(other), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                yield tuple(None if pd.isna(x) else x for x in part[by].iloc[0]), part


def recurrence(df: DataFrame, keys: tuple[str, ...], idx: str, value: str, out: str, decay: float, gain: float = 1.0, first_gain: float = 1.0, width: int = 65_536) -> DataFrame:
    """keys, idx, out: y[t] = gain * x[t] + decay * y[t - 1] in the order of `idx`, and first_gain * x[t] where a key starts.

    With decay = factor and gain = 1 it undoes pre-emphasis; with 0.2 and 0.8 it smooths a bias. Values are not null and `idx` is a
    whole number, of which `width` make a slice; a task holds a batch of rows and one number. A row is read twice: once for what
    its slice adds, once to work from the slice's start.
    """
    by = [*keys, SLICE]
    rows = sliced(df.select(*keys, idx, F.col(value).cast("double").alias(value)), Timeline(keys, (idx,), width)).drop(KEY)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(by, n, x0, tail) of each slice: tail is what it leaves when it starts from 0."""
        done, now = [], None
        for key, part in _runs(frames, by):
            x = part[value].to_numpy(float)
            if now is None or now[0] != key:
                if now:
                    done.append((*now[0], *now[1:]))
                now = [key, 0, float(x[0]), 0.0]
            now[1:] = now[1] + len(x), now[2], float(affine(gain * x, now[3], decay)[-1])
        yield pd.DataFrame(done + ([(*now[0], *now[1:])] if now else []), columns=[*by, "n", "x0", "tail"])

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(by, start, first): the value before each slice; a key's first slice has none."""
        key, y = None, 0.0
        for pdf in frames:
            told = []
            for *k, s, n, x0, tail in pdf[[*by, "n", "x0", "tail"]].itertuples(index=False):
                k = [None if pd.isna(x) else x for x in k]
                first = k != key
                told.append((*k, s, 0.0 if first else y, first))
                y = tail + (decay ** (n - 1) * (first_gain - gain) * x0 if first else decay**n * y)
                key = k
            yield pd.DataFrame(told, columns=[*by, "start", "first"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, first = 0.0, False
        for _, part in _runs(frames, by):
            told = part["start"].notna().to_numpy()
            if told[0]:
                y, first = float(part["start"].iloc[0]), bool(part["first"].iloc[0])
                part = part.iloc[1:]
            if len(part):
                u = gain * part[value].to_numpy(float)
                if first:
                    u[0], first = first_gain * part[value].iloc[0], False
                done = affine(u, y, decay)
                y = float(done[-1])
                yield part[[*keys, idx]].assign(**{out: done})

    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, idx)
    summed = dealt.mapInPandas(ends, f"{key_types}, n long, x0 double, tail double")
    begun = summed.repartition(*keys).sortWithinPartitions(*by).mapInPandas(starts, f"{key_types}, start double, first boolean")
    both = rows.withColumns({"start": F.lit(None).cast("double"), "first": F.lit(None).cast("boolean")}).unionByName(begun, allowMissingColumns=True)
    together = both.repartition(*by).sortWithinPartitions(*by, F.col("start").isNull(), idx)  # a slice's start comes before its rows
    return together.mapInPandas(run, rows.select(*keys, idx, F.col(value).alias(out)).schema)


def goals(values: np.ndarray, step: float) -> np.ndarray:
    """The smallest number of which each value is `step` or more below, as floating point says it."""
    goal = values + step
    while (far := np.nextafter(goal, 0) - values >= step).any():
        goal = np.where(far, np.nextafter(goal, 0), goal)
    while (near := goal - values < step).any():
        goal = np.where(near, np.nextafter(goal, np.inf), goal)
    return goal


def throttled(df: DataFrame, keys: tuple[str, ...], seq: str, value: str, step: float = 0.02, width: int = 65_536, long_key: int = 1_000_000) -> DataFrame:
    """keys, seq, emitted: the progress values that are sent on: never falling, `step` apart, or 1.

    Values are held to 0..1, null ones pass by. Only a value as large as all before it can be sent, and of equal ones below 1 the first,
    so these are sorted out first, slice by slice; `seq` is a whole number, of which `width` make a slice. Those of a key are then run
    through in order, or, of keys with over `long_key` different ones, found by `chained`; the result is the same.
    """
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value).cast("double")))
    held = df.filter(F.col(value).isNotNull()).select(*keys, F.col(seq), p.alias("emitted"))
    high = running_max(held, Timeline(keys, (seq,), width), {"_top": F.col("emitted")}).filter(F.col("emitted") >= F.coalesce("_top", F.lit(0.0))).drop("_top")
    rows = high.groupBy(*keys, "emitted", F.when(F.col("emitted") >= 1, F.col(seq)).alias("_each")).agg(F.min(seq).alias(seq)).filter(F.col("emitted") >= step).select(*held.columns)
    rows = cut(rows)
    full, parts = rows.filter("emitted >= 1"), rows.filter("emitted < 1")
    long = parts.groupBy(F.struct(*keys).alias(KEY)).agg(F.count("*").alias("_n")).filter(F.col("_n") > long_key).select(KEY)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0.0
        for pdf in frames:
            keep = []
            for *k, v in pdf[[*keys, "emitted"]].itertuples(index=False):
                k = [None if pd.isna(x) else x for x in k]
                if k != key:
                    key, last = k, 0.0
                ok = v - last >= step
                last = v if ok else last
                keep.append(ok)
            yield pdf[keep]

    def folded(some: DataFrame) -> DataFrame:
        return some.repartition(*keys).sortWithinPartitions(*keys, "emitted").mapInPandas(run, some.schema)

    if long.isEmpty():
        return full.unionByName(folded(parts))
    keyed = parts.withColumn(KEY, F.struct(*keys))
    return full.unionByName(folded(keyed.join(long, KEY, "left_anti").select(*held.columns))).unionByName(chained(keyed.join(long, KEY, "left_semi").select(*held.columns), keys, step))


def chained(parts: DataFrame, keys: tuple[str, ...], step: float) -> DataFrame:
    """The rows of `parts` (keys and different values `emitted` from `step` to 1) that a throttle sends, no key read by one task.

    From each value the next one sent would be the smallest that is `step` larger: a pointer by an ordered look-up. Those that the
    first one leads to are found by doubling the pointers, in log2 of 1 / step rounds, with rows dealt by key and value.
    """

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("emitted").to_numpy(zero_copy_only=False)
            bits = [pa.array(x.astype(np.float64).view(np.int64)) for x in (v, goals(v, step))]  # of positive numbers, in their order
            yield pa.RecordBatch.from_arrays([*batch.columns, *bits], [*batch.schema.names, "_v", "_goal"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    nodes = cut(parts.mapInArrow(pointed, f"{schema}, _v long, _goal long"))
    own = [F.col(k) for k in keys]
    stands = nodes.select(*own, (-F.col("_v")).alias("_back"), F.lit(0).alias("_kind"), F.col("_v").alias("_node"), F.lit(None).cast("long").alias("_from"))
    asks = nodes.select(*own, (-F.col("_goal")).alias("_back"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_node"), F.col("_v").alias("_from"))
    met = last_known(stands.unionByName(asks), Timeline(keys, ("_back", "_kind"), 1 << 46), {"_next": F.col("_node")}).filter("_kind = 1")
    first = nodes.groupBy(F.struct(*keys).alias(KEY)).agg(F.min("_v").alias("_first"))
    links = met.select(F.struct(*keys).alias(KEY), F.col("_from").alias("_v"), "_next").join(first, KEY)
    links = cut(links.select(KEY, "_v", "_next", (F.col("_v") == F.col("_first")).alias("_on")))
    for _ in range(math.ceil(math.log2(1 / step + 2))):
        if links.filter("_next is not null").isEmpty():
            break
        ahead = links.select(KEY, F.col("_v").alias("_next"), F.col("_next").alias("_far"))
        twice = links.join(ahead, [KEY, "_next"], "left").select(KEY, "_v", F.col("_far").alias("_next"), "_on")
        led = links.filter("_on and _next is not null").select(KEY, F.col("_next").alias("_v"), F.lit(None).cast("long").alias("_next"), "_on")
        links = cut(twice.unionByName(led).groupBy(KEY, "_v").agg(F.max("_next").alias("_next"), F.max("_on").alias("_on")))
    sent = nodes.withColumn(KEY, F.struct(*keys)).join(links.filter("_on").select(KEY, "_v"), [KEY, "_v"], "left_semi")
    return sent.select(*parts.columns)

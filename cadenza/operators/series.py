"""Per-frame series of a clip: smoothing, displacement, comparison with frame 0, missing frames, pre-emphasis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Timeline, counted, first_known, neighbourhoods, previous, running_sum


def moving_average(df: DataFrame, keys: tuple[str, ...], idx: str, cols: dict[str, str], half: int = 2) -> DataFrame:
    """`df` plus, by new name, centred means over 2 * half + 1 frames, rounded half to even; edges shrink, nulls are skipped."""
    dealt, w = neighbourhoods(df, keys, idx, half, half)
    means = {n: F.bround(F.avg(c).over(w.rangeBetween(-half, half)), 0).cast("long") for n, c in cols.items()}
    return dealt.withColumns(means).filter("_home").select(*df.columns, *cols)


def savgol_rows(window: int, degree: int = 2) -> list[tuple[int, int, int, float]]:
    """(w, row, offset, weight) of least-squares polynomials over w = 1, 3, .. `window` points: the fit's value at `row`."""
    out = []
    for w in range(1, window + 1, 2):
        A = np.vander(np.arange(w) - w // 2, min(degree, w - 1) + 1).astype(float)
        hat = A @ np.linalg.solve(A.T @ A, A.T)
        out += [(w, r, o, float(hat[r, o])) for r in range(w) for o in range(w)]
    return out


def savgol(df: DataFrame, t: Timeline, idx: str, cols: list[str], window: int = 5) -> DataFrame:
    """keys, idx and smoothed `cols`: a quadratic fit around each frame, at the ends one fit over the first or last frames.

    A clip shorter than the window takes the largest odd one that fits. Each frame is sent to the frames that it
    weighs in, and the products are summed before and after one shuffle. `idx` counts from 0, `cols` hold no nulls.
    """
    weights = df.sparkSession.createDataFrame(savgol_rows(window), "w long, row long, offset long, weight double")
    sized = counted(df, t, "_n").withColumn("w", F.expr(f"least({window}, _n - 1 + _n % 2)"))
    sent = sized.withColumn("_to", F.explode(F.sequence(F.greatest(F.lit(0), F.col(idx) - F.col("w") + 1), F.least(F.col("_n") - 1, F.col(idx) + F.col("w") - 1))))
    half = F.expr("w div 2")
    late = F.col("_to") > F.col("_n") - 1 - half
    row = F.when(F.col("_to") < half, F.col("_to")).when(late, F.col("w") - F.col("_n") + F.col("_to")).otherwise(half)
    base = F.when(F.col("_to") < half, F.lit(0)).when(late, F.col("_n") - F.col("w")).otherwise(F.col("_to") - half)
    placed = sent.withColumns({"row": row, "offset": F.col(idx) - base}).filter("offset >= 0 and offset < w")
    weighed = placed.join(F.broadcast(weights), ["w", "row", "offset"])  # at most window ** 3 rows
    return weighed.groupBy(*t.keys, F.col("_to").alias(idx)).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in cols])


def smooth_similarity(df: DataFrame, t: Timeline, idx: str, window: int = 5) -> DataFrame:
    """keys, idx, a, b, tx, ty of smoothed (theta, scale, tx, ty): angles by cos and sin, scales by logarithm."""
    parts = df.select(*dict.fromkeys([*t.keys, *t.order, idx]), "tx", "ty", F.cos("theta").alias("_cos"), F.sin("theta").alias("_sin"), F.log(F.greatest("scale", F.lit(1e-6))).alias("_log"))
    smooth = savgol(parts, t, idx, ["tx", "ty", "_cos", "_sin", "_log"], window)
    angle, scale = F.atan2("_sin", "_cos"), F.exp("_log")
    return smooth.select(*t.keys, idx, (scale * F.cos(angle)).alias("a"), (scale * F.sin(angle)).alias("b"), "tx", "ty")


def displacement(df: DataFrame, t: Timeline, x: str = "x", y: str = "y") -> DataFrame:
    """`df` plus `moved`, the distance from the frame before; null where either frame has no point."""
    dx, dy = F.col(x) - F.col("_x"), F.col(y) - F.col("_y")
    return previous(df, t, {"_x": x, "_y": y}).withColumn("moved", F.sqrt(dx * dx + dy * dy)).drop("_x", "_y")


def spread(value: Column) -> list[Column]:
    """count, mean, max and population deviation of a value, as aggregates."""
    return [F.count(value).alias("count"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std_pop")]


def against_first(df: DataFrame, t: Timeline, idx: str, value: str) -> DataFrame:
    """keys, mx, mn, same, worst_idx: absolute differences from the first known frame."""
    away = F.abs(F.col(value) - F.col("_first"))
    rows = first_known(df, t, {"_first": F.col(value)}).withColumn("_away", away).filter("_away is not null")
    return rows.groupBy(*t.keys).agg(F.max("_away").alias("mx"), F.avg("_away").alias("mn"), F.bool_and(F.col("_away") == 0).alias("same"), F.max_by(idx, F.struct("_away", -F.col(idx))).alias("worst_idx"))


def missing(df: DataFrame, keys: tuple[str, ...], idx: str, value: str, most: float, preview: int = 10) -> DataFrame:
    """keys, missing, total, ratio, first<preview>, fail: frames without a value, the first of them, and whether they are too many.

    The preview keeps only rows of rank <= preview before they are gathered, so it is as small for any clip.
    """
    gone = F.col(value).isNull()
    totals = df.groupBy(*keys).agg(F.count_if(gone).alias("missing"), F.count("*").alias("total"))
    first = df.filter(gone).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(idx))).filter(F.col("_nth") <= preview)
    firsts = first.groupBy(*keys).agg(F.array_sort(F.collect_list(idx)).alias("_list"))
    out = totals.join(firsts, list(keys), "left").withColumn("ratio", F.col("missing") / F.col("total"))
    return out.select(*keys, "missing", "total", "ratio", F.coalesce(F.array_join(F.transform("_list", lambda i: i.cast("string")), ","), F.lit("")).alias(f"first{preview}"), ((F.col("ratio") > most) | (F.col("missing") == F.col("total"))).alias("fail"))


def preemphasis(df: DataFrame, t: Timeline, value: str, factor: float = 0.97) -> DataFrame:
    """`df` plus z = x[t] - factor * x[t - 1], with x[-1] = 0."""
    return previous(df, t, {"_before": value}).withColumn("z", F.col(value) - F.lit(factor) * F.coalesce("_before", F.lit(0.0))).drop("_before")


def triples(df: DataFrame, t: Timeline, value: str, before: str = "before", after: str = "after") -> DataFrame:
    """`df` plus the values of the rows before and after; null at a key's ends."""
    backwards = [f"cadenza__back{i}" for i in range(len(t.order))]
    rows = previous(df, t, {before: value}).withColumns({b: -F.col(c) for b, c in zip(backwards, t.order)})
    return previous(rows, Timeline(t.keys, tuple(backwards), t.width), {after: value}).drop(*backwards)


def joined_chunks(df: DataFrame, keys: tuple[str, ...], chunk: str, pos: str, width: int = 4_096) -> DataFrame:
    """`df` plus at, each row's place when the chunks of a key are laid end to end in order."""
    sizes = df.groupBy(*keys, chunk).agg((F.max(pos) + 1).alias("cadenza__size"))
    starts = running_sum(sizes, Timeline(keys, (chunk,), width), {"cadenza__upto": F.col("cadenza__size")})
    return df.join(starts, [*keys, chunk]).withColumn("at", F.col("cadenza__upto") - F.col("cadenza__size") + F.col(pos)).drop("cadenza__upto", "cadenza__size")


def restyled(content: DataFrame, style: DataFrame, on: str, value: str, eps: float = 1e-5) -> DataFrame:
    """`content` with the mean and deviation of the same channel of `style`: both are combined per channel before they are joined."""
    stats = lambda df, n: df.groupBy(on).agg(F.avg(value).alias(f"cadenza__m{n}"), F.sqrt(F.var_samp(value) + eps).alias(f"cadenza__s{n}"))
    own = stats(content, 0).join(stats(style, 1), on)
    scaled = (F.col(value) - F.col("cadenza__m0")) / F.col("cadenza__s0") * F.col("cadenza__s1") + F.col("cadenza__m1")
    return content.join(own, on).withColumn(value, scaled).drop(*[f"cadenza__{c}{n}" for c in "ms" for n in (0, 1)])


def padded(df: DataFrame, keys: tuple[str, ...], idx: str, value: str, length: int, fill: float = 0.0) -> DataFrame:
    """keys, idx, value of exactly `length` places from 0: longer keys are trimmed, shorter ones filled."""
    grid = df.select(*keys).distinct().withColumn(idx, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    kept = df.filter(F.col(idx).between(0, length - 1)).select(*keys, idx, value)
    return grid.join(kept, [*keys, idx], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def inverse_similarity(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    """The similarity (a, b, tx, ty) that takes back x' = a x - b y + tx, y' = b x + a y + ty; null where a and b are 0."""
    size = a * a + b * b
    ia, ib = a / size, -b / size
    inverse = F.struct(ia.alias("a"), ib.alias("b"), (-(ia * tx - ib * ty)).alias("tx"), (-(ib * tx + ia * ty)).alias("ty"))
    return F.when(size > 0, inverse)

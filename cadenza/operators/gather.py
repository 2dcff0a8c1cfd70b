"""Frame-to-feature gathers as equi-joins: the rows that a frame wants are listed, then joined by (key, index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Features of a block, about as many as a frame wants.
BLOCK = 16


def _ranged(frames: DataFrame, features: DataFrame, keys: tuple[str, ...], idx: str, low: Column, high: Column) -> DataFrame:
    """`frames` once for each feature whose index is a whole number of [low, high].

    Features are gathered in blocks of BLOCK indexes, and a frame is dealt to the blocks that it touches instead of to each index: of a
    frame that wants k features about k / BLOCK + 1 rows are shuffled, and its features lie together. A block grows with the features
    that share an index, of which a key has one.
    """
    rest = [c for c in features.columns if c not in keys]
    blocks = features.withColumn("_block", F.expr(f"floor(`{idx}` / {BLOCK})")).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*rest)).alias("_held"))
    asked = frames.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_low <= _high")
    dealt = asked.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_low") / BLOCK), F.floor(F.col("_high") / BLOCK))))
    at = lambda f: (f[idx] >= F.col("_low")) & (f[idx] <= F.col("_high"))
    met = dealt.join(blocks, [*keys, "_block"]).withColumn("_f", F.explode(F.filter("_held", at)))
    return met.select(*[F.col(c) for c in frames.columns if c != idx], *[F.col("_f")[c].alias(c) for c in rest])


def _wanted(frames: DataFrame, low: Column, high: Column) -> DataFrame:
    """`frames` once for each whole number of [low, high]; none where high < low."""
    return frames.withColumn("_at", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))


def _index(frame: Column, rate: tuple[int, int]) -> Column:
    """int(frame * a / b), cut towards zero."""
    product = frame * rate[0]
    return F.when(product < 0, -F.floor(-product / rate[1])).otherwise(F.floor(product / rate[1])).cast("long")


def clamped(frames: DataFrame, features: DataFrame, keys: tuple[str, ...], frame: str, idx: str, rate: tuple[int, int], left: int, right: int, length: str = "n") -> DataFrame:
    """Each frame with the features int(frame * rate) - left .. + right - 1, the index clamped to [0, length - 1]."""
    centre = _index(F.col(frame), rate)
    low, high, last = centre - left, centre + right - 1, F.col(length) - 1
    edge = lambda c: F.least(F.greatest(F.lit(0), c), last)
    met = _ranged(frames, features, keys, idx, edge(low), F.when(high >= low, edge(high)).otherwise(-1))
    # the first and the last feature stand for all indexes beyond them
    before = F.when(F.col(idx) == 0, F.least(high, F.lit(0)) - low).otherwise(0)
    after = F.when(F.col(idx) == last, high - F.greatest(low, last)).otherwise(0)
    times = F.greatest(F.lit(1), 1 + F.greatest(F.lit(0), before) + F.greatest(F.lit(0), after)).cast("int")
    return met.withColumn("_again", F.explode(F.array_repeat(F.lit(0), times))).drop("_again")


def sparse(frames: DataFrame, features: DataFrame, keys: tuple[str, ...], frame: str, idx: str, rate: tuple[int, int], left: int, right: int, length: str = "n") -> DataFrame:
    """Each frame with a pair of features for each step of -left .. right: (i - 1, i) at i = int((frame + step) * rate), or a clamped one twice."""
    steps = frames.withColumn("_step", F.explode(F.sequence(F.lit(-left), F.lit(right))))
    at = F.col("_i")
    placed = steps.withColumn("_i", _index(F.col(frame) + F.col("_step"), rate))
    edge = F.least(F.greatest(F.lit(0), at), F.col(length) - 1)
    pair = F.when((at < 1) | (at > F.col(length) - 1), F.array(edge, edge)).otherwise(F.array(at - 1, at))
    return placed.withColumn(idx, F.explode(pair)).drop("_step", "_i").join(features, [*keys, idx])


def zero_padded(frames: DataFrame, features: DataFrame, keys: tuple[str, ...], frame: str, idx: str, rate: tuple[int, int], left: int, right: int) -> DataFrame:
    """As `clamped`, but an index outside the features keeps a row of nulls, to be read as zero."""
    centre = _index(F.col(frame), rate)
    return _wanted(frames, centre - left, centre + right - 1).withColumnRenamed("_at", idx).join(features, [*keys, idx], "left")


def last_clamped_windows(frames: DataFrame, features: DataFrame, keys: tuple[str, ...], frame: str, idx: str, rate: tuple[int, int], size: int, length: str = "n") -> DataFrame:
    """Each frame with `size` features from int(frame * rate), or the last `size` where that goes past the end."""
    start = F.least(_index(F.col(frame), rate), F.greatest(F.lit(0), F.col(length) - size))
    asked = frames.withColumn("start", start)
    return _ranged(asked, features, keys, idx, F.col("start"), F.least(F.col("start") + size, F.col(length)) - 1)


def sliding(lengths: DataFrame, size: int, hop: int, tail: int, length: str = "n") -> DataFrame:
    """Rows of (.., i): the starts 0, hop, 2 * hop, .. of windows with i + size < length - tail; none for short keys."""
    last = F.col(length) - tail - size - 1
    return lengths.withColumn("i", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last, F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))))


def window_rows(windows: DataFrame, features: DataFrame, keys: tuple[str, ...], idx: str, size: int) -> DataFrame:
    """The features i .. i + size - 1 of each window."""
    return _ranged(windows, features, keys, idx, F.col("i"), F.col("i") + size - 1)


def pingpong(keys: DataFrame, frames: DataFrame, on: tuple[str, ...], idx: str, n: int, m: int) -> DataFrame:
    """m frames per key made of the first n, forth and back."""
    j = F.col("j")
    looped = keys.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    at = F.when(F.floor(j / n) % 2 == 0, j % n).otherwise(n - 1 - j % n)
    return looped.withColumn(idx, at.cast("long")).join(frames, [*on, idx])


def sample_ranges(frames: DataFrame, t, frame: str, fps: float, rate: int) -> DataFrame:
    """`frames` plus [first, last) audio samples of each frame; a frame that follows its predecessor starts where that ended."""
    from .ordered import previous

    end = F.floor((F.col(frame) + 1) / F.lit(float(fps)) * rate).cast("long")
    own = F.floor(F.col(frame) / F.lit(float(fps)) * rate).cast("long")
    rows = previous(frames.withColumn("last", end), t, {"_frame": frame, "_last": "last"})
    return rows.withColumn("first", F.when(F.col("_frame") == F.col(frame) - 1, F.col("_last")).otherwise(own)).drop("_frame", "_last")


def at_index(asked: DataFrame, features: DataFrame, keys: tuple[str, ...], idx: str, length: str = "n") -> DataFrame:
    """`asked` with the feature at `idx`, counted from the end where it is negative; `ok` is false where there is none such."""
    real = F.when(F.col(idx) < 0, F.col(idx) + F.col(length)).otherwise(F.col(idx))
    placed = asked.withColumns({"asked": F.col(idx), idx: real, "ok": (real >= 0) & (real < F.col(length))})
    return placed.join(features, [*keys, idx], "left")


def slice_indexes(asked: DataFrame, start: Column, stop: Column, step: Column, idx: str, length: str = "n") -> DataFrame:
    """`asked` once for each index of [start:stop:step], bounds counted from the end where negative and cut to the length.

    A null bound is the end that a step of its sign starts or stops at; a slice may be empty. `step` is not 0.
    """
    n, up = F.col(length), step > 0
    low, high = F.when(up, F.lit(0)).otherwise(-1), F.when(up, n).otherwise(n - 1)
    held = lambda c, none: F.when(c.isNull(), none).otherwise(F.least(F.greatest(F.when(c < 0, c + n).otherwise(c), low), high))
    a, z = held(start, F.when(up, low).otherwise(high)), held(stop, F.when(up, high).otherwise(low))
    last = F.when(up, z - 1).otherwise(z + 1)
    some = F.when(up, a <= last).otherwise(a >= last)
    none = F.array().cast("array<bigint>")
    return asked.withColumn(idx, F.explode(F.when(some, F.sequence(a.cast("long"), last.cast("long"), step.cast("long"))).otherwise(none)))

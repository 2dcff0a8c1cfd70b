"""Short-time spectra of sampled clips: centred, windowed frames, their transforms, and mel bands.

Samples are rows (keys, idx, value). A clip is dealt in blocks of frames, each with the samples that its frames reach over
its edges, so a block is of one size however long the clip, and a clip that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Frames of a block.
BLOCK = 512
# The mel scale is linear up to 1000 Hz with 3 mels to 200 Hz, then 27 mels to each factor of 6.4.
LINEAR_HZ, HZ_PER_MEL, LOG_STEP = 1000.0, 200.0 / 3, np.log(6.4) / 27


def mel_of(hz: np.ndarray) -> np.ndarray:
    above = LINEAR_HZ / HZ_PER_MEL + np.log(np.maximum(hz, LINEAR_HZ) / LINEAR_HZ) / LOG_STEP
    return np.where(hz < LINEAR_HZ, hz / HZ_PER_MEL, above)


def hz_of(mel: np.ndarray) -> np.ndarray:
    turn = LINEAR_HZ / HZ_PER_MEL
    return np.where(mel < turn, mel * HZ_PER_MEL, LINEAR_HZ * np.exp(LOG_STEP * (np.maximum(mel, turn) - turn)))


def mel_basis(rate: int, n_fft: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(bands, n_fft // 2 + 1) triangles of equal area, their corners evenly spaced in mel."""
    corners = hz_of(np.linspace(*mel_of(np.array([low, rate / 2 if high is None else high])), bands + 2))
    bins = np.fft.rfftfreq(n_fft, 1 / rate)
    left, peak, right = (corners[k : bands + k, None] for k in range(3))
    shape = np.minimum((bins - left) / (peak - left), (right - bins) / (right - peak))
    return np.maximum(shape, 0) * 2 / (right - left)


def hann(n: int) -> np.ndarray:
    """The periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(samples: DataFrame, keys: tuple[str, ...], idx: str, value: str, n_fft: int, hop: int, reflect: bool = False) -> DataFrame:
    """keys, frame, magnitude (array of n_fft / 2 + 1) of the frames 0 .. n // hop of every clip of n samples.

    Frame t is centred on sample t * hop. Past the ends samples are zero, or with `reflect` mirrored about the end sample
    (clips of n_fft / 2 samples or fewer have no such mirror and give no frame). `idx` counts from 0; a missing or null
    sample is zero. A key of no samples has no rows.
    """
    half, at = n_fft // 2, F.col("_at")
    lengths = samples.groupBy(*keys).agg((F.max(idx) + 1).cast("long").alias("_n"))
    rows = samples.select(*keys, F.col(idx).cast("long").alias("_idx"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"))
    sized = rows.join(lengths, list(keys))
    if reflect:
        sized = sized.filter(F.col("_n") > half)
        left, right = -F.col("_idx"), 2 * (F.col("_n") - 1) - F.col("_idx")
        here = F.array(F.col("_idx"), F.when((left < 0) & (left >= -half), left), F.when((right >= F.col("_n")) & (right < F.col("_n") + half), right))
        sized = sized.withColumn("_at", F.explode(F.array_compact(here)))
    else:
        sized = sized.withColumn("_at", F.col("_idx"))
    last = F.expr(f"_n div {hop}")  # number of the last frame
    first_frame = F.greatest(F.lit(0), F.ceil((at - half + 1) / hop))
    last_frame = F.least(last, F.floor((at + half) / hop))
    reach = sized.withColumns({"_first": first_frame.cast("long"), "_upto": last_frame.cast("long")}).filter("_first <= _upto")
    dealt = reach.withColumn("_block", F.explode(F.sequence(F.expr(f"_first div {BLOCK}"), F.expr(f"_upto div {BLOCK}"))))
    window = hann(n_fft)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, n = int(pdf["_block"].iloc[0]), int(pdf["_n"].iloc[0])
        frames = np.arange(block * BLOCK, min((block + 1) * BLOCK, n // hop + 1))
        base = frames[0] * hop - half
        held = np.zeros((len(frames) - 1) * hop + n_fft)
        place = pdf["_at"].to_numpy() - base
        inside = (place >= 0) & (place < len(held))
        held[place[inside]] = pdf["_x"].to_numpy()[inside]
        cut = np.lib.stride_tricks.sliding_window_view(held, n_fft)[::hop]
        out = {k: [pdf[k].iloc[0]] * len(frames) for k in keys}
        return pd.DataFrame(out | {"frame": frames, "magnitude": list(np.abs(np.fft.rfft(cut * window, axis=1)))})

    types = dict(samples.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "frame long", "magnitude array<double>"])
    return dealt.select(*keys, "_block", "_n", "_at", "_x").groupBy(*keys, "_block").applyInPandas(run, schema)


def in_bands(values: Column, basis: np.ndarray) -> Column:
    """The product of a basis (a small constant) and each row's array; null stays null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def product(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            known = column.notna()
            found = iter(np.stack(column[known].to_list()) @ basis.T if known.any() else [])
            out = pd.Series([next(found) if k else None for k in known], dtype=object)
            yield out

    return product(values)


def mel_spectrogram(samples: DataFrame, keys: tuple[str, ...], idx: str, value: str, rate: int = 16_000, n_fft: int = 800, hop: int = 200, bands: int = 80, low: float = 55.0, high: float = 7600.0, floor_db: float = -100.0, ref_db: float = 20.0) -> DataFrame:
    """keys, frame, mel: decibels of mel magnitudes less `ref_db`, from [floor_db, 0] to [0, 1] and held there.

    `value` is the signal after pre-emphasis.
    """
    spectra = stft(samples, keys, idx, value, n_fft, hop)
    return spectra.select(*keys, "frame", scaled_db(in_bands(F.col("magnitude"), mel_basis(rate, n_fft, bands, low, high)), floor_db, ref_db).alias("mel"))


def linear_spectrogram(samples: DataFrame, keys: tuple[str, ...], idx: str, value: str, n_fft: int = 800, hop: int = 200, floor_db: float = -100.0, ref_db: float = 20.0) -> DataFrame:
    """keys, frame, linear: as `mel_spectrogram`, of each bin by itself."""
    return stft(samples, keys, idx, value, n_fft, hop).select(*keys, "frame", scaled_db(F.col("magnitude"), floor_db, ref_db).alias("linear"))


def scaled_db(values: Column, floor_db: float, ref_db: float) -> Column:
    """Decibels of magnitudes, no less than the floor, less the reference, scaled to 0 at the floor and 1 at 0 dB."""
    least = 10 ** (floor_db / 20)
    level = lambda x: (20 * F.log10(F.greatest(F.lit(least), x)) - ref_db - floor_db) / -floor_db
    return F.transform(values, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), level(x))))


def log_mel_spectrogram(samples: DataFrame, keys: tuple[str, ...], idx: str, value: str, rate: int = 16_000, n_fft: int = 400, hop: int = 160, bands: int = 80) -> DataFrame:
    """keys, frame, mel: log10 of mel power, no more than 8 under the clip's peak, compressed; mirrored ends, last frame left out."""
    lengths = samples.groupBy(*keys).agg((F.max(idx) + 1).cast("long").alias("_n"))
    spectra = stft(samples, keys, idx, value, n_fft, hop, reflect=True).join(lengths, list(keys)).filter(F.col("frame") < F.expr(f"_n div {hop}"))
    power = F.transform("magnitude", lambda x: x * x)
    bare = F.transform(in_bands(power, mel_basis(rate, n_fft, bands)), lambda x: F.log10(F.greatest(x, F.lit(1e-10))))
    levels = spectra.select(*keys, "frame", bare.alias("_level"))
    peaks = levels.groupBy(*keys).agg(F.max(F.array_max("_level")).alias("_peak"))
    floor = F.col("_peak") - 8.0
    return levels.join(peaks, list(keys)).select(*keys, "frame", F.transform("_level", lambda x: (F.greatest(x, floor) + 4.0) / 4.0).alias("mel"))

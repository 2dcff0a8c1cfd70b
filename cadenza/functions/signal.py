"""Arithmetic on audio, boxes and images, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def decibels(amplitude: Column, floor: float = 1e-5) -> Column:
    return 20 * F.log10(F.greatest(F.lit(floor), amplitude))


def amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db * 0.05)


def log_mel(power: Column, peak: Column) -> Column:
    """Compressed mel power; `peak` is the clip's largest log10 power."""
    return (F.greatest(F.log10(F.greatest(power, F.lit(1e-10))), peak - 8.0) + 4.0) / 4.0


def peak_scaled(sample: Column, peak: Column, to: float = 0.95) -> Column:
    """Samples scaled to a peak of `to` where the clip's peak is over 1."""
    return F.when(peak > 1.0, sample / peak * to).otherwise(sample)


def pcm16(sample: Column, peak: Column) -> Column:
    return (sample * 32767 / F.greatest(F.lit(0.01), peak)).cast("int")


def blend(a: Column, b: Column, mask: Column) -> Column:
    return a * mask + b * (1 - mask)


def guided(unconditional: Column, conditional: Column, scale: float) -> Column:
    return unconditional + scale * (conditional - unconditional)


def expanded_box(x1: Column, y1: Column, x2: Column, y2: Column, share: float, width: Column, height: Column) -> Column:
    """A box grown by a share of its size on every side, whole pixels, inside the frame."""
    dx, dy = F.floor((x2 - x1) * share), F.floor((y2 - y1) * share)
    return F.struct(F.greatest(F.lit(0), x1 - dx).alias("x1"), F.greatest(F.lit(0), y1 - dy).alias("y1"), F.least(width, x2 + dx).alias("x2"), F.least(height, y2 + dy).alias("y2"))


def face_ok(w: Column, h: Column, score: Column) -> Column:
    """False for a box without height."""
    return (w >= 50) & (h >= 80) & F.coalesce(F.try_divide(w, h).between(0.2, 1.5), h.isNull()) & (score >= 0.5)


def odd_kernel(ratio: Column, size: Column) -> Column:
    """An odd kernel from a share of a size, held to 3..31."""
    k = F.floor(ratio * size).cast("long")
    return F.least(F.lit(31), F.greatest(F.lit(3), k + (1 - k % 2)))


def stretch(current: Column, target: Column, least: float = 0.85) -> Column:
    """The time ratio that fits a clip to its target, null where none is needed or it is under `least`."""
    ratio = F.try_divide(target, current)
    return F.when((current > target + 0.05) & (ratio >= least), ratio)


def mux_plan(video: Column, audio: Column, watermark: Column) -> Column:
    """Padding seconds, whether the picture is encoded anew, and the provenance comment that every output keeps."""
    pad = F.when(audio > video, audio - video).otherwise(F.lit(0.0))
    return F.struct(pad.alias("pad_seconds"), ((pad > 0) | watermark).alias("reencode"), watermark.alias("watermark"), F.lit("AI-generated: video translation").alias("metadata_comment"))


def length_normalised(logprob: Column, length: Column, alpha: float | None = None) -> Column:
    """Null where the divisor is 0: without tokens, or with `alpha` at a length of -5."""
    return F.try_divide(logprob, length if alpha is None else F.pow((5 + length) / 6, F.lit(alpha)))


def human_duration(seconds: Column) -> Column:
    """`Xm Ys` from a minute on, else `Ys`."""
    whole = F.ceil(seconds)
    return F.when(whole >= 60, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))).otherwise(F.concat(whole.cast("string"), F.lit("s")))


def progress_bar(share: Column, width: int = 16) -> Column:
    full = F.floor(clamp(share, 0.0, 1.0) * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full), F.lit("] "), F.floor(share * 100).cast("string"), F.lit("%"))


def progress_side(status: Column, name: Column, running: Column, progress: Column, duration_ms: Column, eta: Column, observed: Column) -> Column:
    """What a report says beside a stage: its time, its bar and the remaining seconds, or what is expected of it.

    Remaining seconds come from the observed rate of the running stage, else from the share of the eta that is left, else
    from the whole eta; an asterisk marks the guesses.
    """
    done = F.coalesce(progress, F.lit(0.0))
    left = F.greatest(F.lit(0), F.floor(eta * (1 - done)))
    guess = F.when(done > 0, F.concat(F.lit("  ~"), left.cast("string"), F.lit("s left*"))).otherwise(F.concat(F.lit("  ~"), F.floor(eta).cast("string"), F.lit("s ETA*")))
    seen = F.when(observed.isNotNull() & (name == running), F.concat(F.lit("  ~"), observed.cast("string"), F.lit("s left"))).when(eta > 0, guess)
    bar = F.coalesce(progress_bar(progress), F.lit(""))
    return (
        F.when((status == "done") & duration_ms.isNotNull(), F.concat(F.floor(duration_ms / 1000).cast("string"), F.lit("s")))
        .when(status == "running", F.concat(bar, F.coalesce(seen, F.lit(""))))
        .when((status == "pending") & eta.isNotNull(), F.concat(F.lit("~"), F.floor(eta).cast("string"), F.lit("s ETA")))
        .otherwise("")
    )


def elapsed_ms(start_s: Column, end_s: Column) -> Column:
    return ((end_s - start_s) * 1000).cast("long")


def clip_seconds(frames: Column, fps: Column) -> Column:
    """Null at 0 frames a second."""
    return F.try_divide(frames, fps)


def unnoised(sample: Column, noise: Column, alpha: Column, clip: bool = True) -> Column:
    """The sample before noise of share 1 - alpha, in one step; held to -1..1 where `clip` is set; null at alpha 0."""
    origin = F.try_divide(sample - F.sqrt(1 - alpha) * noise, F.sqrt(alpha))
    return clamp(origin, -1.0, 1.0) if clip else origin


def edge_width(area: Column) -> Column:
    """A twentieth of a square's side, whole pixels."""
    return F.floor(F.floor(F.sqrt(area)) / 20)


def gaussian_sigma(kernel: Column) -> Column:
    """The deviation that goes with an odd kernel."""
    return 0.3 * ((kernel - 1) * 0.5 - 1) + 0.8


def whole_ratio(a: Column, b: Column) -> Column:
    """a / b where it has no remainder; an error where it has one or b is 0."""
    return F.when(F.try_mod(a, b) == 0, F.try_divide(a, b).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no whole ratio: "), a.cast("string"), F.lit(" / "), b.cast("string"))).cast("long"))


def unit_range(x: Column, low: float, high: float) -> Column:
    """[low, high] to [0, 1]."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def byte_range(x: Column) -> Column:
    """[0, 1] to whole numbers of 0..255."""
    return F.round(clamp(x, 0.0, 1.0) * 255).cast("int")


def frame_count(length: Column, size: int, shift: int) -> Column:
    """Frames of `size` samples, `shift` apart, over a signal padded by size - shift on both sides."""
    over = F.floor((length + 2 * (size - shift) - size) / shift)
    return (over + F.when(length % shift == 0, 1).otherwise(2)).cast("long")


def frame_padding(length: Column, size: int, shift: int) -> Column:
    """struct(left, right): what is added so that frame_count frames fit exactly."""
    pad = size - shift
    rest = (frame_count(length, size, shift) - 1) * shift + size - (length + 2 * pad)
    return F.struct(F.lit(pad).cast("long").alias("left"), (rest + pad).cast("long").alias("right"))


def last_padding(length: Column, shift: int) -> Column:
    """What fills a signal up to the next whole number of shifts."""
    return ((F.floor(length / shift) + 1) * shift - length).cast("long")


def sinusoids(position: Column, channels: int, halves: bool, longest: float = 10_000.0) -> Column:
    """A position's table row: sines then cosines, or sine and cosine in turn."""
    half = channels // 2
    rate = lambda i: F.exp(-F.log(F.lit(longest)) / (half - 1) * i) if halves else F.exp(2 * i * (-F.log(F.lit(longest)) / channels))
    at = F.sequence(F.lit(0), F.lit(half - 1))
    if halves:
        return F.concat(F.transform(at, lambda i: F.sin(position * rate(i))), F.transform(at, lambda i: F.cos(position * rate(i))))
    return F.flatten(F.transform(at, lambda i: F.array(F.sin(position * rate(i)), F.cos(position * rate(i)))))


def shape_error(height: Column, width: Column, steps: Column) -> Column:
    """Why a picture size cannot be worked on, null if it can."""
    return F.when(height != width, "not square").when((height % 8 != 0) | (width % 8 != 0), "not divisible by 8").when(steps.isNull() | (steps <= 0), "steps not positive")


def device_index(device: Column) -> Column:
    """The number of a device name such as cuda:1, 0 for cuda, -1 for cpu; null for others."""
    return F.when(device == "cpu", -1).when(device == "cuda", 0).when(device.rlike("^cuda:[0-9]+$"), F.regexp_extract(device, "[0-9]+$", 0).cast("int"))

"""Detected faces: the largest of a frame, frames that have one, anchor points, areas and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The detected points whose means are the anchors, and the labels of a parsed face that a blend mode covers.
ANCHORS = {"left_eye": [43, 48, 49, 51, 50], "right_eye": [101, 102, 103, 104, 105], "nose": [74, 77, 83, 86]}
MODES = {"neck": [1, 11, 12, 13, 14], "raw": [1, 11, 12, 13], "mouth": [11, 12, 13]}
FACE, BESIDE, LIPS = [1], [10], [11, 12, 13]


def largest(df: DataFrame, keys: tuple[str, ...], pos: str, box: Column) -> DataFrame:
    """keys, pos: of each frame the face of the largest area, the first of equal ones; null where none has a box.

    `box` is struct(x1, y1, x2, y2).
    """
    area = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    return df.groupBy(*keys).agg(F.max_by(pos, F.when(area.isNotNull(), F.struct(area, -F.col(pos)))).alias(pos))


def active(box: Column) -> Column:
    """Whether a frame has a box with an inside; frames without pass through unchanged."""
    return F.coalesce((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), F.lit(False))


def anchors(points: DataFrame, keys: tuple[str, ...], landmark: str, lists: dict[str, list[int]]) -> DataFrame:
    """keys, anchor, x, y: the mean of the points of each list. Of `points` only the listed ones are shuffled."""
    names = points.sparkSession.createDataFrame([(a, i) for a, own in lists.items() for i in own], f"anchor string, {landmark} long")
    return points.join(F.broadcast(names), landmark).groupBy(*keys, "anchor").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def best_class(scores: Column) -> Column:
    """The number, from 0, of the largest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)) - 1


def mode_mask(label: Column, mode: str) -> Column:
    return label.isin(MODES[mode])


def jaw_mask(label: Column, near_face: Column) -> Column:
    """Pixels near the face's skin that are not beside it, and the lips."""
    return (near_face & ~label.isin(BESIDE)) | label.isin(LIPS)


def shares(df: DataFrame, keys: tuple[str, ...], mask: Column) -> DataFrame:
    """keys, area, total: pixels under a mask and all."""
    return df.groupBy(*keys).agg(F.count_if(mask).alias("area"), F.count("*").alias("total"))

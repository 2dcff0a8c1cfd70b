"""Nearest codebook vector, cosine pairs and similarity transforms.

A codebook is a stated small table: its size is checked, and it is carried as one broadcast array, so every vector meets
it in its own task without a join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .nearest import nearest_by_pivots

CODEBOOK_ROWS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """`v` scaled to length 1; nulls in place of the components of a zero vector."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), size))


def with_codebook(vectors: DataFrame, codes: DataFrame, code: str, column: str) -> DataFrame:
    """`vectors` plus _codes, the array of (code, v) of the whole codebook."""
    if codes.limit(CODEBOOK_ROWS + 1).count() > CODEBOOK_ROWS:
        raise ValueError(f"a codebook has at most {CODEBOOK_ROWS} rows; nearest.nearest_by_pivots takes more")
    book = codes.select(F.struct(F.col(code).alias("code"), F.col(column).alias("v")).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("_codes"))
    keyed = vectors.withColumn("_one", F.lit(1))
    return keyed.join(F.broadcast(book.withColumn("_one", F.lit(1))), "_one").drop("_one")  # the book is one row


def nearest_code(vectors: DataFrame, codes: DataFrame, id_: str, code: str, column: str) -> DataFrame:
    """id, code: the code at the smallest Euclidean distance, the lowest of equal ones; a book too large to carry is searched by pivots."""
    if codes.limit(CODEBOOK_ROWS + 1).count() > CODEBOOK_ROWS:
        return nearest_by_pivots(vectors, codes, id_, code, column)
    scored = F.transform("_codes", lambda c: F.struct(squared_distance(F.col(column), c["v"]).alias("d"), c["code"].alias("code")))
    return with_codebook(vectors, codes, code, column).select(id_, F.array_min(scored)["code"].alias("code"))


def cosine_top(vectors: DataFrame, codes: DataFrame, id_: str, code: str, column: str, k: int) -> DataFrame:
    """id, code, rank: the k codes of the largest cosine, the lowest of equal ones first; a zero vector is at cosine 0 to all."""
    own = F.col(column)
    cosine = lambda c: F.coalesce(F.try_divide(dot(own, c["v"]), F.sqrt(dot(own, own) * dot(c["v"], c["v"]))), F.lit(0.0))
    scored = F.transform("_codes", lambda c: F.struct((-F.round(cosine(c), 9)).alias("d"), c["code"].alias("code")))
    top = F.slice(F.array_sort(scored), 1, k)
    return with_codebook(vectors, codes, code, column).select(id_, F.posexplode(top).alias("_at", "_c")).select(id_, F.col("_c.code").alias("code"), (F.col("_at") + 1).alias("rank"))


def similarity_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tx, ty, theta, scale of (x1, y1) to (x2, y2) pairs: p2 = scale * rotation(theta) * p1 + t.

    The angle is the least-squares one of the centred pairs; the scale is the ratio of the sample deviations over all
    coordinates of the centred points. Everything is a sum, so groups are combined before the shuffle.
    """
    s = F.sum
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    sums = {"n": F.count("*"), "sx1": s(x1), "sy1": s(y1), "sx2": s(x2), "sy2": s(y2), "dotp": s(x1 * x2 + y1 * y2), "crossp": s(x1 * y2 - y1 * x2), "q1": s(x1 * x1 + y1 * y1), "q2": s(x2 * x2 + y2 * y2)}
    g = pairs.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    n, sx1, sy1, sx2, sy2 = (F.col(c) for c in ("n", "sx1", "sy1", "sx2", "sy2"))
    along, across = F.col("dotp") - (sx1 * sx2 + sy1 * sy2) / n, F.col("crossp") - (sx1 * sy2 - sy1 * sx2) / n
    spread1, spread2 = F.col("q1") - (sx1 * sx1 + sy1 * sy1) / n, F.col("q2") - (sx2 * sx2 + sy2 * sy2) / n
    fit = g.withColumns({"theta": F.atan2(across, along), "scale": F.when(spread1 > 1e-9, F.sqrt(F.greatest(F.lit(0.0), spread2) / spread1))})
    cos, sin = F.col("scale") * F.cos("theta"), F.col("scale") * F.sin("theta")
    return fit.select(*keys, (sx2 / n - (cos * sx1 - sin * sy1) / n).alias("tx"), (sy2 / n - (sin * sx1 + cos * sy1) / n).alias("ty"), "theta", "scale")


@F.pandas_udf(StructType([*[StructField(c, DoubleType()) for c in ("a", "b", "tx", "ty")], StructField("inliers", IntegerType())]))
def robust_similarity(points: pd.Series, targets: pd.Series) -> pd.DataFrame:
    """(a, b, tx, ty, inliers) with x' = a x - b y + tx, y' = b x + a y + ty, for arrays of a few [x, y] points and their targets.

    Of the maps through any two of the points, that of the least median squared error tells which points fit (within 2.5
    robust deviations); the map is then the least-squares one of those. Nulls, fewer than two points, lists of
    unlike length and points that all coincide give nulls.
    """
    out = np.full((len(points), 5), np.nan)
    for n in {len(p) for p in points if p is not None} - {0, 1}:
        rows = np.array([i for i, (p, q) in enumerate(zip(points, targets)) if p is not None and q is not None and len(p) == len(q) == n], np.int64)
        if not len(rows):
            continue
        z, w = (np.array([[complex(*xy) for xy in s.iloc[i]] for i in rows]) for s in (points, targets))
        best, wrong = np.full(len(rows), np.inf), np.full(z.shape, np.inf)
        for i, j in combinations(range(n), 2):
            apart = z[:, j] - z[:, i]
            m = np.divide(w[:, j] - w[:, i], apart, out=np.zeros_like(apart), where=np.abs(apart) > 1e-9)
            error = np.abs(m[:, None] * (z - z[:, [i]]) + w[:, [i]] - w) ** 2
            median = np.where(np.abs(apart) > 1e-9, np.sort(error, axis=1)[:, n // 2], np.inf)
            better = median < best
            best[better], wrong[better] = median[better], error[better]
        spread = 2.5 * 1.4826 * (1 + 5 / max(1, n - 2)) * np.sqrt(np.where(np.isfinite(best), best, 0))
        fits = (wrong <= np.maximum(spread, 1e-3)[:, None] ** 2).astype(float)
        count = np.maximum(fits.sum(axis=1, keepdims=True), 1)
        zc, wc = z - (fits * z).sum(axis=1, keepdims=True) / count, w - (fits * w).sum(axis=1, keepdims=True) / count
        size = (fits * np.abs(zc) ** 2).sum(axis=1)
        m = np.divide((fits * zc.conj() * wc).sum(axis=1), size, out=np.zeros(len(rows), complex), where=size > 1e-18)
        t = ((fits * (w - m[:, None] * z)).sum(axis=1, keepdims=True) / count)[:, 0]
        known = np.isfinite(best) & (size > 1e-18)
        out[rows[known]] = np.column_stack([m.real, m.imag, t.real, t.imag, fits.sum(axis=1)])[known]
    frame = pd.DataFrame(out, columns=["a", "b", "tx", "ty", "inliers"]).astype(object).where(~np.isnan(out), None)
    return frame.astype({c: "Float64" for c in "a b tx ty".split()} | {"inliers": "Int32"})

"""Exact nearest codes of large codebooks, by pivots and the triangle inequality.

Some codes are pivots; every code belongs to the cell of its nearest one. A vector's distance to a pivot and the cell's radius bound
its distance to all codes of the cell, so after a search of its own cell only cells that may hold a nearer code are searched. Cells
are cut into blocks of codes and their vectors into shares, so no task holds more than a block and a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Pivots, codes of a block and vectors of a share, about.
PIVOTS, BLOCK_ROWS, SHARE_ROWS = 256, 8_192, 16_384
#: Distances that are held at once.
HELD = 1 << 22
#: Bounds hold up to rounding; cells are searched when they miss by less than this share.
SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` and `b`, added up in the order of the components as a column expression does."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        d = x[:, None] - y[None, :]
        out += d * d
    return out


def nearest_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, place) of the nearest row of `b`, the first of equal ones, to each row of `a`; as `squared` tells it.

    Products of matrices leave, up to their rounding, few rows of `b` that may be nearest; only these are measured.
    """
    at, best = np.zeros(len(a), np.int64), np.zeros(len(a))
    norm = (b * b).sum(axis=1)
    error = 8 * (a.shape[1] + 4) * np.finfo(float).eps
    step = max(1, HELD // len(b))
    for i in range(0, len(a), step):
        own = a[i : i + step]
        far = norm - 2 * (own @ b.T)
        bound = far.min(axis=1) + error * ((own * own).sum(axis=1) + norm.max())
        row, col = np.nonzero(far <= bound[:, None])
        for k in range(0, len(row), HELD // 4):  # at least one candidate a row, in order of row and place
            r, c = row[k : k + HELD // 4], col[k : k + HELD // 4]
            d = np.zeros(len(r))
            for x, y in zip(own.T, b.T):
                e = x[r] - y[c]
                d += e * e
            order = np.lexsort((c, d, r))
            lead = order[np.r_[True, r[order][1:] != r[order][:-1]]]
            new = np.ones(len(lead), bool) if not k else (r[lead] != row[k - 1]) | (d[lead] < best[i + r[lead]])
            at[i + r[lead[new]]], best[i + r[lead[new]]] = c[lead[new]], d[lead[new]]
    return best, at


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _cells(vectors: DataFrame, id_: str, pivots: np.ndarray) -> DataFrame:
    """id, v, cell, far: the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(_matrix(batch.column("v")), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], [*batch.schema.names, "cell", "far"])

    id_type = vectors.schema[id_].dataType.simpleString()
    return vectors.mapInArrow(run, f"`{id_}` {id_type}, v array<double>, cell int, far double")


def _others(found: DataFrame, id_: str, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """id, v, cell of the cells besides a vector's own that may hold a code as near as `best`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, best = np.sqrt(squared(_matrix(batch.column("v")), pivots)), np.sqrt(batch.column("d2").to_numpy())[:, None]
            least = np.maximum(d - high, low - d)
            may = (least <= best + SLACK * (1 + best + d)) & np.isfinite(high)
            may[np.arange(len(d)), batch.column("cell").to_numpy()] = False
            row, cell = np.nonzero(may)
            yield pa.RecordBatch.from_arrays([batch.column(id_).take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32))], [id_, "v", "cell"])

    id_type = found.schema[id_].dataType.simpleString()
    return found.select(id_, "v", "cell", "d2").mapInArrow(run, f"`{id_}` {id_type}, v array<double>, cell int")


def _search(asked: DataFrame, codes: DataFrame, id_: str, code: str, blocks: dict[int, int]) -> DataFrame:
    """id, best struct(d2, code): the nearest code of the cells asked for; `blocks` is into how many each cell's codes are cut."""
    spark = asked.sparkSession
    shares = {r.cell: -(-r.n // SHARE_ROWS) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS rows
    cells = spark.createDataFrame([(c, b, shares.get(c, 1)) for c, b in blocks.items()], "cell int, blocks int, shares int")
    up = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = asked.join(F.broadcast(cells), "cell").withColumn("share", F.pmod(F.xxhash64(id_), F.col("shares")).cast("int")).withColumn("block", F.explode(up("blocks")))
    right = codes.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64(code), F.col("blocks")).cast("int")).withColumn("share", F.explode(up("shares")))
    by, id_type, code_type = ["cell", "block", "share"], asked.schema[id_].dataType.simpleString(), codes.schema[code].dataType.simpleString()

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({id_: [], "d2": [], code: []})
        c = c.sort_values(code)  # the first of equal ones is the lowest
        d, at = nearest_rows(np.array(q["v"].tolist(), float), np.array(c["v"].tolist(), float))
        return pd.DataFrame({id_: q[id_].to_numpy(), "d2": d, code: c[code].to_numpy()[at]})

    met = left.select(*by, id_, "v").groupBy(*by).cogroup(right.select(*by, code, "v").groupBy(*by)).applyInPandas(best, f"`{id_}` {id_type}, d2 double, `{code}` {code_type}")
    return met.groupBy(id_).agg(F.min(F.struct("d2", F.col(code).alias("code"))).alias("best"))


def nearest_by_pivots(vectors: DataFrame, codes: DataFrame, id_: str, code: str, column: str, pivots: int = PIVOTS) -> DataFrame:
    """id, code: the code at the smallest Euclidean distance, the lowest of equal ones; null for a null vector and without codes.

    Ids and codes are unique, vectors of one length and of finite numbers. The pivots are the codes of the smallest hashes; any choice
    gives the same result.
    """
    known = codes.filter(F.col(column).isNotNull()).select(code, F.col(column).cast("array<double>").alias("v"))
    rows = vectors.select(id_, F.col(column).cast("array<double>").alias("v"))
    points = np.array([r.v for r in known.orderBy(F.xxhash64(code), code).limit(pivots).collect()], float)
    if not len(points):
        return rows.select(id_, F.lit(None).cast(codes.schema[code].dataType).alias("code"))
    book = cut(_cells(known, code, points))
    low, high, blocks = np.full(len(points), np.inf), np.full(len(points), -np.inf), {}
    for r in book.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect():  # at most one a pivot
        low[r.cell], high[r.cell], blocks[r.cell] = r.low, r.high, -(-r.n // BLOCK_ROWS)
    homes = _cells(rows.filter("v is not null"), id_, points).drop("far")
    own = _search(homes, book, id_, code, blocks)
    first = cut(homes.join(own, id_).select(id_, "v", "cell", F.col("best.d2").alias("d2"), "best"))
    rest = _search(cut(_others(first, id_, points, low, high)), book, id_, code, blocks)
    best = first.select(id_, "best").unionByName(rest).groupBy(id_).agg(F.min("best").alias("best")).select(id_, F.col("best.code").alias("code"))
    return best.unionByName(rows.filter("v is null").select(id_, F.lit(None).cast(codes.schema[code].dataType).alias("code")))

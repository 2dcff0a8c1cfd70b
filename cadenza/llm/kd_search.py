"""Exact top-k by integer inner product: KD-trees per shard, best-first traversal with box bounds.

A coarse tree of median splits over a bounded sample deals vectors to cells, large cells to shards of bounded size; each shard
holds a KD-tree of median splits whose nodes carry tight bounding boxes. A query first searches one shard of its own cell;
the kth score found there is propagated: cells whose box is bounded below it are passed over with all their shards, of the
others the shards whose root box is; and in those that are left the open node with the largest box-to-query bound is expanded first until none can reach that score or a better kth one.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS = 4_096
BLOCK_ROWS = 128
LEAF_ROWS = 64
SCALE = 1024
#: Vectors and numbers of the sample that the cells are split on; the most cells, and numbers in their boxes, which go to every task.
SAMPLE_ROWS, SAMPLE_NUMBERS, CELLS, BOX_NUMBERS = 32_768, 1 << 22, 8_192, 1 << 23
LEAST = -(2**63)


def _save(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in leaf order, and per node its rows' range, children (-1 for a leaf) and bounding box."""
    order = np.argsort(ids, kind="stable")
    span, kids, low, high = [], [], [], []

    def grow(a: int, b: int) -> int:
        rows, me = x[order[a:b]], len(span)
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        span.append((a, b))
        kids.append((-1, -1))
        low.append(lo)
        high.append(hi)
        if b - a > LEAF_ROWS and (hi > lo).any():
            axis, mid = int(np.argmax(hi - lo)), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, axis], mid)]
            kids[me] = (grow(a, a + mid), grow(a + mid, b))
        return me

    grow(0, len(ids))
    return {"ids": ids[order], "x": x[order], "span": np.array(span), "kids": np.array(kids), "low": np.array(low), "high": np.array(high)}


def search_tree(tree, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[list]:
    """Per query a heap of its at most k best (score, -vec_id) rows of the tree among those that score `floor` or more."""
    ids, x, span, kids = (tree[c] for c in ("ids", "x", "span", "kids"))
    bounds, best = box_bounds(q, tree["low"], tree["high"]), []
    for i in range(len(q)):
        found, bound, me, least = [], bounds[i], qids[i], floor[i]
        open_nodes = [(-bound[0], 0)]
        while open_nodes:
            b, node = heapq.heappop(open_nodes)
            if -b < least:
                break  # every other box is bounded lower still
            left, right = kids[node]
            if left >= 0:
                heapq.heappush(open_nodes, (-bound[left], left))
                heapq.heappush(open_nodes, (-bound[right], right))
                continue
            a, z = span[node]
            scores, own = x[a:z] @ q[i], ids[a:z]
            take = (own != me) & (scores >= least)
            for item in zip(scores[take].tolist(), (-own[take]).tolist()):
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
            if len(found) == k:
                least = max(least, found[0][0])
        best.append(found)
    return best


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): the largest inner product that a point of each box can have."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _matrix(column: pd.Series, dim: int, kind: str) -> np.ndarray:
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    flat = np.concatenate(column.to_list()) if len(column) else np.zeros(0)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out.astype(kind)


def exact_kind(dim: int, x: int, q: int) -> str:
    """A type in which sums of `dim` products of numbers up to `x` and `q` are exact: BLAS on doubles where they stay below 2 ** 53."""
    most = max(1, dim) * max(1, x) * max(1, q)
    return "float64" if most < 2**52 else "int64" if most < 2**62 else "object"


class Cells:
    """A coarse tree of median splits: (node, axis, value) level by level; row numbers of leaves are cells."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.zeros(len(sample), np.int64)
        for level in range(depth):
            axis, value = np.zeros(1 << level, np.int64), np.full(1 << level, 0.0)
            for node in range(1 << level):
                rows = sample[at == node]
                if len(rows):
                    axis[node] = np.argmax(rows.max(axis=0) - rows.min(axis=0))
                    value[node] = np.median(rows[:, axis[node]])
            self.levels.append((axis, value))
            at = 2 * at + (sample[np.arange(len(sample)), axis[at]] > value[at])

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for axis, value in self.levels:
            at = 2 * at + (x[np.arange(len(x)), axis[at]] > value[at])
        return at


def _in_cells(rows: DataFrame, cells: Cells, dim: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=cells.of(_matrix(pdf["v"], dim, "int64")).astype(np.int32))

    return rows.mapInPandas(run, "vec_id long, v array<long>, cell int")


def _tree_of(dim: int, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(pdf["vec_id"].to_numpy(), _matrix(pdf["v"], dim, "int64"))
        low, high = tree["low"][0].tolist(), tree["high"][0].tolist()
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "sub": pdf["sub"].iloc[:1], "low": [low], "high": [high], "image": [_save(**tree)]})

    return run


def _cell_box(dim: int):
    """The box around the root boxes of a cell's shards, and how many there are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = (_matrix(pdf[c], dim, "int64") for c in ("low", "high"))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "subs": [len(pdf)], "low": [low.min(axis=0).tolist()], "high": [high.max(axis=0).tolist()]})

    return run


FOUND = "query_id long, vec_id long, score long"


def _searched(asked: DataFrame, trees: DataFrame, k: int, dim: int, kind: str) -> DataFrame:
    """FOUND rows of (cell, sub, vec_id, v, floor) queries in their shards, BLOCK_ROWS queries and one tree at a time."""
    blocks = asked.groupBy("cell", "sub").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    mine = asked.join(blocks, ["cell", "sub"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    copies = trees.join(blocks, ["cell", "sub"]).select("cell", "sub", "image", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(queries) and len(tree):
            data = np.load(io.BytesIO(tree["image"].iloc[0]))
            held = {c: data[c] for c in data.files}
            for c in ("x", "low", "high"):
                held[c] = held[c].astype(kind)
            qids = queries["vec_id"].to_numpy()
            best = search_tree(held, qids, _matrix(queries["v"], dim, kind), k, queries["floor"].to_numpy())
            rows = [(query, -neg, min(2**63 - 1, max(LEAST, int(score)))) for query, heap in zip(qids.tolist(), best) for score, neg in heap]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["cell", "sub", "block"]
    return mine.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(run, FOUND)


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(1024 * component); rows with a null, an empty or a non-finite vector take no part."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = vectors.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)))
    return fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all candidates but rows of its own id.

    Both sides are (vec_id, v array<long>). Ties go to the smaller vec_id; fewer candidates give fewer rows; shorter
    vectors count as filled up with zeros; empty tables give an empty result. Every candidate is in a tree. Sums are exact
    whatever their size; a score beyond 64 bits is held to the largest or least number of them.
    """
    spark = candidates.sparkSession
    candidates, queries = written(candidates.select("vec_id", "v"), "vectors"), written(queries.select("vec_id", "v"), "queries")
    largest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    (n, dim, x), (m, qdim, q) = (side.agg(F.count("*"), F.max(F.size("v")), largest).first() for side in (candidates, queries))
    dim, kind = max(dim or 0, qdim or 0), exact_kind(max(dim or 0, qdim or 0), x or 0, q or 0)
    most = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, dim)))
    some = candidates.filter(F.xxhash64("vec_id") / 2.0**64 + 0.5 <= min(1.0, 4 * most / max(1, n))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    sample = _matrix(pd.Series([np.array(r[0]) for r in some.select("v").collect()], dtype=object), dim, "int64")  # bounded by SAMPLE_ROWS
    most_cells = min(CELLS, max(1, BOX_NUMBERS // max(1, 2 * dim)))
    depth = min(most_cells.bit_length() - 1, max(0, -(-n // SHARD_ROWS) - 1).bit_length(), max(0, len(sample) // 4).bit_length())
    cells = Cells(sample, depth)
    placed = written(_in_cells(candidates, cells, dim), "cells")
    subs = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * SHARD_ROWS)).cast("int").alias("subs"))  # at most CELLS rows
    dealt = placed.join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))
    trees = written(dealt.groupBy("cell", "sub").applyInPandas(_tree_of(dim, kind), "cell int, sub int, low array<long>, high array<long>, image binary"), "trees")

    home = _in_cells(queries, cells, dim).withColumns({"sub": F.lit(0), "floor": F.lit(LEAST).cast("long")})
    first = written(_searched(home, trees, k, dim, kind), "home-scores")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    bounded = home.drop("floor").join(kth, "vec_id", "left").select("cell", "vec_id", "v", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(LEAST)).alias("floor"))
    root = trees.select("cell", "sub", "low", "high")
    boxes = root.groupBy("cell").applyInPandas(_cell_box(dim), "cell int, subs int, low array<long>, high array<long>").orderBy("cell").toPandas()  # at most CELLS rows
    sent = spark.sparkContext.broadcast((boxes["cell"].to_numpy(), boxes["subs"].to_numpy(), *(_matrix(boxes[c], dim, kind) for c in ("low", "high"))))

    def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, subs, low, high = sent.value
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[a : a + BLOCK_ROWS]
                near = box_bounds(_matrix(part["v"], dim, kind), low, high) >= part["floor"].to_numpy()[:, None]
                own = part["cell"].to_numpy()
                near &= (cell[None] != own[:, None]) | (subs[None] > 1)
                i, j = np.nonzero(near)
                yield pd.DataFrame({"own": own[i], "cell": cell[j], "subs": subs[j], "vec_id": part["vec_id"].to_numpy()[i], "v": part["v"].to_numpy()[i], "floor": part["floor"].to_numpy()[i]})

    def open_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q, low, high = (_matrix(pdf[c], dim, kind) for c in ("v", "low", "high"))
            keep = (np.maximum(q, 0) * high + np.minimum(q, 0) * low).sum(axis=1) >= pdf["floor"].to_numpy()
            yield pdf[["cell", "sub", "vec_id", "v", "floor"]][keep]

    asked = "cell int, sub int, vec_id long, v array<long>, floor long"
    reached = written(bounded.mapInPandas(reaching, "own int, cell int, subs int, vec_id long, v array<long>, floor long"), "reached")
    whole = reached.filter("subs = 1").select("cell", F.lit(0).alias("sub"), "vec_id", "v", "floor")
    parts = reached.filter("subs > 1").join(root, "cell").filter("cell != own or sub != 0").drop("own", "subs").mapInPandas(open_boxes, asked)
    others = whole.unionByName(parts)
    found = first.unionByName(_searched(written(others, "asked"), trees, k, dim, kind))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

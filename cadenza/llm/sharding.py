"""Contiguous shards of near equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

#: Rows of a range partition, about, and the most partitions, whose totals are added up in one task and broadcast.
PART_ROWS, PARTS = 50_000, 100_000
#: Bytes that every row weighs besides its text.
ROW_BYTES = 8

SUMMED = "doc_id long, size long, text_crc32 long, part int, upto long, nth long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with its number, the bytes up to each row and its place; two numbers are held."""
    part, upto, nth = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sums = pc.add(pc.cumulative_sum(batch.column("size")), upto)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(np.full(batch.num_rows, part, np.int32)), sums, pa.array(np.arange(nth, nth + batch.num_rows))],
            ["doc_id", "size", "text_crc32", "part", "upto", "nth"],
        )
        if batch.num_rows:
            upto, nth = sums[-1].as_py(), nth + batch.num_rows


def assign_shards(docs: DataFrame, shards: int = 24, order: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`.

    Law `bytes`: in the order of `order` (null first; ties by checksum, then size), a row goes to the shard in whose
    equal share of all bytes its middle byte falls, so shards are contiguous and differ by less than one row from the
    target. Sizes are UTF-8 bytes plus 8, null text has no bytes. `slot` counts from 0 in each shard. A table with fewer
    rows than shards leaves shards empty; an empty table gives an empty result. Other columns are ignored.

    Rows are dealt to partitions by ranges of that order, rows that repeat by their place in the input, so a doc_id of very
    many rows takes several partitions.
    """
    rows = docs.select(
        quoted(order).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    parts = min(PARTS, max(1, -(-rows.count() // PART_ROWS)))
    by = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("tie").asc()]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")
    summed = written(ordered.mapInArrow(_running, SUMMED), "sizes")
    totals = summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # at most PARTS rows
    before, everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(everything).alias("all_bytes"))
    middle2 = 2 * (F.col("byte0") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle2.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes")))).cast("int")
    placed = summed.join(F.broadcast(offsets), "part").select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row0") + F.col("nth")).alias("global_row"))
    first = placed.groupBy("shard").agg(F.min("global_row").alias("shard_row0"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("global_row") - F.col("shard_row0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

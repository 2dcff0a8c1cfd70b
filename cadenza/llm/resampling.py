"""Importance resampling towards a target distribution, over hashed runs of words.

A vectorised byte automaton makes the features: a lookup table classes the bytes of an Arrow text buffer, differences of the
classes are the words' bounds, and the CRC registers of all words advance together, one byte of each at a time, by the CRC's
table. Buckets are counted over the corpus and the target; a document's weight is the mean gain of its features, and a
Gumbel draw added to it makes the highest scores a weighted sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS = 10_000
#: Of the documents with so many words, so many in a hundred are drawn.
LEAST_WORDS, DRAWN_PERCENT = 20, 25
SEED = "7:"
#: Bytes that the automaton works on at a time, and words that are too few to go on side by side.
BLOCK_BYTES, FEW = 1 << 20, 8
#: Rows of a range partition of the ranking, about, and the most partitions, whose totals are added up in one task and broadcast.
PART_ROWS, PARTS = 100_000, 100_000

SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
#: Digits, small letters and all bytes of letters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def crc_table() -> np.ndarray:
    """The CRC-32 step of each byte, by the bitwise rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


TABLE, ONES = crc_table(), np.uint32(0xFFFFFFFF)


def step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return TABLE[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))


def advance(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC registers after data[start : start + size], all starts advanced together; a few very long words go on alone."""
    order = np.argsort(-sizes, kind="stable")
    crc, at, size = crc[order], starts[order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    j, left = 0, len(size)
    while j < longest and (left := int(np.searchsorted(-size, -j, "left"))) > FEW:
        crc[:left] = step(crc[:left], data[at[:left] + j])
        j += 1
    for k in range(left if j < longest else 0):
        crc[k] = np.uint32(zlib.crc32(data[at[k] + j : at[k] + size[k]], int(crc[k] ^ ONES))) ^ ONES
    out = np.empty_like(crc)
    out[order] = crc
    return out


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text of each word of small-lettered `data`; `offsets` are the texts' bounds."""
    base, inside = int(offsets[0]), IN_WORD[data[offsets[0] : offsets[-1]]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside), bool)
    cut[(offsets[:-1] - base)[offsets[:-1] < offsets[-1]]] = True  # a text's first byte begins a word, whatever is before it
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    next_cut = np.concatenate([cut[1:], [True]])
    starts = np.flatnonzero(inside & (~before | cut)) + base
    ends = np.flatnonzero(inside & (~after | next_cut)) + base + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(bounds, first text, whether its first word has been counted) of pieces of about BLOCK_BYTES.

    A longer text is cut between words, and a piece of it begins with the last word of the piece before.
    """
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK_BYTES, "right")) - 1)
        if offsets[k + 1] - offsets[k] <= BLOCK_BYTES:
            yield offsets[k : stop + 1], k, False
            k = stop
            continue
        lo, hi, again = int(offsets[k]), int(offsets[k + 1]), False
        while True:
            size = BLOCK_BYTES
            while lo + size < hi:
                gaps = np.flatnonzero(~IN_WORD[data[lo : lo + size]])
                end = lo + int(gaps[-1]) if len(gaps) else lo
                starts, _, _ = words_in(data, np.array([lo, end]))
                if len(starts) > 1 or end > lo and not len(starts) and not again:
                    break
                size *= 2
            else:
                yield np.array([lo, hi]), k, again
                break
            yield np.array([lo, end]), k, again
            lo, again = (int(starts[-1]), True) if len(starts) else (end, False)
        k += 1


def features_of(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of one or two words of a column of texts, block by block; null is empty."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = SMALL[np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    for bounds, first, again in blocks(data, offsets - offsets[0]):
        starts, sizes, row = words_in(data, bounds)
        one = advance(np.full(len(starts), ONES), data, starts, sizes)
        pair = np.flatnonzero(row[1:] == row[:-1])
        two = advance(step(one[pair], 32), data, starts[pair + 1], sizes[pair + 1])
        own = slice(1 if again else 0, None)
        yield first + np.concatenate([row[own], row[pair]]), (np.concatenate([one[own], two]) ^ ONES) % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame) -> dict[int, int]:
    """Features of each bucket that has any, over the whole column `text`: at most BUCKETS entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets in features_of(batch.column("text")):
                total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return {r.bucket: r.n for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over that in the corpus, one added to each bucket; rounded down."""
    all_s, all_t = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    ratio = lambda b: float(target.get(b, 0) + 1) * all_s / (float(corpus.get(b, 0) + 1) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight of every row: the mean gain of its features, rounded down; 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for rows, buckets in features_of(batch.column("text")):
                n += np.bincount(rows, minlength=batch.num_rows)
                total += np.bincount(rows, gain[buckets], batch.num_rows)  # whole numbers, exact below 2^53
            weight = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, weight long")


def ranked(rows: DataFrame, score: str, most: int) -> DataFrame:
    """`rows` plus rank: 1, 2, .. of the `most` highest scores, ties to the smaller doc_id (null first); null for the others.

    Rows are dealt to ranges of that order, rows that tie by their place in the table as well, and the rows of the ranges before
    are added to a row's place in its own. `rows` must be a written table, so that it is the same each time it is read.
    """
    by = [F.col(score).desc(), F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    parts = min(PARTS, max(1, -(-rows.count() // PART_ROWS)))
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # at most PARTS rows
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`, drawn towards the texts of `target`.

    Words are runs of digits, letters a to z (A to Z count as these) and anything beyond ASCII. A text without words, an empty and a
    null text has no features and weight 0. The draw hashes doc_id: rows that repeat a doc_id share it, a null doc_id hashes as an
    empty one. Documents under LEAST_WORDS words have a score and never a rank. Other columns are ignored; an empty table gives no
    rows, and an empty target makes every bucket's gain depend on the corpus alone.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed(docs, gain).withColumn("score", F.col("weight") + gumbel), "scores")
    enough = F.col("n_features") >= 2 * LEAST_WORDS - 1
    able = scored.filter(enough)
    drawn = able.count() * DRAWN_PERCENT // 100
    return ranked(able, "score", drawn).unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def selected(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id and rank of the documents drawn."""
    return resample(docs, target).filter("rank IS NOT NULL").select("doc_id", "rank")

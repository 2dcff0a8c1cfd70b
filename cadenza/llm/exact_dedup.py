"""Exact dedup against a history: a minimal perfect hash per digest shard, with byte-checked lookups.

The history's distinct SHA-256 digests are dealt to shards by their leading bytes. Each shard holds a minimal perfect
hash (levels of bit arrays: a key is placed at the first level where it meets no other key, its slot is the rank of
its bit), and its slots hold the full digest, the winner's locator (doc_id) and counts. New digests are looked up by
shard: a slot whose 32 bytes are equal is a repeat, all others are nonmembers and form groups of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, join_groups, unboxed, written

#: Distinct digests in a shard: bounds the memory of one build or lookup.
SHARD_ROWS = 40_000
#: Bits of a level for each key that reaches it.
GAMMA = 2.0

GROUP = "digest binary, named boolean, keep_id long, group_size long, ties long"
FIELDS = ["named", "keep_id", "group_size", "ties"]


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.reshape(-1, 32).view("<u8")


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(bits)).astype(np.int64)


def build_mph(digests: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Levels (bit array, slots before it) of a minimal perfect hash over distinct 32-byte digests."""
    left, levels, before = _words(digests), [], 0
    while len(left):
        bits = int(GAMMA * len(left)) + 1
        at = _place(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append((alone, before))
        before += int(alone.sum())
        left = left[~alone[at]]
    return levels


def slots_of(levels: list[tuple[np.ndarray, int]], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level claims it. A nonmember may get a slot: compare the stored digest."""
    words = _words(digests)
    out, todo = np.full(len(words), -1, np.int64), np.arange(len(words))
    for k, (alone, before) in enumerate(levels):
        at = _place(words[todo], k, len(alone))
        hit = alone[at]
        out[todo[hit]] = before + (np.cumsum(alone) - 1)[at[hit]]
        todo = todo[~hit]
    return out


def _digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32).copy()


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _digests(pdf["digest"])
    levels = build_mph(digests)
    at = slots_of(levels, digests)
    order = np.argsort(at)
    image = {"levels": levels, "digests": digests[order], **{c: pdf[c].to_numpy()[order] for c in FIELDS}}
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "image": [pickle.dumps(image)]})


def _look_up(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard after the new rows: every slot, then the nonmembers."""
    if not len(index):
        return new[["digest", *FIELDS]]
    image = pickle.loads(index["image"].iloc[0])
    stored, named, keep, count, ties = (image[c].copy() for c in ("digests", *FIELDS))
    out = []
    if len(new):
        digests = _digests(new["digest"])
        at = slots_of(image["levels"], digests)
        member = at >= 0
        member[member] = (stored[at[member]] == digests[member]).all(axis=1)
        slot, theirs = at[member], new[member]
        has, best, num, tie = (theirs[c].to_numpy() for c in FIELDS)
        same = (has == named[slot]) & (best == keep[slot])
        wins = (has & ~named[slot]) | ((has == named[slot]) & (best > keep[slot]))
        ties[slot] = np.where(wins, tie, np.where(same, ties[slot] + tie, ties[slot]))
        keep[slot], named[slot] = np.where(wins, best, keep[slot]), has | named[slot]
        count[slot] += num
        out.append(new.loc[~member, ["digest", *FIELDS]])
    out.insert(0, pd.DataFrame({"digest": [d.tobytes() for d in stored], "named": named, "keep_id": keep, "group_size": count, "ties": ties}))
    return pd.concat(out, ignore_index=True)


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest, combined before the shuffle: the largest doc_id wins; `named` is false where all are null."""
    per_id = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    largest = F.max("doc_id")
    return per_id.groupBy("digest").agg(largest.isNotNull().alias("named"), F.coalesce(largest, F.lit(0)).alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "doc_id"), F.sum("n")).alias("ties"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """(shard, image) of the history's digest groups."""
    return _sharded(_groups(history), shards).groupBy("shard").applyInPandas(_build, "shard int, image binary")


def look_up(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """Digest groups after `new` rows (doc_id, digest): members update their slot, nonmembers group separately."""
    fresh = _sharded(_groups(new), shards)
    return index.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInPandas(_look_up, GROUP)


def duplicate_groups(docs: DataFrame, history_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows with digests, digest groups) of `docs`.

    The rows whose doc_id hashes below `history_share` of all hashes are the history that is indexed, the rest is looked up;
    every row is in one of the two, and the groups do not depend on the split. An empty table gives no groups.
    """
    rows = written(digest_rows(docs), "digests")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    old = F.pmod(F.xxhash64(F.lit("history"), "doc_id"), F.lit(1 << 20)) < int(history_share * (1 << 20))
    index = build_index(rows.filter(old), shards)
    groups = look_up(index, rows.filter(~old), shards).withColumn("keep_id", F.when(F.col("named"), F.col("keep_id"))).drop("named")
    return rows, written(groups, "digest-groups")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`.

    Texts are equal when their bytes are; null and empty texts are equal. The row with the largest doc_id stays. Rows
    that repeat doc_id and text are one document and carry the same flags. A null doc_id ranks below all others and
    stays null. Other columns are ignored.
    """
    rows, groups = duplicate_groups(docs)
    out = join_groups(rows, groups, "digest", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns as they are: of equal texts the one of the largest doc_id.

    Of rows that repeat doc_id and text one stays; a null doc_id ranks below all others.
    """
    _, groups = duplicate_groups(docs)
    whole = boxed(docs).withColumn("digest", _digest("row.text")).alias("w")
    same = (F.col("w.digest") == F.col("g.digest")) & F.col("w.row.doc_id").cast("long").eqNullSafe(F.col("g.keep_id"))
    kept = whole.join(groups.alias("g"), same).select("w.row", "w.digest")
    if not groups.filter("ties > 1").isEmpty():  # a table that repeats whole rows
        kept = kept.dropDuplicates(["digest"])
    return unboxed(kept)

"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Documents go through a fingerprint-routed RDD: texts are dealt to partitions by xxhash, and a partition keeps for each
fingerprint a chain of full texts with their smallest id, so that rows of any larger id are known to repeat. Failures are
five bits of a mask; `combineByKey` adds up masks as count vectors, one for each part, and all orders follow from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filters; the place in this string is the filter's bit.
FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: A: fewer words than this. B: of a hundred words fewer distinct ones. C: of a hundred code points more capitals.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 3
MARKS, CAPITALS, CONTINUATION = b"#$%&*|", bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Bytes of texts that a task gathers before it sends them on, and that a partition of the shuffle is meant to hold.
HELD_BYTES, PART_BYTES = 48 << 20, 64 << 20
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: bytes) -> int:
    """The mask of A to D, which a text decides alone."""
    words = text.split()  # of bytes: at \x20 and \x09 to \x0D, no others
    chars, capitals = len(text.translate(None, CONTINUATION)), len(text) - len(text.translate(None, CAPITALS))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_SHARE * len(words), 100 * capitals > CAPITAL_SHARE * chars, len(text.translate(None, MARKS)) < len(text))
    return sum(1 << i for i, x in enumerate(fails) if x)


class Chains:
    """For each fingerprint the different texts seen, each with its mask, its smallest id and how many rows of each part have that id."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, mask: int | None, doc_id: int, parts: dict[str, int]) -> Iterator[tuple[int, int, dict[str, int]]]:
        """Takes in rows of a text; gives (doc_id, mask, parts) of those that are now known to repeat a smaller id's text."""
        chain = self.by_print.setdefault(key, [])
        for held in chain:
            if held[0] == text:
                if doc_id == held[2]:
                    for part, n in parts.items():
                        held[3][part] = held[3].get(part, 0) + n
                elif doc_id > held[2]:
                    yield doc_id, held[1] | REPEAT, parts
                else:
                    yield held[2], held[1] | REPEAT, held[3]
                    held[2:] = doc_id, dict(parts)
                return
        chain.append([text, own_failures(text) if mask is None else mask, doc_id, dict(parts)])
        self.bytes += len(text) + 200

    def drain(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.by_print.items():
            for held in chain:
                yield key, held
        self.by_print, self.bytes = {}, 0


def _spread(doc_id: int, key: int) -> int:
    return xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), key & 0xFFFF)


def route(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(route, (text, mask, doc_id, parts)) of a task's rows: one record for each text, under its fingerprint; rows that the task itself
    knows to repeat, and rows without an id, go without text under any route."""
    chains, nameless = Chains(), {}
    for doc_id, part, text in rows:
        text = bytes(text)
        if doc_id is None:  # neither smaller nor larger than another id
            at = own_failures(text), part
            nameless[at] = nameless.get(at, 0) + 1
            continue
        key = xxhash.xxh64_intdigest(text)
        for i, mask, parts in chains.add(key, text, None, doc_id, {part: 1}):
            yield _spread(i, key), (None, mask, i, parts)
        if chains.bytes > HELD_BYTES:
            for key, held in chains.drain():
                yield key, tuple(held)
    for key, held in chains.drain():
        yield key, tuple(held)
    for k, ((mask, part), n) in enumerate(nameless.items()):
        yield k, (None, mask, None, {part: n})


def settle(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of one partition's records, each row counted once."""
    chains = Chains()
    for key, (text, mask, doc_id, parts) in records:
        done = [(doc_id, mask, parts)] if text is None else chains.add(key, text, mask, doc_id, parts)
        for i, m, counted in done:
            for part, n in counted.items():
                yield i, part, m, n
    for _, (_, mask, doc_id, parts) in chains.drain():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def failure_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): n rows of `docs` with this doc_id and lang fail the filters whose bits are set."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    settled = rows.rdd.mapPartitions(route).partitionBy(parts, lambda key: key).mapPartitions(settle)
    return spark.createDataFrame(settled, "doc_id long, part string, mask int, n long", verifySchema=False)


def _zero(value: tuple[int, int]) -> np.ndarray:
    return _count(np.zeros(4 << len(FILTERS), np.int64), value)


def _count(vector: np.ndarray, value: tuple[int, int]) -> np.ndarray:
    vector[value[0]] += value[1]
    return vector


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def orders_of(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of AUDIT of one part, from its counts by (good, toxic, mask)."""
    by = counts.reshape(2, 2, -1)
    every, good, toxic = by.sum(axis=(0, 1)), by[1].sum(axis=0), by[:, 1].sum(axis=0)
    mask = np.arange(len(every))
    steps, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        gone = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, earlier = (mask & bit) > 0, (mask & gone) > 0
            here = fails & ~earlier
            gone |= bit
            removed = int(every[here].sum())
            total[name] += removed
            steps.append((name, ("".join(order), step, int(every[(mask & gone) == 0].sum()), removed, int(every[fails & earlier].sum()), int(every[bit]), int(good[here].sum()), int(toxic[here].sum()))))
    for name, values in steps:
        yield part, *values, total[name]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of AUDIT of `docs` (doc_id, text, lang), for each lang value, each of 120 orders and each step.

    Filters: A few words, B few distinct words, C many capitals, D holds a mark, E the text of a smaller doc_id anywhere in the
    table. Null text is empty, null lang is the empty part. A null doc_id is neither smaller nor larger than another, so such
    rows never fail E; nor do rows that repeat the smallest doc_id. A document is good or toxic when any of its label rows says
    1. Other columns are ignored; an empty table gives no rows. Very long texts are compared whole.
    """
    says = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).cast("int").alias(c)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    coded = failure_rows(docs).join(marks, "doc_id", "left")
    code = ((F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0))) * (1 << len(FILTERS)) + F.col("mask")).cast("int")
    counted = coded.select("part", code, "n").rdd.map(lambda r: (r[0], (r[1], r[2])))
    vectors = counted.combineByKey(_zero, _count, _merge)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: orders_of(*kv)), AUDIT, verifySchema=False)

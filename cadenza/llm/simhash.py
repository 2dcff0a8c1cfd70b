"""SimHash near-dedup by a generalised pigeonhole over 64-bit fingerprints.

Correlated bits are grouped into partitions. If two fingerprints differ in at most T bits and partition i is given the
threshold t_i with sum(t_i + 1) = T + 1, they differ by at most t_i in some partition i. The thresholds are unequal:
a dynamic program picks, from a sample's distances, those with the fewest estimated probes and candidates; a partition
given -1 is not probed. Each fingerprint is indexed under its own partition values and probes those within t_i;
what meets is verified on all 64 bits. Links become components by alternating star contraction.

A word-shingle similarity asks for more bits, as at 0.8 about 15 in 100 of them differ. `keep_similar` takes sketches of SKETCH bits over
the set of shingles and links those whose distance speaks for the similarity. Partitions of bits do not scale there: unlike sketches agree
in half of all bits, so at a stated probability of meeting either the pairs that meet or the values to probe (`sketch_plan`) outgrow the rows. Sketches
are compared where the sets share a band of least hashes, which unlike sets do not, so rows and pairs grow with the texts and their likeness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, join_groups, unboxed, written
from .shingles import LANES, SKETCH, bands, bands_needed, pieces, shingle_set, shingle_sets
from .shingles import sketches as sketches_of

BITS = 64
#: Fingerprints (those of the smallest hashes) on which bits are grouped and candidates estimated; not a limit on links.
SAMPLE = 3_000
#: Cost of a probe in verified candidates: a probe is shuffled and sorted.
PROBE_COST = 60.0
#: A bucket with more index rows than this is split over several keys.
BUCKET_ROWS = 20_000
#: Candidates verified at a time.
PAIRS = 1 << 21
#: Pairs of sketches compared at a time; of the near ones among them a task holds no more than two a row of its bucket beside.
NEAR_PAIRS = 1 << 19


def fingerprint_bytes(text: bytes, width: int) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half of the shingles' hashes, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):  # a very long text is taken piece by piece
        z = min(n, a + (1 << 16))
        ends = end[np.minimum(np.arange(a, z) + width - 1, len(words) - 1)]
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(start[a:z].tolist(), ends.tolist())], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def text_hash(text: str):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp as signed long) of every row's whole text; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_bytes(t.encode(), width) if t is not None else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """BITS bit numbers in `parts` groups of near equal size, correlated bits together."""
    on = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if len(on):
        on -= on.mean(axis=0)
    norm = np.sqrt((on**2).sum(axis=0)) + 1e-9
    link = np.abs(on.T @ on) / np.outer(norm, norm)
    np.fill_diagonal(link, 0)
    left, groups = set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        free = sorted(left)
        group = [max(free, key=lambda b: link[b, free].sum())]
        while len(group) < size:
            free = sorted(left - set(group))
            group.append(max(free, key=lambda b: link[b, group].sum()))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least total cost; cost[i][r + 1] is that of t_i = r."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for r in range(-1, distance - spent + 1):
                if r + 1 >= len(own):
                    break
                new = (total + own[r + 1], [*chosen, r])
                if spent + r + 1 not in step or new < step[spent + r + 1]:
                    step[spent + r + 1] = new
        best = step
    return best[distance + 1][1]


def plan(sample: np.ndarray, rows: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, of the cheapest number of partitions."""
    choices = []
    some = sample[:1500]
    for parts in range(2, distance + 2):
        groups, cost = group_bits(sample, parts), []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            apart = np.bitwise_count((some[:, None] ^ some[None]) & mask)[np.triu_indices(len(some), 1)] if len(some) > 1 else np.zeros(0, np.uint8)
            near = np.cumsum(np.bincount(apart, minlength=BITS + 1)) / max(1, len(apart))
            own, ball = [0.0], 0
            for r in range(distance + 1):
                ball += comb(len(bits), r)
                even = ball / 2.0 ** len(bits)
                own.append(rows * (PROBE_COST * ball + rows * max(even, float(near[r]) if len(apart) * even > 30 else even)))
            cost.append(own)
        chosen = allocate(cost, distance)
        choices.append((sum(c[t + 1] for c, t in zip(cost, chosen)), parts, [(b, t) for b, t in zip(groups, chosen) if t >= 0]))
    return min(choices, key=lambda c: c[:2])[2]


def _deal(layout: list[tuple[list[int], int]]):
    """Index and probe rows of fingerprints: (part, value, probe, node, fp)."""
    masks = [np.uint64(sum(1 << b for b in bits)) for bits, _ in layout]
    balls = [np.array([sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(bits, r)], np.uint64) for bits, t in layout]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
            for part, (mask, ball) in enumerate(zip(masks, balls)):
                value = fp & mask
                for probe, flip in ((False, np.uint64(0)), *((True, f) for f in ball)):
                    yield pd.DataFrame({"part": np.full(len(fp), part, np.int32), "value": (value ^ flip).view(np.int64), "probe": probe, "node": node, "fp": fp.view(np.int64)})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, its component's smallest node) that connect what a and b connect: never more than nodes."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[x], label[y])
        np.minimum.at(low, label[y], label[x])
        low = low[low[low]]
        new = low[label]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _verify(distance: int):
    """Rows arrive by (part, value, block), index rows before probes; emits a spanning forest of the verified links."""

    def pairs(lo: np.ndarray, count: np.ndarray, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left, right) positions: row i[k] against the count[k] rows from lo[k] on, PAIRS at a time."""
        upto = np.cumsum(count)
        a = 0
        while a < len(i):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            c = count[a:z]
            right = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[a:z], c)
            yield np.repeat(i[a:z], c), right
            a = z

    def solve(pdf: pd.DataFrame) -> pd.DataFrame | None:
        fp, node, probe = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy(), pdf["probe"].to_numpy()
        key = pdf[["part", "value", "block"]]
        start = np.flatnonzero(np.r_[True, (key.to_numpy()[1:] != key.to_numpy()[:-1]).any(axis=1)])
        group = np.cumsum(np.isin(np.arange(len(fp)), start)) - 1
        held = np.bincount(group, weights=~probe, minlength=len(start)).astype(np.int64)  # index rows come first
        at = np.arange(len(fp))
        # an index row meets the index rows before it, a probe all of them
        count = np.where(probe, held[group], np.minimum(at - start[group], held[group]))
        found_a, found_b = [], []
        for x, y in pairs(start[group], count, at):
            ok = (np.bitwise_count(fp[x] ^ fp[y]) <= distance) & (node[x] != node[y])
            found_a.append(node[x[ok]])
            found_b.append(node[y[ok]])
            if sum(map(len, found_a)) > PAIRS:
                found_a, found_b = map(lambda e: [e], _forest(np.concatenate(found_a), np.concatenate(found_b)))
        if not found_a:
            return None
        a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
        return pd.DataFrame({"a": a, "b": b}) if len(a) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            keys = pdf[["part", "value", "block"]].to_numpy()
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if rest and (keys[0] != rest[0][["part", "value", "block"]].to_numpy()[0]).any():
                done, rest = pd.concat(rest, ignore_index=True), []
                if (out := solve(done)) is not None:
                    yield out
            cutoff = last[-1] + 1 if len(last) else 0
            if cutoff:
                done, rest = pd.concat([*rest, pdf.iloc[:cutoff]], ignore_index=True), []
                if (out := solve(done)) is not None:
                    yield out
            rest.append(pdf.iloc[cutoff:])
        if rest and (out := solve(pd.concat(rest, ignore_index=True))) is not None:
            yield out

    return run


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) among (node, fp) rows of distinct fingerprints: their components are those of all links <= distance."""
    n = nodes.count()
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()]
    layout = plan(np.array(sample, np.int64).view(np.uint64), n, distance)
    dealt = nodes.mapInPandas(_deal(layout), "part int, value long, probe boolean, node long, fp long")
    # A bucket of many index rows is split into blocks of them; each of its probes, and each index row, visits every block.
    sizes = nodes.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("value")) for p, (bits, _) in enumerate(layout)])).alias("k")).groupBy("k.part", "k.value").count()
    hot = sizes.filter(F.col("count") > BUCKET_ROWS).select("part", "value", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("blocks"))
    if hot.isEmpty():
        keyed = dealt.withColumn("block", F.lit(0))
    else:
        split = dealt.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        visits = F.transform(every, lambda b: F.struct(b.alias("block"), (F.col("probe") | (b != home)).alias("probe")))
        keyed = split.withColumn("v", F.explode(visits)).select("part", "value", "node", "fp", "v.block", "v.probe")
    ordered = keyed.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "probe")
    return ordered.mapInPandas(_verify(distance), "a long, b long").distinct()


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def components(edges: DataFrame) -> DataFrame:
    """(node, component = smallest node reachable) of all nodes in `edges` (a, b), by alternating large and small stars."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now, before = cut(edges.filter("a != b").distinct()), None
    while True:
        # large star: neighbours above u hang on u's smallest neighbour (or u)
        around = both(now)
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_groups(around.filter("v > u"), low, "u", "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()  # hubs are salted
        # small star: u and its smaller neighbours hang on the smallest of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = cut(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    star = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return star.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def near_groups(docs: DataFrame, width: int = 4, distance: int = 4) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, fp) rows, groups (fp, component, copies, component_id)) of `docs`.

    Nodes are fingerprints, as ids can be null or repeat; component_id is the smallest id of a component, null if it has none.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct-fingerprints")
    parts = components(links(distinct.select(F.col("fp").alias("node"), "fp"), distance)).withColumnRenamed("node", "fp")
    groups = written(distinct.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "copies", "least"), "fingerprint-groups")
    sizes = groups.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_groups(groups.drop("least"), written(sizes, "components"), "component", "members").select("fp", "component", "copies", "component_id")
    return rows, written(named, "near-groups")


def near_dedup(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `docs`.

    Fewer words than a shingle make one shingle; no words, empty and null text have fingerprint zero, which links like any
    other. A null doc_id stays null and names no component: component_id is the smallest other id, or null if there is none. Rows
    that repeat are linked; texts that are not near stay apart, even if they have no id or share one. Other columns are ignored.
    """
    rows, groups = near_groups(docs, width, distance)
    return join_groups(rows, groups, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The least probability with which two sets at the bound of similarity share a band (`sketch_plan`: meet in a partition).
MEET = 0.99
#: Standard deviations of the distance at the bound: sketches so far under its mean are alike without doubt, those so far over it are not;
#: between them the shingle sets themselves decide.
SURE, MARGIN = 4.0, 3.0
#: Rows of a bucket that one task links at a time; those of a bucket that a sample shows to be larger are dealt to several tasks.
LINK_ROWS = 40_000
#: Rows up to which all pairs of a bucket are compared at once; more are first held against single ones.
ALL_PAIRS = 1_024
#: Rows up to which the pairs of a bucket are compared together with those of other buckets.
FEW_ROWS = 6
#: Nodes on which large buckets are seen.
SEEN = 20_000


def apart(similarity: float) -> float:
    """The share of bits in which sketches of sets of equal size and that Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, node = hash of the shingle set, sketch, bands) of every row's whole text; null text has no words."""
    count = bands_needed(similarity, MEET)

    def made(texts: list[bytes]) -> pa.RecordBatch:
        sets, at = shingle_sets(texts, width)
        nodes = [xxhash.xxh64_intdigest(own.tobytes()) for own in np.split(sets, at[1:])]
        shared = pa.ListArray.from_arrays(np.arange(0, count * len(at) + 1, count, dtype=np.int32), bands(sets, at, count).ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([w.tobytes() for w in sketches_of(sets, at)], pa.binary()), shared], ["node", "sketch", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for texts in pieces(batch.column("text")):
                new, old = made(texts), batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([old.column("doc_id"), old.column("text_hash"), *new.columns], ["doc_id", "text_hash", *new.schema.names])
                row += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, node long, sketch binary, bands array<long>")


def sketch_plan(sample: np.ndarray, rows: int, differ: float) -> list[tuple[list[int], int]]:
    """(bits, threshold 0 or 1) of partitions of sketches (sample rows, LANES) to probe, so that pairs at the bound meet.

    `keep_similar` has bands of least hashes instead: on check_l's texts this takes 32 values a row up to a million rows and 207 at three million.
    """
    on = np.unpackbits(sample.view(np.uint8), axis=1, bitorder="little")
    some, grid, need = on[:600].astype(np.float32), 64, -np.log(1 - MEET)
    choices = []
    for size in range(10, 23):
        parts, cost, gain = SKETCH // size, [], []
        for bits in wide_groups(on, parts, size):
            own = some[:, bits]
            ones = own.sum(axis=1)
            far = (ones[:, None] + ones[None] - 2 * own @ own.T)[np.triu_indices(len(own), 1)]
            exact = (1 - differ) ** size
            q = [0.0, exact, exact + size * differ * (1 - differ) ** (size - 1)]
            seen = [0.0, *(float((far <= r).mean()) if len(far) else 0.0 for r in (0, 1))]
            balls = [0, 1, 1 + size]
            cost.append([rows * (PROBE_COST * ball + rows * max(near, ball / 2.0**size)) for ball, near in zip(balls, seen)])
            gain.append([int(-np.log(1 - x) / need * grid) for x in q])
        best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c, g in zip(cost, gain):
            step: dict[int, tuple[float, list[int]]] = {}
            for done, (total, chosen) in best.items():
                for k in range(3):
                    at, new = min(grid, done + g[k]), (total + c[k], [*chosen, k - 1])
                    if at not in step or new < step[at]:
                        step[at] = new
            best = step
        if grid in best:
            choices.append((best[grid][0], size, [(b, t) for b, t in zip(wide_groups(on, parts, size), best[grid][1]) if t >= 0]))
    return min(choices, key=lambda c: c[:2])[2]


def wide_groups(on: np.ndarray, parts: int, size: int) -> list[list[int]]:
    """`parts` groups of `size` bits of a sketch, each grown from its most common bit by those most correlated with it."""
    centred = on.astype(np.float32) - on.mean(axis=0) if len(on) else np.zeros((1, SKETCH), np.float32)
    norm = np.sqrt((centred**2).sum(axis=0)) + 1e-6
    link = np.abs(centred.T @ centred) / np.outer(norm, norm)
    np.fill_diagonal(link, 0)
    free, groups = np.ones(SKETCH, bool), []
    for _ in range(parts):
        start = int(np.argmax(np.where(free, link.sum(axis=1), -1)))
        free[start] = False
        group, pull = [start], link[start].copy()
        while len(group) < size:
            b = int(np.argmax(np.where(free, pull, -1)))
            free[b] = False
            group.append(b)
            pull += link[b]
        groups.append(sorted(group))
    return groups


def _near(words: np.ndarray, i: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, distance) of positions: rows `i` against all rows, those at most `distance` apart; NEAR_PAIRS are compared at a time."""
    step = max(1, NEAR_PAIRS // max(1, len(words)))
    for a in range(0, len(i), step):
        own = i[a : a + step]
        far = np.bitwise_count(words[own, 0][:, None] ^ words[None, :, 0])
        for lane in (1, 2):  # unlike sketches are mostly told by three lanes
            far += np.bitwise_count(words[own, lane][:, None] ^ words[None, :, lane])
        x, y = np.nonzero(far <= distance)
        total = far[x, y].astype(np.uint16)
        for lane in range(3, LANES):
            total = total + np.bitwise_count(words[own[x], lane] ^ words[y, lane])
            keep = total <= distance
            x, y, total = x[keep], y[keep], total[keep]
        yield own[x], y, total.astype(np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that the edges connect each of n positions with."""
    label = np.arange(n)
    node, low = _forest(a, b) if len(a) else (a, b)
    label[node] = low
    return label


def likeliest(label: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of pairs between groups, the places of those to look at first: the nearest of each row, and a least spanning forest of the groups.

    There are fewer than two a row.
    """
    order = np.argsort(far, kind="stable")
    a, b = a[order], b[order]
    rank = np.r_[np.arange(len(a)), np.arange(len(b))]
    best = np.full(len(label), len(a))
    np.minimum.at(best, np.r_[a, b], rank)
    chosen = [best[best < len(a)]]
    group = label.copy()
    while True:
        x, y = group[a], group[b]
        cross = np.flatnonzero(x != y)
        if not len(cross):
            break
        least = np.full(len(label), len(a))
        np.minimum.at(least, np.r_[x[cross], y[cross]], np.r_[cross, cross])
        taken = np.unique(least[least < len(a)])
        chosen.append(taken)
        group = _labels(len(label), x[taken], y[taken])[group]
    return order[np.unique(np.concatenate(chosen))]


def link_bucket(node: np.ndarray, words: np.ndarray, sure: int, distance: int, left_open: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) edges: some that connect what sketches at most `sure` apart connect, never more than rows; and of the pairs at most
    `distance` apart between groups so connected, the likeliest, which are not sure. The nodes of the other pairs go to `left_open`:
    `open_pairs` looks at these pairs once it is known what the likeliest connect.

    In a large bucket single rows are first held against all: what surely hangs together through them needs no pairs of its own, so
    only the rows outside the largest group are then compared with all.
    """
    n = len(node)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.arange(n)
    if n > ALL_PAIRS:
        open_, seen = np.ones(n, bool), 0
        label = np.arange(n)
        while open_.any() and seen < 64:
            for a, b, _ in _near(words, np.flatnonzero(open_)[:1], sure):
                open_[b] = False
                label[np.isin(label, label[b])] = label[b].min()
                left, right, seen = [*left, a], [*right, b], seen + 1
        rest = np.flatnonzero(label != np.bincount(label).argmax())
    # Near pairs grow with the square of like rows: what they connect is kept as a forest, and a large bucket is compared twice.
    once = [*_near(words, rest, distance)] if len(rest) * n <= NEAR_PAIRS else None
    for a, b, d in _near(words, rest, sure) if once is None else once:
        close = (d <= sure) & (node[a] != node[b])
        left, right = [*left, a[close]], [*right, b[close]]
        if sum(map(len, left)) > NEAR_PAIRS:
            left, right = map(lambda e: [e], _forest(np.concatenate(left), np.concatenate(right)))
    a, b = np.concatenate(left), np.concatenate(right)
    differ = node[a] != node[b]
    a, b = a[differ], b[differ]
    x, y = _forest(node[a], node[b]) if len(a) else (a, b)
    label = _labels(n, a, b)
    pairs = np.zeros(n, np.int64)
    some = [np.zeros(0, np.int64)] * 3
    for a, b, d in _near(words, rest, distance) if once is None else once:
        between = (d > sure) & (node[a] != node[b]) & (label[a] != label[b])
        a, b, d = a[between], b[between], d[between]
        pairs += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        some = [np.r_[old, new] for old, new in zip(some, (a, b, d))]
        first = likeliest(label, *some)  # of these and of all before: what a part leaves out the whole does not take either
        some = [e[first] for e in some]
    a, b, _ = some
    if left_open is not None:
        left_open.append(node[pairs > np.bincount(a, minlength=n) + np.bincount(b, minlength=n)])
    p, q = node[a], node[b]
    return np.r_[x, np.minimum(p, q)], np.r_[y, np.maximum(p, q)], np.r_[np.ones(len(x), bool), np.zeros(len(p), bool)]


def open_pairs(node: np.ndarray, words: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) of nodes of different groups whose sketches are at most `distance` apart, some at a time."""
    number = np.unique(group, return_inverse=True)[1]
    outside = number != np.bincount(number).argmax()
    for a, b, _ in _near(words, np.flatnonzero(outside), distance):
        met = (number[a] != number[b]) & ((a < b) | ~outside[b])  # a pair of two rows outside comes from either side
        p, q = node[a[met]], node[b[met]]
        yield np.minimum(p, q), np.maximum(p, q)


def few_rows(node: np.ndarray, sketch: pa.ChunkedArray, start: np.ndarray, count: np.ndarray, sure: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) of all pairs at most `distance` apart in buckets of few rows."""
    pairs = [(start[count == n] + i, start[count == n] + j) for n in range(2, FEW_ROWS + 1) for i in range(n) for j in range(i + 1, n)]
    x, y = (np.concatenate(e) for e in zip(*pairs))
    x, y = x[node[x] != node[y]], y[node[x] != node[y]]
    used, at = np.unique(np.r_[x, y], return_inverse=True)
    words = np.frombuffer(b"".join(sketch.take(used).to_pylist()), np.uint64).reshape(-1, LANES)
    far = np.bitwise_count(words[at[: len(x)]] ^ words[at[len(x) :]]).sum(axis=1, dtype=np.int64)
    near = far <= distance
    p, q = node[x[near]], node[y[near]]
    return np.minimum(p, q), np.maximum(p, q), far[near] <= sure


def whole_keys(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Of rows that arrive by `key`: tables that hold all rows of their keys, with the start and the number of rows of each."""

    def whole(some: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(some)
        keys = np.column_stack([table.column(c).to_numpy() for c in key])
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        return table, start, np.diff(np.r_[start, len(keys)])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in key])
        other = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cutoff = int(other[-1]) + 1 if len(other) else 0
        if rest and (keys[0] != [rest[0].column(c)[0].as_py() for c in key]).any():
            yield whole(rest)
            rest = []
        if cutoff:
            yield whole([*rest, batch.slice(0, cutoff)])
            rest = []
        rest.append(batch.slice(cutoff))
    if rest:
        yield whole(rest)


def _linked(sure: int, distance: int):
    """Rows arrive by (bucket, i, j); emits edges, and the nodes of pairs left open as (node, node, null)."""

    def edges(*found: list[np.ndarray]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["a", "b", "sure"])
        for x in found:
            x.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start, count in whole_keys(batches, ["bucket", "i", "j"]):
            node, kept = table.column("node").to_numpy(), table.column("sketch")
            found_a, found_b, found_sure, left_open = [], [], [], []
            few = (count > 1) & (count <= FEW_ROWS)
            if few.any():
                x, y, s = few_rows(node, kept, start[few], count[few], sure, distance)
                found_a, found_b, found_sure = [x], [y], [s]
            many = (count > 1) & ~few
            for a, n in zip(start[many].tolist(), count[many].tolist()):
                words = np.frombuffer(b"".join(kept.slice(a, n).to_pylist()), np.uint64).reshape(-1, LANES)
                x, y, s = link_bucket(node[a : a + n], words, sure, distance, left_open)
                found_a.append(x)
                found_b.append(y)
                found_sure.append(s)
                if sum(map(len, found_a)) > NEAR_PAIRS:
                    yield edges(found_a, found_b, found_sure)
            if found_a:
                yield edges(found_a, found_b, found_sure)
            if left_open and sum(map(len, left_open)):
                some = pa.array(np.unique(np.concatenate(left_open)))
                yield pa.RecordBatch.from_arrays([some, some, pa.nulls(len(some), pa.bool_())], ["a", "b", "sure"])

    return run


class Meeting(NamedTuple):
    """The distances of what is sure and of what is looked at, and into how many blocks large buckets are dealt."""

    sure: int
    distance: int
    large: list[tuple[int, int]]


def meeting(nodes: DataFrame, similarity: float) -> Meeting:
    differ = apart(similarity)
    mean, deviation = SKETCH * differ, np.sqrt(SKETCH * differ * (1 - differ))
    share = min(1.0, SEEN / max(1, nodes.count()))
    some = nodes.filter(F.xxhash64("node") / 2.0**64 + 0.5 <= share).select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    large = [(r.bucket, int(-(-r.n // (share * LINK_ROWS)))) for r in some.filter((F.col("n") > 3) & (F.col("n") > share * LINK_ROWS)).collect()]
    return Meeting(int(mean - SURE * deviation), int(mean + MARGIN * deviation), large)


def met(nodes: DataFrame, how: Meeting) -> DataFrame:
    """(a, b, sure) of the (node, sketch, bands) rows that meet in a band, and the nodes of pairs left open."""
    columns = [c for c in nodes.columns if c != "bands"]
    dealt = nodes.select(F.explode("bands").alias("bucket"), *columns)
    if how.large:  # at most SEEN / 4 of each band
        split = nodes.sparkSession.createDataFrame(how.large, "bucket long, blocks int")
        dealt = dealt.join(F.broadcast(split), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        home = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = home.select("bucket", F.least("block", "c").alias("i"), F.greatest("block", "c").alias("j"), *columns)
    else:
        dealt = dealt.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns)
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_linked(how.sure, how.distance), "a long, b long, sure boolean").distinct()


def similar_links(nodes: DataFrame, similarity: float, how: Meeting | None = None) -> DataFrame:
    """Edges (a, b, sure) among (node, sketch, bands) rows that meet in a band: the components of the sure ones are those of all sketches
    that are alike without doubt; the others are pairs that may be alike. Rows (a, a, null) are nodes of more such pairs."""
    return written(met(nodes, how or meeting(nodes, similarity)), "similar-links")


#: Rows up to which a list of documents to look at again is broadcast: two numbers each.
BROADCAST_LEADS = 1_000_000
#: Shingle sets of one block, of which a task holds two.
SET_ROWS = 512
#: Words of bits in which a task holds sets to compare them; larger ones are compared two by two.
HELD_WORDS = 1 << 22


def sets_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in `asked`; `nodes` has (node, lead struct(doc_id, text_hash)). Only their texts are read again, one of each."""
    leads = written(nodes.select("node", "lead.doc_id", "lead.text_hash").join(asked, "node"), "doubtful")
    small = leads.count() <= BROADCAST_LEADS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("text_hash"), "text").alias("d")
    same = (F.col("d.text_hash") == F.col("l.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("l.doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for texts in pieces(batch.column("text")):
                sets, at = shingle_sets(texts, width)
                own = pa.array([x.tobytes() for x in np.split(sets, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, len(texts)), own], ["node", "shingles"])
                row += len(texts)

    found = rows.join((F.broadcast(leads) if small else leads).alias("l"), same).select("l.node", "d.text")
    return written(found.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The (a, b) of `pairs` whose shingle sets have that Jaccard similarity; `nodes` has (node, lead struct(doc_id, text_hash))."""
    sets = sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by (i, j), the sets of a pair of blocks before its pairs."""
        now, held = None, {}
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("i", "j", "a", "b")]
            for row, (i, j, a, b) in enumerate(zip(*columns)):
                if (i, j) != now:
                    now, held = (i, j), {}
                if b is None:
                    held[a] = np.frombuffer(batch.column("shingles")[row].as_py(), np.uint64)
                    continue
                x, y = held[a], held[b]
                least = similarity * max(len(x), len(y))
                if min(len(x), len(y)) >= least and (shared := len(np.intersect1d(x, y, assume_unique=True))) >= similarity * (len(x) + len(y) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    # A node's block is that of its smallest neighbour, cut where that has many: a set goes once to each pair of blocks, not to each pair.
    both = pairs.select(F.col("a").alias("node"), F.least("a", "b").alias("hub")).unionByName(pairs.select(F.col("b").alias("node"), F.least("a", "b").alias("hub")))
    hubs = both.groupBy("node").agg(F.min("hub").alias("hub"))
    cuts = hubs.groupBy("hub").agg(F.ceil(F.count("*") / SET_ROWS).alias("cuts"))
    block = written(hubs.join(cuts, "hub").select("node", F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("block")), "set-blocks")
    side = lambda n, to: block.select(F.col("node").alias(n), F.col("block").alias(to))
    asked_pairs = written(pairs.select("a", "b").join(side("a", "i"), "a").join(side("b", "j"), "b").select("i", "j", "a", "b"), "block-pairs")
    needs = asked_pairs.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    rows = needs.select("i", "j", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles").unionByName(asked_pairs.withColumn("shingles", F.lit(None).cast("binary")))
    return rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("b").isNotNull()).mapInArrow(judged, "a long, b long")


def shared_of(sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of positions x, y: how many hashes each two sets share. Hashes that two sets or more hold are numbered, and a set is a row of bits."""
    whole = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    number = np.unique(whole, return_inverse=True)[1]
    common = np.bincount(number) > 1
    kept = common[number]
    row, column = row[kept], (np.cumsum(common) - 1)[number[kept]]
    width = int(common.sum()) // 64 + 1
    if len(sets) * width > HELD_WORDS:
        return lambda x, y: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], np.int64)
    bits = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    step = max(1, NEAR_PAIRS // width)
    return lambda x, y: np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[x[a : a + step]] & bits[y[a : a + step]]).sum(axis=1, dtype=np.int64) for a in range(0, len(x), step))])


def alike_rows(bucket: int, words: np.ndarray, own: np.ndarray, group: np.ndarray, block: np.ndarray, sets: list[np.ndarray], similarity: float, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x, y), connecting all pairs of one bucket that lie in different groups, are at most `distance` apart and whose sets are alike.

    `own` holds the rows' bands: a pair is judged in the first band that it shares. Of rows of two blocks only pairs across count.
    """
    size, shared = np.array([len(x) for x in sets]), None
    found = [(np.zeros(0, np.int64),) * 2]
    for x, y in open_pairs(np.arange(len(words)), words, group, distance):
        asked = (block[x] != block[y]) | (block[0] == block).all()
        asked &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
        x, y = x[asked], y[asked]
        same = own[x] == own[y]
        here = own[x, same.argmax(axis=1)] == bucket
        x, y = x[here], y[here]
        if len(x):
            shared = shared or shared_of(sets)
            both = shared(x, y)
            like = both >= similarity * (size[x] + size[y] - both)
            found = [_forest(np.r_[found[0][0], x[like]], np.r_[found[0][1], y[like]])] if like.any() else found
    return found[0]


def alike_between(docs: DataFrame, nodes: DataFrame, grouped: DataFrame, width: int, similarity: float, distance: int) -> DataFrame:
    """(a, b) that connect what pairs of `grouped` (node, sketch, bands, group) connect that share a band, lie in different groups, are at most
    `distance` apart and whose shingle sets have that Jaccard similarity.

    Pairs are judged where a bucket's sets lie and are no rows of their own; a bucket of many rows is cut into blocks, of which a task holds two.
    """
    met_in = grouped.select(F.explode("bands").alias("bucket"), "node", "group")
    mixed = met_in.groupBy("bucket").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo != hi")
    sizes = written(mixed.select("bucket", F.ceil(F.col("n") / SET_ROWS).cast("int").alias("blocks")), "open-buckets")
    sets = sets_of(docs, nodes, grouped.select("node"), width).join(grouped, "node")
    home = met_in.select("bucket", "node").join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = home.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "c").alias("i"), F.greatest("block", "c").alias("j"), "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start, count in whole_keys(batches, ["bucket", "i", "j"]):
            bucket, node, group, block = (table.column(c).to_numpy() for c in ("bucket", "node", "group", "block"))
            found = [(np.zeros(0, np.int64),) * 2]
            for a, n in zip(start[count > 1].tolist(), count[count > 1].tolist()):
                if (group[a : a + n] == group[a]).all():
                    continue
                words = np.frombuffer(b"".join(table.column("sketch").slice(a, n).to_pylist()), np.uint64).reshape(-1, LANES)
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles").slice(a, n)]
                own = np.array(table.column("bands").slice(a, n).to_pylist(), np.int64)
                x, y = alike_rows(bucket[a], words, own, group[a : a + n], block[a : a + n], sets, similarity, distance)
                found.append((np.minimum(node[a + x], node[a + y]), np.maximum(node[a + x], node[a + y])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) for e in zip(*found)], ["a", "b"])

    rows = dealt.join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.select("bucket", "i", "j", "block", "node", "group", "sketch", "bands", "shingles").mapInArrow(run, "a long, b long").distinct()


def keep_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, that stay: of each group the one of the smallest doc_id.

    Texts are linked when their shingle sets have a Jaccard similarity of `similarity` or more: by their sketches where these leave no
    doubt, else by the sets themselves; groups are what links connect. Sets of equal hashes are alike; texts without words are
    alike, and null counts as one. A null doc_id ranks below all others. Of rows that share the smallest doc_id of a group, one of
    the smallest text hash stays; rows that repeat whole are one document; an empty table stays empty.
    """
    rows = written(sketches(docs, width, similarity), "sketches")
    first = rows.groupBy("node").agg(F.first(F.struct("sketch", "bands")).alias("own"), F.min(F.struct("doc_id", "text_hash")).alias("lead"))
    nodes = written(first.select("node", "own.sketch", "own.bands", "lead"), "distinct-sketches")
    how = meeting(nodes.select("node", "bands"), similarity)
    links = similar_links(nodes.select("node", "sketch", "bands"), similarity, how)
    sure = links.filter("sure").select("a", "b")
    parts = components(sure)
    group = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    known = links.filter("not sure").join(group("a"), "a", "left").join(group("b"), "b", "left")
    doubt = written(known.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "doubtful-pairs")
    if not doubt.isEmpty():
        found = written(sure.unionByName(alike(docs, nodes, doubt, width, similarity)), "all-links")
        parts = components(found)
        # The likeliest pairs have connected what they do; all other pairs that are still between groups are looked at now.
        at = F.coalesce("component", "node").alias("group")
        left = links.filter("sure is null").select(F.col("a").alias("node")).distinct()
        open_ = written(left.join(nodes.select("node", "sketch", "bands"), "node").join(parts, "node", "left").select("node", "sketch", "bands", at), "open-sketches")
        further = written(alike_between(docs, nodes, open_, width, similarity, how.distance), "further-links") if not open_.isEmpty() else open_
        if not further.isEmpty():
            parts = components(found.unionByName(further))
    leads = nodes.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("lead").alias("lead"))
    return keep_leads(docs, written(leads.select("lead.doc_id", "lead.text_hash"), "leaders"))


def keep_leads(docs: DataFrame, leads: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, whose (doc_id, text_hash) is in `leads`; rows that repeat whole once."""
    whole = boxed(docs).withColumn("text_hash", text_hash("row.text")).alias("w")
    same = (F.col("w.text_hash") == F.col("l.text_hash")) & F.col("w.row.doc_id").cast("long").eqNullSafe(F.col("l.doc_id"))
    kept = whole.join(leads.alias("l"), same).select("w.row", "l.text_hash", "l.doc_id")
    if kept.groupBy("text_hash", "doc_id").count().filter("count > 1").isEmpty():
        return unboxed(kept)
    return unboxed(kept.dropDuplicates(["text_hash", "doc_id"]))


def keep_one(docs: DataFrame, width: int = 5, distance: int = 4) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, that stay: of each group the one of the smallest doc_id.

    Groups go by fingerprints alone. A null doc_id ranks below all others. Of rows that share the smallest doc_id, one of the
    smallest text hash stays; rows that repeat whole are one document.
    """
    rows, groups = near_groups(docs, width, distance)
    leads = join_groups(rows, groups, "fp", "copies").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("lead"))
    return keep_leads(docs, written(leads.select("lead.doc_id", "lead.text_hash"), "leaders"))

"""Suffix-array dedup of repeated byte windows by a depth-limited most-significant-digit radix sort.

Only suffixes through `length` bytes matter, and groups of equal ones are the repeated windows. Sorting starts not at every
byte but at anchors: the anchor of a window is the leftmost smallest hash among its KMER-byte pieces, so equal windows have
equal anchors at equal offsets, and consecutive windows share one: a span of them is shuffled as one row.

First pass: the hash of the anchor's piece is the digit. Windows alone under it cannot repeat and are dropped; a hash decides
nothing else. Spans left are sorted with their bytes, by anchor and then eight bytes at a time, window by window,
singletons dropped after every pass. Two steps keep popular passages from meeting in one task, and both go by bytes too: a task
drops a span if it has seen the same bytes earlier in order, and under an anchor of very many spans every task sorts its own
windows first and sends on only the first of each group, dealt by the window's own bytes to a last sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KMER = 32
#: Bytes that are hashed at a time; longer texts are taken in overlapping pieces.
SLAB = 1 << 19
#: Spans under one anchor that a task sorts at once; under more, windows are sorted where they are and their groups' firsts again.
HOT_SPANS = 15_000
#: Windows in one in-memory sort: about those of HOT_SPANS spans.
SORT_ROWS = 1 << 20
#: Hot anchors are told from about HOT_TEXTS texts, and from one in LEAST_SHARE at the least. One is hot that holds so large a share of
#: all spans, or so many of them; there are no more than 1 / HOT_SHARE and one for each HOT_ROWS spans. Being hot changes where an
#: anchor's spans are dealt, not what is removed.
HOT_TEXTS, LEAST_SHARE = 4_000, 1_000
HOT_SHARE, HOT_ROWS = 0.0005, 1_000_000
#: Hot anchors up to which their list is broadcast.
BROADCAST_ANCHORS = 1_000_000
#: Repeated spans, with their bytes, that a task remembers.
KNOWN_SPANS = 100_000

_rng = np.random.default_rng(20_240_229)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Runs of windows with one anchor in texts laid end to end: (text number, first, last start, anchor, its hash, span hash).

    Text number docs[i] is data[starts[i]:ends[i]]; positions are those in `data`.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    _Powers.upto(n + 1)
    value = _TABLE[data]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value * _Powers.up[:n], out=prefix[1:])
    h, size, k = value, 1, 0
    while size < KMER:
        h = h[:-size] * _MULTIPLIERS[k] + h[size:]
        h ^= h >> np.uint64(29)
        size, k = 2 * size, k + 1
    h = _mix(h)  # of the KMER bytes from each position on
    low = (h >> np.uint64(32)).astype(np.uint32)
    wide, at, have = length - KMER + 1, np.arange(len(h), dtype=np.int32), 1
    while have < wide:  # leftmost smallest of ever wider runs
        step = min(have, wide - have)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        have += step
    # starts of windows that lie in one text
    text = np.repeat(np.arange(len(docs)), ends - starts)
    first = np.arange(n - length + 1)
    inside = text[: n - length + 1] == text[length - 1 :]
    first, at, own = first[inside], at[: n - length + 1][inside], text[: n - length + 1][inside]
    if not len(first):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])])
    p0, q = first[new], at[new].astype(np.int64)
    p1 = first[np.r_[new[1:] - 1, len(first) - 1]]
    span = (prefix[p1 + length] - prefix[p0]) * _Powers.down[p0]
    return docs[own[new]], p0, p1, q, h[q], _mix(span)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Slabs of (text number, offset of the piece in its text) and the pieces end to end."""
    who, where, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), SLAB):
            piece = t[a : a + SLAB + length - 1]
            if len(piece) < length:
                continue
            who.append((i, len(piece)))
            where.append(a)
            held.append(piece)
            size += len(piece)
            if size >= SLAB:
                yield who, where, b"".join(held)
                who, where, held, size = [], [], [], 0
    if held:
        yield who, where, b"".join(held)


def _known_earlier(known: dict, data: bytes, key: np.ndarray, p0: np.ndarray, size: np.ndarray, doc: np.ndarray, rep: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where a span with the same bytes starts earlier: among these rows, or in what the task has seen before.

    Row i is data[p0[i] : p0[i] + size[i]]; `key` only finds what is compared. `known` holds the earliest place and the bytes of
    spans that repeat; it saves shuffled rows, so it may forget.
    """
    order = np.argsort(key, kind="stable")
    twin = key[order][1:] == key[order][:-1]
    many = order[np.r_[False, twin] | np.r_[twin, False]] if len(order) else order
    sure = np.zeros(len(key), bool)
    if not len(many):
        return sure
    many = many[np.lexsort((start[many], rep[many], doc[many], key[many]))]
    first = np.r_[True, key[many][1:] != key[many][:-1]]
    if len(known) > KNOWN_SPANS:
        known.clear()
    ends, least = p0 + size, b""
    places = zip(doc[many].tolist(), rep[many].tolist(), start[many].tolist())
    for i, leads, k, a, z, place in zip(many.tolist(), first.tolist(), key[many].tolist(), p0[many].tolist(), ends[many].tolist(), places):
        own = data[a:z]
        if leads:
            least, had = own, known.get(k)
            if had is None:
                known[k] = place, own
            elif had[1] == own:
                if had[0] < place:
                    sure[i] = True
                else:
                    known[k] = place, own
        elif own == least:
            sure[i] = True
    return sure


def _stretches(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ascending (who, lo) joined where they touch or overlap; `hi` ascends with `lo`."""
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (lo[1:] > hi[:-1])]) if len(who) else np.zeros(0, np.int64)
    last = np.r_[new[1:] - 1, len(who) - 1][: len(new)]
    return who[new], lo[new], hi[last]


def _spans(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            ids, reps = pdf["doc_id"].to_numpy(), pdf["rep"].to_numpy()
            texts = [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]
            for who, where, data in _pieces(texts, length):
                sizes = np.array([s for _, s in who])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                piece, p0, p1, q, kmer, span = anchors(np.frombuffer(data, np.uint8), np.arange(len(who)), starts, ends, length)
                doc = np.array([i for i, _ in who])[piece]
                start = p0 + (np.array(where)[piece] - starts[piece])
                size = p1 - p0 + length
                key = _mix(kmer * np.uint64(0xA24BAED4963EE407) + span * np.uint64(0x9FB21C651E98DF25) + (q - p0).astype(np.uint64))
                sure = _known_earlier(known, data, key, p0, size, ids[doc], reps[doc], start)
                gone, lo, hi = _stretches(doc[sure], start[sure], (start + size)[sure])
                rest = ~sure
                who_, at = np.r_[gone, doc[rest]], np.r_[lo, start[rest]]
                yield pd.DataFrame({
                    "kmer": pd.Series(np.r_[np.zeros(len(gone), np.int64), kmer[rest].view(np.int64)]), "sure": np.r_[np.ones(len(gone), bool), np.zeros(int(rest.sum()), bool)],
                    "doc_id": ids[who_], "rep": reps[who_], "start": at.astype(np.int32), "bytes": np.r_[hi - lo, size[rest]].astype(np.int32),
                })

    return run


#: `bytes` of a sure row are removed; those of the others are the span that is left to sort.
SPANS = "kmer long, sure boolean, doc_id long, rep long, start int, bytes int"


def _packed(texts: DataFrame) -> DataFrame:
    """(doc_id, rep, z): texts in UTF-8, compressed before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "rep": pdf["rep"], "z": [pack(t.encode() if isinstance(t, str) else b"") for t in pdf["text"]]})

    return texts.mapInPandas(run, "doc_id long, rep long, z binary")


def _with_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans with their bytes; one whose bytes this task has seen at an earlier place is sure to go and carries none."""
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[tuple[int, bytes], tuple] = {}
    for pdf in batches:
        out: list[tuple] = []
        for doc, rep, z, spans in zip(pdf["doc_id"].tolist(), pdf["rep"].tolist(), pdf["z"], pdf["spans"]):
            text, gone = unpack(z), []
            for s in spans:
                kmer, at, size = s["kmer"], s["start"], s["bytes"]
                own = text[at : at + size]
                place = doc, rep, at
                had = known.setdefault((kmer, own), place)
                if had < place:
                    gone.append((at, at + size))
                    continue
                known[kmer, own] = place
                out.append((kmer, doc, rep, at, size, own))
            out += [(0, doc, rep, lo, hi - lo, None) for lo, hi in merged(gone)]
        if len(known) > 3 * KNOWN_SPANS:
            known.clear()
        yield pd.DataFrame(out, columns=["kmer", "doc_id", "rep", "start", "size", "bytes"])


def _alike(spans: pd.DataFrame, alone: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(whole spans whose bytes start earlier under the same anchor, the others); without `alone` those left single under theirs go too."""
    ordered = spans.sort_values(["doc_id", "rep", "start"], kind="stable")
    same = ordered.duplicated(["kmer", "bytes"]).to_numpy()
    gone, rest = ordered[same], ordered[~same]
    cuts = pd.DataFrame({"doc_id": gone["doc_id"], "rep": gone["rep"], "lo": gone["start"], "hi": gone["start"] + gone["bytes"].map(len)}).astype("int64")
    return cuts, (rest if alone else rest[rest.duplicated("kmer", keep=False).to_numpy()]).reset_index(drop=True)


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, group numbers) of the suffixes at `starts` that repeat within their group through `length` bytes.

    Most significant digit first: each pass refines the groups by eight more bytes and drops what is left alone.
    """
    index, number = np.arange(len(starts)), group
    shifts = np.arange(56, -1, -8).astype(np.uint64)
    for depth in [*range(0, length - 8, 8), length - 8]:
        if not len(index):
            break
        at = starts[index] + depth
        digit = np.zeros(len(at), np.uint64)
        for b, s in enumerate(shifts):
            digit |= data[at + b].astype(np.uint64) << s
        order = np.lexsort((digit, number))
        index, number, digit = index[order], number[order], digit[order]
        new = np.r_[True, (number[1:] != number[:-1]) | (digit[1:] != digit[:-1])]
        fresh = np.cumsum(new) - 1
        many = np.bincount(fresh)[fresh] > 1
        index, number = index[many], fresh[many]
    return index, number


def _sorted_windows(spans: pd.DataFrame, length: int):
    """(windows as (span row, start in its text, place in `data`), data, group of each repeated one, is it its group's first)."""
    data = np.frombuffer(b"".join(spans["bytes"]), np.uint8)
    sizes = np.fromiter(map(len, spans["bytes"]), np.int64, len(spans))
    base, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    row = np.repeat(np.arange(len(spans)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    group = np.unique(spans["kmer"].to_numpy(), return_inverse=True)[1][row]
    index, number = radix_groups(data, base[row] + offset, group, length)
    doc, rep, start = (spans[c].to_numpy() for c in ("doc_id", "rep", "start"))
    at = start[row] + offset
    of = row[index]
    order = np.lexsort((at[index], rep[of], doc[of], number))
    later = np.zeros(len(row), bool)
    if len(order):
        later[index[order[np.r_[False, number[order][1:] == number[order][:-1]]]]] = True
    return data, row, at, base[row] + offset, later


def _cuts(spans: pd.DataFrame, row: np.ndarray, at: np.ndarray, later: np.ndarray, length: int) -> pd.DataFrame:
    of, lo, hi = _stretches(row[later], at[later], at[later] + length)
    return pd.DataFrame({"doc_id": spans["doc_id"].to_numpy()[of], "rep": spans["rep"].to_numpy()[of], "lo": lo, "hi": hi}).astype("int64")


def _repeated(spans: pd.DataFrame, length: int) -> pd.DataFrame:
    """Removed stretches (doc_id, rep, lo, hi) of whole anchor groups: equal spans first, then the windows of those that differ."""
    cuts, rest = _alike(spans, False)
    if not len(rest):
        return cuts
    _, row, at, _, later = _sorted_windows(rest, length)
    return pd.concat([cuts, _cuts(rest, row, at, later, length)], ignore_index=True)


def _sorted_groups(length: int):
    """Rows arrive by anchor; whole anchor groups are sorted together, about SORT_ROWS windows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held = 0
        for pdf in batches:
            rest.append(pdf)
            held += int(pdf["bytes"].map(len).sum()) - (length - 1) * len(pdf)
            if held < SORT_ROWS:
                continue
            whole = pd.concat(rest, ignore_index=True)
            cutoff = int((whole["kmer"] != whole["kmer"].iloc[-1]).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if cutoff:
                yield _repeated(whole.iloc[:cutoff], length)
            rest = [whole.iloc[cutoff:]]
            held = int(rest[0]["bytes"].map(len).sum()) - (length - 1) * len(rest[0])
        if rest and sum(map(len, rest)):
            yield _repeated(pd.concat(rest, ignore_index=True), length)

    return run


CUTS = "doc_id long, rep long, lo long, hi long"


def _own_groups(length: int):
    """Sorts the windows of the rows at hand: emits the removed stretches, and the first window of each group with its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held = 0

        def solve() -> Iterator[pd.DataFrame]:
            cuts, spans = _alike(pd.concat(rest, ignore_index=True), True)
            yield cuts.assign(window=None)
            data, row, at, place, later = _sorted_windows(spans, length)
            yield _cuts(spans, row, at, later, length).assign(window=None)
            lead, raw = np.flatnonzero(~later), data.tobytes()
            for a in range(0, len(lead), 50_000):
                k = lead[a : a + 50_000]
                yield pd.DataFrame({"doc_id": spans["doc_id"].to_numpy()[row[k]], "rep": spans["rep"].to_numpy()[row[k]], "lo": at[k], "hi": at[k] + length, "window": [raw[p : p + length] for p in place[k].tolist()]})

        for pdf in batches:
            rest.append(pdf)
            held += int(pdf["bytes"].map(len).sum()) - (length - 1) * len(pdf)
            if held >= SORT_ROWS:
                yield from solve()
                rest, held = [], 0
        if rest and sum(map(len, rest)):
            yield from solve()

    return run


def _hot_windows(spans: DataFrame, length: int) -> DataFrame:
    """The removed stretches of anchors of very many spans: sorted where the spans are, then what is left over all tasks.

    A window goes on once from each sort, so the last one meets no more rows of a window than there were sorts before it.
    """
    own = written(spans.mapInPandas(_own_groups(length), f"{CUTS}, window binary"), "hot-windows")
    firsts = own.filter("window is not null").select(F.xxhash64("window").alias("kmer"), "doc_id", "rep", F.col("lo").cast("int").alias("start"), F.col("window").alias("bytes"))
    last = firsts.repartition("kmer").sortWithinPartitions("kmer").mapInPandas(_sorted_groups(length), CUTS)
    return own.filter("window is null").drop("window").unionByName(last)


def _hot_anchors(texts: DataFrame, length: int) -> DataFrame:
    """(kmer, hot) of the anchors that hold more than HOT_SHARE of all spans or HOT_ROWS of them, as a sample of texts tells it."""
    step = max(1, min(LEAST_SHARE, texts.count() // HOT_TEXTS))
    some = texts.filter(F.pmod(F.xxhash64("doc_id", "rep"), F.lit(step)) == 0)  # rows that share an id are sampled apart
    counts = written(some.mapInPandas(_spans(length), SPANS).filter("not sure").groupBy("kmer").count(), "anchor-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.filter(F.col("count") > max(4, int(min(total * HOT_SHARE, HOT_ROWS / step)))).select("kmer", F.lit(True).alias("hot"))
    return F.broadcast(hot) if hot.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS else hot


def removed_stretches(texts: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, rep, lo, hi): byte stretches, not yet merged, that cover every byte to remove from (doc_id, rep, text)."""
    spans = texts.mapInPandas(_spans(length), SPANS).join(_hot_anchors(texts, length), "kmer", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # Rows that need no others, and those of anchors known to be shared, are dealt anywhere, all others by their anchor.
    dealt = spans.withColumn("deal", F.when(F.col("sure") | F.col("hot"), F.xxhash64("doc_id", "rep", "start", "sure")).otherwise(F.col("kmer")))
    shared = dealt.repartition("deal").withColumn("n", F.count("*").over(Window.partitionBy("deal"))).filter("sure or hot or n > 1")
    kept = written(shared.select("kmer", "sure", "doc_id", "rep", "start", "bytes"), "spans")
    seen = kept.filter("sure").select("doc_id", "rep", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("bytes")).cast("long").alias("hi"))
    per_text = kept.filter("not sure").groupBy("doc_id", "rep").agg(F.collect_list(F.struct("kmer", "start", "bytes")).alias("spans"))  # bounded by the text itself
    found = written(_packed(texts).join(per_text, ["doc_id", "rep"]).mapInPandas(_with_bytes, "kmer long, doc_id long, rep long, start int, size int, bytes binary"), "span-bytes")
    again = found.filter("bytes is null").select("doc_id", "rep", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("size")).cast("long").alias("hi"))
    sortable = found.filter("bytes is not null").drop("size")
    hot = written(sortable.groupBy("kmer").count().filter(F.col("count") > HOT_SPANS).select("kmer"), "hot-anchors")
    cold, parts = sortable, [seen, again]
    if not hot.isEmpty():
        parts.append(_hot_windows(sortable.join(hot, "kmer", "left_semi"), length))
        cold = sortable.join(hot, "kmer", "left_anti")
    parts.append(cold.repartition("kmer").sortWithinPartitions("kmer").mapInPandas(_sorted_groups(length), CUTS))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the stretches cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(stretches):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    for pdf in batches:
        rows = []
        for z, stretches in zip(pdf["z"], pdf["stretches"]):
            text = unpack(z)
            runs = merged([(s["lo"], s["hi"]) for s in stretches]) if stretches is not None else []
            sha, at = hashlib.sha256(), 0
            for lo, hi in [*runs, (len(text), len(text))]:
                sha.update(text[at:lo])
                at = hi
            rows.append((len(text), sum(hi - lo for lo, hi in runs), len(runs), sha.hexdigest(), runs))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
        yield out.assign(doc_id=pdf["doc_id"].to_numpy())


def substring_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of [lo, hi) byte runs) of every row.

    A byte goes if a `length`-byte string that covers it also starts earlier: at a smaller doc_id, or earlier in the
    same row. Rows that repeat a doc_id count in the order of their texts; null doc_id ranks first; null text is empty; texts under
    `length` bytes lose nothing. Other columns are ignored.
    """
    least = F.lit(-(2**63))
    rows = docs.select(F.coalesce("doc_id", least).cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = rows.withColumn("rep", F.lit(0).cast("long"))
    else:
        texts = written(rows.withColumn("rep", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long")), "texts")
    stretches = removed_stretches(texts, length).groupBy("doc_id", "rep").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches"))
    whole = _packed(texts).join(stretches, ["doc_id", "rep"], "left")
    out = whole.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))

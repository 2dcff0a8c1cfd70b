"""Filter audit, target resampling and URL filters against plain versions, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import filter_audit, resampling, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i}" for i in range(210))
EDGES = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t\x0b", "", "b", 4), (4, PROSE, "en", "b", 1), (5, PROSE, "en", None, 1), (5, PROSE, "de", None, 1), (6, PROSE, "en", None, 1),
    (None, PROSE, "en", "a", 1), (None, PROSE, "en", "a", 1), (4, PROSE, "en", "b", 1), (7, PROSE + " #", "en", "a", 1), (8, "SHOUT " * 300, "en", "a", 1), (9, "tie " * 250, "fr", "a", 1), (10, "tie " * 250, "fr", "a", 1),
    (-3, "Ünïcode ñandú ß \u2003 Σίσυφος 한국어 " * 60, "de", "c", 1), (11, "x" * 300_000, "en", "c", 1), (12, "a\x00b c\x7fd e`f{g", "en", "c", 1), (13, "one", "en", "c", 1), (14, "\u00a0 \u0085", "en", "c", 1),
]
CLASH = ("n", "mask", "part", "quality", "toxic", "weight", "score", "rank", "bucket", "host", "rule", "share", "_tie", "_salt", "bad")


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


# filter audit


def plain_audit(rows, labels):
    texts = [t or "" for _, t, *_ in rows]
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    failed = []
    for (i, *_), t in zip(rows, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and u == t for (j, *_), u in zip(rows, texts))
        failed.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e})
    out, shapley = {}, Counter()
    parts = sorted({r[2] or "" for r in rows})
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [i for i, f in left if f[name]]
                kept = [x for x in left if not x[1][name]]
                shapley[part, name] += len(gone)
                out[part, order, step] = [len(kept), len(gone), sum(f[name] for _, f in own) - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone)]
                left = kept
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("held", [1, 48 << 20])
def test_filter_audit(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (7, 0, 1), (8, None, None), (9, 1, 0), (10, 1, 0), (None, 1, 1), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = list(map(tuple, filter_audit.filter_audit(frame(spark), marks).collect()))
    assert len(got) == len(set(got)) and set(got) == plain_audit(EDGES, [x for x in labels if x[0] is not None])
    again = filter_audit.filter_audit(frame(spark).repartition(7), marks.withColumn("text", F.lit("x")))
    assert set(map(tuple, again.collect())) == set(got)
    assert filter_audit.filter_audit(frame(spark, []), marks).count() == 0
    assert set(map(tuple, filter_audit.filter_audit(frame(spark), marks.limit(0)).collect())) == plain_audit(EDGES, [])


def test_collision_chains_and_order():
    """Texts under one fingerprint stay apart; whichever order ids come in, each row is told once."""
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 12)), str(rng.integers(0, 3)), f"text {rng.integers(0, 4)}".encode()) for _ in range(300)]
    least = {t: min(i for i, _, u in rows if u == t) for _, _, t in rows}
    want = Counter((i, p, i > least[t]) for i, p, t in rows)
    for cut in (1, 7, 300):  # tasks of so many rows, all records under one key
        records = [(5, v) for a in range(0, 300, cut) for _, v in filter_audit.route(rows[a : a + cut])]
        got = Counter()
        for i, p, mask, n in filter_audit.settle(records):
            got[i, p, bool(mask & filter_audit.REPEAT)] += n
        assert got == want


# resampling


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain_resample(rows, target):
    docs, other = [(i, *plain_features(t)) for i, t in rows], [plain_features(t)[1] for t in target]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for f in other for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, words, f in docs:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("part_rows", [3, 100_000])
def test_resampling(spark, monkeypatch, part_rows):
    monkeypatch.setattr(resampling, "PART_ROWS", part_rows)
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    target = [r.text for r in bench.collect()]
    assert in_order(resampling.resample(docs, bench).collect()) == in_order(plain_resample([(r.doc_id, r.text) for r in docs.collect()], target))
    got = resampling.resample(frame(spark), bench.limit(3))
    assert in_order(got.collect()) == in_order(plain_resample([(i, t) for i, t, *_ in EDGES], [r.text for r in bench.limit(3).collect()]))
    assert in_order(resampling.resample(frame(spark), bench.limit(0)).collect()) == in_order(plain_resample([(i, t) for i, t, *_ in EDGES], []))
    assert resampling.resample(frame(spark, []), bench).count() == 0
    assert resampling.selected(docs, bench).count() == sum(r[4] is not None for r in plain_resample([(r.doc_id, r.text) for r in docs.collect()], target))


@pytest.mark.parametrize("block", [1, 16, 100, 1 << 20])
def test_byte_automaton(monkeypatch, block):
    """Any bytes, in blocks of any size: words as long as a block and longer, gaps longer than a block, slices of a column."""
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    rng = np.random.default_rng(block)
    alphabet = list("abzAZ09 \n./:@[`{~\x00é ñ한") + ["word", "   ", "x" * 40, " " * 50]
    texts = [None, "", " ", "one"] + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(80)] + ["y" * 300, " " * 300 + "end", "a b " * 90]
    for column in (pa.array(texts), pa.array(texts)[5:40], pa.array([], pa.string()), pa.array([None, None], pa.string())):
        found = defaultdict(Counter)
        for rows, buckets in resampling.features_of(column):
            for r, b in zip(rows.tolist(), buckets.tolist()):
                found[r][b] += 1
        assert {r: c for r, c in found.items()} == {i: Counter(f) for i, t in enumerate(column.to_pylist()) if (f := plain_features(t)[1])}


# URL filters

URLS = [
    ("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("https://blog.example.org/en/12?x", "blog.example.org", "/en/12", "example.org/en/1", "block"), ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"), ("ftp://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"), ("http://a.com/de/x#y", "a.com", "/de/x", "com/de/", "block"), ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://a.com/fr", "a.com", "/fr", None, "allow"), ("http://a.org", "a.org", "", None, "allow"), ("http://a.org?q=/es/", "a.org", "", None, "allow"), ("http://ÀB.net:80/p", "Àb.net:80", "/p", None, "allow"),
    ("x://y://z/w", "y:", "//z/w", None, "allow"), ("://", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://a.org\n/x", "a.org\n", "/x", None, "allow"),
]


def test_rules(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)] + [(None, URLS[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in (*CLASH, "low", "domain", "pages", "spread")})
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.judge(pages, none).collect()}
    assert got == {i: tuple(w[1:]) for i, w in enumerate(URLS)} | {None: URLS[0][1:]}
    assert url_filter.judge(pages.limit(0), none).count() == 0
    assert [r.rule for r in url_filter.judge(pages.limit(1), none, []).collect()] == [None]


def test_levels(spark):
    hosts = {"a.b.example.org": ("example.org", "org"), "org": ("org", "org"), "": ("", ""), "x.shop.co.uk:8080": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:80": ("10.0.0.1", ""), "a.net.": ("a.net", "net"), "[::1]": ("[::1]", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.d, r.s) for r in df.select("host", *[c.alias(n) for c, n in zip(url_filter.levels_of(F.col("host")), "ds")]).collect()} == hosts


def plain_reputation(pages, outcomes):
    bad = defaultdict(bool)
    for p, b in outcomes:
        if b is not None:
            bad[p] |= b
    n, k = Counter(), Counter()
    for p, h in pages:
        n[h] += p in bad
        k[h] += bad.get(p, False)
    hosts = {h for _, h in pages}
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    up = {d: d.split(".")[-1] for d in domain.values()}

    def above(units, of):
        out = Counter()
        for u in units:
            out[of[u]] += units[u]
        return out

    counts = [({h: n[h] for h in hosts}, {h: k[h] for h in hosts})]
    for of in (domain, up):
        counts.append(tuple(above(c, of) for c in counts[-1]))
    total, worse = sum(counts[2][0].values()), sum(counts[2][1].values())
    prior = {s: (worse + 0.5) / (total + 1) if total else 0.5 for s in counts[2][0]}
    for level, of in ((2, None), (1, up), (0, domain)):
        size, gone = counts[level]
        mean = prior if of is None else {u: prior[of[u]] for u in size}
        over = sum((gone[u] - size[u] * m) ** 2 - size[u] * m * (1 - m) for u, m in mean.items())
        pairs = sum(size[u] * (size[u] - 1) * m * (1 - m) for u, m in mean.items())
        held = round(1 / min(0.5, max(0.001, over / pairs if pairs else 0)) - 1, 6)
        prior = {u: (m * held + gone[u]) / (held + size[u]) for u, m in mean.items()}
    return {h: (n[h], k[h], p, p - 1.645 * math.sqrt(p * (1 - p) / (n[h] + held + 1))) for h, p in prior.items()}


def test_reputation(spark):
    """Hosts are judged by their own pages, new ones by their domain, and few bad pages block nothing."""
    rng = np.random.default_rng(4)
    rate = {"bad.spam.net": 0.95, "www.spam.net": 0.9, "ok.good.net": 0.02, "www.good.net": 0.05, "m.other.com": 0.1}
    pages, outcomes = [], []
    for host, p in rate.items():
        for _ in range(80):
            pages.append((len(pages), host))
            outcomes.append((len(outcomes), bool(rng.random() < p)))
    pages += [(1_000 + i, h) for i, h in enumerate(["new.spam.net", "new.good.net", "one.other.com", "one.other.com"])] + [(0, "ok.good.net")]
    outcomes += [(1_002, True), (1_003, None), (77_777, True), (5, False), (5, True)]
    df, told = spark.createDataFrame(pages, "page_id long, host string").repartition(3), spark.createDataFrame(outcomes, "page_id long, bad boolean").repartition(3)
    got = {r.host: (r.n, r.bad, pytest.approx(r.share, abs=1e-5), pytest.approx(r.low, abs=1e-5)) for r in url_filter.host_reputation(df, told).collect()}
    assert got == plain_reputation(pages, outcomes)
    urls = df.withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/p")))
    verdict = {r.host: r.verdict for r in url_filter.judge(urls, told).collect()}
    assert verdict == {h: "block" if "spam" in h and h != "new.spam.net" else "allow" for _, h in pages} | {"new.spam.net": verdict["new.spam.net"]}


def test_url_filter_is_native(spark):
    pages, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "labels"))
    plan = url_filter.judge(pages, url_filter.label_outcomes(labels))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)

"""The pipeline's near dedup against plain Jaccard similarities of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def corpus(seed=3):
    """Unrelated texts, their copies with more and more words changed, and texts that share a long passage."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5_000, n)]
    passage, texts = word(60), []
    for n in rng.integers(40, 300, 60):
        own = word(n)
        for changed in (0, 1, 2, 3, 4, 6, 8, 12):
            copy = list(own)
            for at in rng.integers(0, n, changed):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + word(80)))
    return [*enumerate(texts), (9_000, ""), (9_001, " \n"), (9_002, "One"), (9_003, "one"), (9_004, None)]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    return {r.doc_id: r.text for r in corpus_pipeline.near(spark, docs, "").collect()}


def test_similar_texts_meet_and_others_stay(spark):
    rows = corpus()
    kept = stage(spark, rows)
    sets = {i: plain_set(t) for i, t in rows}
    near, close = {}, {}
    ids = [i for i, _ in rows]
    for x, i in enumerate(ids):
        for j in ids[:x]:
            shared = len(sets[i] & sets[j])
            if shared:
                s = shared / (len(sets[i]) + len(sets[j]) - shared)
                if s >= 0.8:
                    near.setdefault(i, []).append(j)
                if s >= 0.6:
                    close.setdefault(i, []).append(j)
                    close.setdefault(j, []).append(i)
    assert len(near) > 150
    assert sum(i not in kept for i in near) >= 0.97 * len(near)  # a smaller id is at least 0.8 alike
    assert all(i in kept for i in ids if i not in close)  # nothing unlike goes
    assert sorted(i for i in kept if i >= 9_000) == [9_000, 9_002]
    assert {i: t for i, t in rows if i in kept} == kept


def test_pairs_around_the_bound(spark):
    """Pairs of 200 words of any similarity: those of 0.8 and more are found, and none below it goes."""
    rng = np.random.default_rng(8)
    rows, jaccard = [], {}
    for k in range(900):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        other = list(own)
        for at in rng.integers(0, 200, rng.integers(1, 12)):
            other[at] = f"y{rng.integers(0, 10**6)}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        a, b = plain_set(rows[-2][1]), plain_set(rows[-1][1])
        jaccard[2 * k + 1] = len(a & b) / len(a | b)
    kept = stage(spark, rows)
    near = [i for i, j in jaccard.items() if j >= 0.8]
    close = [i for i in near if jaccard[i] < 0.82]
    assert len(near) > 200 and len(close) > 20 and 900 - len(near) > 300
    assert all(i in kept for i in range(0, 1_800, 2)) and all(i in kept for i, j in jaccard.items() if j < 0.8)
    assert sum(i not in kept for i in close) >= 0.9 * len(close) and sum(i not in kept for i in near) >= 0.97 * len(near)


def test_columns_and_empty(spark):
    names = ("node", "size", "component", "row", "text_hash", "sketch", "lead", "a", "b", "bucket", "_id", "_text")
    docs = spark.createDataFrame([(1, "a b", "en", "a", 1)] * 2 + [(None, "c d", "en", "a", 1)], DOCS).withColumns({c: F.col("doc_id") + 7 for c in names})
    got = simhash.keep_similar(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(set(map(tuple, docs.collect())), key=str)
    assert simhash.keep_similar(docs.limit(0)).count() == 0


def test_repeated_lines_do_not_decide(spark):
    """Texts of one line many times over and different ends: fingerprints are near, shingle sets are not."""
    line = " ".join(f"line{k}" for k in range(13))
    rows = [(i, " ".join([line] * 40 + [f"own{i}x{k}" for k in range(50)])) for i in range(6)]
    fps = [simhash.fingerprint_bytes(t.encode(), 5) for _, t in rows]
    assert any((fps[0] ^ f).bit_count() <= 4 for f in fps[1:])
    assert stage(spark, rows) == dict(rows)


@pytest.mark.parametrize("all_pairs", [1_024, 3])
def test_links_of_a_bucket(monkeypatch, all_pairs):
    """Whatever is held against single rows first, the components are those of all pairs."""
    monkeypatch.setattr(simhash, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(simhash, "PAIRS", 1_000)
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 1 << 63, simhash.LANES, dtype=np.uint64) for _ in range(20)]
    for _ in range(180):
        w = words[rng.integers(0, len(words))].copy()
        for b in rng.integers(0, 512, rng.integers(1, 60)):
            w[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        words.append(w)
    words = np.array(words)
    a, b, sure = simhash.link_bucket(np.arange(200), words, 40, 70)
    far = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)

    def components(pairs):
        label = np.arange(200)
        for _ in range(200):
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label.tolist()

    x, y = np.nonzero(far <= 40)
    pairs = [p for p in zip(x, y) if p[0] < p[1]]
    assert sure.sum() < 200 and components(list(zip(a[sure], b[sure]))) == components(pairs)
    doubtful = list(zip(a[~sure], b[~sure]))
    assert doubtful and all(40 < far[p] <= 70 for p in doubtful)
    x, y = np.nonzero(far <= 70)
    assert components(list(zip(a, b))) == components([p for p in zip(x, y) if p[0] < p[1]])  # if all were alike
    label = components(pairs)
    for i in range(200):  # each row's nearest of another group is looked at
        others = [(far[i, j], j) for j in range(200) if label[i] != label[j] and far[i, j] <= 70]
        assert not others or all_pairs == 3 or any(far[p] <= min(others)[0] for p in doubtful if i in p)


def test_thresholds_reach_the_bound():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, (400, simhash.LANES), dtype=np.uint64)
    differ = simhash.apart(0.8)
    for rows in (10**3, 10**6, 10**10):
        layout = simhash.sketch_plan(sample, rows, differ)
        bits = [b for own, _ in layout for b in own]
        assert len(bits) == len(set(bits)) <= simhash.SKETCH
        miss = 1.0
        for own, t in layout:
            k = len(own)
            miss *= 1 - (1 - differ) ** k - (k * differ * (1 - differ) ** (k - 1) if t else 0)
        assert 1 - miss >= simhash.MEET - 0.02

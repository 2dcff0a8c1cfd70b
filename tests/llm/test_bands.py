"""Near dedup's rows and pairs grow with the texts and their likeness, not with the square of the texts or with tables to probe."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import shingles, simhash

DOCS = "doc_id long, text string"


def plain_sketch(own):
    bits = np.zeros(shingles.SKETCH, np.int64)
    for x in own:
        y = np.full(1, x, np.uint64) * shingles._LANES
        y ^= y >> np.uint64(31)
        y *= np.uint64(0x9FB21C651E98DF25)
        y ^= y >> np.uint64(29)
        bits += np.unpackbits(y.view(np.uint8), bitorder="little")
    return np.packbits(bits * 2 > len(own), bitorder="little").view(np.uint64)


def test_unlike_texts_do_not_meet(spark):
    """Rows dealt are as many a text in a large table as in a small one, and only like texts share a bucket."""
    rng = np.random.default_rng(4)
    common = [f"c{k}" for k in rng.integers(0, 300, 40)]
    own = [[f"w{k}" for k in rng.integers(0, 300, 160)] for _ in range(3_000)]  # few words: unlike sketches, no common shingles but those of a passage
    texts = [" ".join(common + w) for w in own]
    docs = spark.createDataFrame([*enumerate(texts), *((10_000 + i, t + " end") for i, t in enumerate(texts[:50]))], DOCS)
    rows = simhash.sketches(docs, 5, 0.8).select("doc_id", F.explode("bands").alias("bucket")).cache()
    assert rows.count() == 3_050 * shingles.bands_needed(0.8, simhash.MEET) <= 3_050 * 16
    met = rows.alias("x").join(rows.alias("y"), "bucket").filter("x.doc_id < y.doc_id").select("x.doc_id", "y.doc_id").distinct().collect()
    assert {(i, 10_000 + i) for i in range(50)} <= set(map(tuple, met)) and len(met) < 3_050  # 32 partitions of 12 bits would let some 36,000 meet


def test_bands_reach_the_bound():
    """Sets at the bound share a band as often as stated, and less like ones ever more seldom."""
    rng, count = np.random.default_rng(2), shingles.bands_needed(0.8, simhash.MEET)
    seen = {}
    for similarity in (0.8, 0.4):
        alike = round(2 * similarity / (1 + similarity) * 450)
        sets = [rng.integers(0, 1 << 63, 900 - alike, dtype=np.uint64) for _ in range(400)]
        both = np.concatenate([np.r_[np.sort(s[:450]), np.sort(s[-450:])] for s in sets])
        of = shingles.bands(both, np.arange(0, len(both), 450), count)
        seen[similarity] = (of[::2] == of[1::2]).any(axis=1).mean()
    assert seen[0.8] >= simhash.MEET - 0.02 and seen[0.4] < 0.25


@pytest.mark.parametrize("counted", [1 << 16, 64])
def test_sets_and_sketches_are_those_of_single_texts(monkeypatch, counted):
    monkeypatch.setattr(shingles, "COUNTED", counted)
    rng = random.Random(4)
    texts = [b"", b" ", b"a", b"A b", b"a b c d e", b"a b c d e f", b"x" * 40_000 + b" y z", b"y " * 700, b"\x0b\x0c", "é ".encode() * 7, b" ".join(b"w%d" % rng.randrange(900) for _ in range(2_000))]
    texts += [bytes(rng.choice(b"abC \n\t") for _ in range(rng.randrange(60))) for _ in range(400)]
    hashed, shown = {}, {}
    for a in range(0, len(texts), 97):
        sets, at = shingles.shingle_sets(texts[a : a + 97], 5)
        made = shingles.sketches(sets, at)
        for text, own, sketch in zip(texts[a : a + 97], np.split(sets, at[1:]), made):
            words = text.lower().split()
            plain = frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
            assert len(own) == len(plain) and (own[1:] > own[:-1]).all() and (sketch == plain_sketch(own)).all()
            assert hashed.setdefault(plain, own.tobytes()) == own.tobytes() and shown.setdefault(own.tobytes(), plain) == plain


@pytest.mark.parametrize("few", [1, 6])
def test_small_buckets_are_linked_as_large_ones(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_ROWS", few)
    rng, rows = np.random.default_rng(1), []
    for g in range(40):
        own = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
        for v in range(1 + g % 5):
            rows.append((g * 10 + v, " ".join([*own[: 119 - v], f"v{v}"])))
    got = {r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {g * 10 for g in range(40)}


def family(seed=6, texts=45):
    """Sets that share most of 400 hashes, in three groups, with sketches and bands."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: 400 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in rng.integers(8, 50, texts)]
    whole, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    return sets, shingles.sketches(whole, at), shingles.bands(whole, at, 12), np.arange(texts) % 3


def joined(n, x, y):
    label = np.arange(n)
    for _ in range(n):
        for a, b in zip(x, y):
            label[a] = label[b] = min(label[a], label[b])
    return label.tolist()


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_pairs_of_a_bucket_are_judged_where_they_lie(monkeypatch, held):
    """What a bucket's sets connect is what all its pairs do, each judged in the first band that it shares, in blocks as at once."""
    monkeypatch.setattr(simhash, "HELD_WORDS", held)
    monkeypatch.setattr(simhash, "NEAR_PAIRS", 700)
    sets, words, own, group = family()
    n = len(sets)
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(s) for s in sets])
    alike = (both >= 0.8 * (size[:, None] + size[None] - both)) & (group[:, None] != group[None]) & (own[:, None] == own[None]).any(axis=2)
    alike &= np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= 101
    assert 50 < alike.sum() < n * n / 2
    for blocks in (1, 3):
        links = []
        for bucket in np.unique(own):
            at = np.flatnonzero((own == bucket).any(axis=1))
            for i in range(blocks):
                for j in range(i, blocks):
                    some = at[(at % blocks == i) | (at % blocks == j)]
                    if len(some) > 1:
                        x, y = simhash.alike_rows(bucket, words[some], own[some], group[some], some % blocks, [sets[k] for k in some], 0.8, 101)
                        assert len(x) < len(some)
                        links += zip(some[x].tolist(), some[y].tolist())
        assert joined(n, *zip(*links)) == joined(n, *np.nonzero(alike))


def test_open_pairs_are_no_rows(spark, monkeypatch):
    """A large group of texts around the bound: the rows of the last step grow with its texts, not with its pairs."""
    rng, made = np.random.default_rng(3), []
    base = [f"w{k}" for k in rng.integers(0, 10**6, 200)]
    rows = []
    for v in range(260):
        own = list(base)
        for at in rng.choice(200, 6, replace=False):
            own[at] = f"y{rng.integers(0, 10**6)}"
        rows.append((v, " ".join(own)))
    written = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: made.append((name, out := written(df, name), out.count())[::2]) or out)
    simhash.keep_similar(spark.createDataFrame(rows, DOCS)).count()
    assert "open-sketches" in dict(made) and max(n for _, n in made) <= 20 * 260  # pairs: 33,670

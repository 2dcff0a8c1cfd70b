"""Each operator against a plain version over whole small tables, and its edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bpe, chat, exact_dedup, gru, kd_search, language, mixing, queries, sharding, simhash, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
PASSAGE = "The council met on Tuesday and agreed, after a long debate, that the bridge over the river would be closed for repairs. "
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t", None, "a", 5), (4, "1234 %%% 99", "en", None, 11),
    (5, "Tie of words here", "en", "b", 17), (6, "Tie of words here", "en", "b", 17), (7, "Tie of words here", "fr", "c", 17),
    (8, "aaaa" * 300, "en", "b", 1200), (9, PASSAGE * 40, "en", "b", 1), (10, "x " + PASSAGE * 2, "en", "c", 1), (11, PASSAGE + "tail", "en", "c", 1),
    (12, "Ünïcode ñandú ß Σίσυφος 한국어 " + PASSAGE, "de", "d", 1), (13, "<|endoftext|> ok", "en", "d", 1), (-5, "negative id " + PASSAGE, "en", "d", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=EDGES):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "digest", "shard", "fp", "score", "target", "rank", "kmer", "held_out")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# exact dedup


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup(spark, docs, share, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 37)
    both = docs.unionByName(frame(spark).select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    rows, groups = exact_dedup.duplicate_groups(both, share)
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in groups.collect()}
    want = {bytes.fromhex(s): (k, n) for _, k, n, _, s in plain_exact(rows_of(both))}
    assert got == want
    assert sorted(rows_of(exact_dedup.exact_dedup(both))) == plain_exact(rows_of(both))


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    twice = frame(spark, [EDGES[4], EDGES[4], EDGES[0]])
    assert sorted(rows_of(exact_dedup.keep_one(twice).select("doc_id"))) == [(1,), (5,)]
    assert exact_dedup.keep_one(frame(spark)).columns == frame(spark).columns
    null_id = frame(spark, [(None, "x", None, None, 1), (3, "x", None, None, 1), (None, "y", None, None, 1)])
    assert sorted(r[:4] for r in rows_of(exact_dedup.exact_dedup(null_id).orderBy("doc_id")) if r[0]) == [(3, 3, 2, True)]


def test_minimal_perfect_hash():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8).reshape(-1, 32)
    levels = exact_dedup.build_mph(keys)
    assert sorted(exact_dedup.slots_of(levels, keys)) == list(range(3000))


def test_hot_key_join(spark, monkeypatch):
    from cadenza.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 0.0)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert Counter(r.n for r in common.join_groups(rows, groups, "k", "n").collect()) == {4000: 4000, 1: 1000}


def test_written_tables_are_released(spark):
    import os

    from cadenza.llm import common

    common.release(spark)
    out = common.written(spark.range(3), "some")
    where = out.inputFiles()[0].removeprefix("file://")
    assert out.count() == 3 and os.path.exists(where)
    assert common.release(spark) == 1 and not os.path.exists(where) and common.release(spark) == 0


# sharding


def check_shards(source, got, n):
    want = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in source}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == want and len(got) == len(source)
    total, upto = sum(r.size for r in got), 0
    order = sorted(got, key=lambda r: (r.doc_id, r.text_crc32))
    for r in order:
        assert r.shard == min(n - 1, (2 * upto + r.size) * n // (2 * total))
        upto += r.size
    slots = defaultdict(list)
    for r in order:
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())


def test_sharding(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 23)
    check_shards(rows_of(docs), sharding.assign_shards(docs).collect(), 24)
    check_shards(EDGES, sharding.assign_shards(frame(spark), 3).collect(), 3)
    assert sharding.assign_shards(frame(spark, [])).count() == 0


# mixing


def plain_targets(sizes, weights=3, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % weights + 1 for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def test_mixing(spark, docs):
    for df in (docs, frame(spark), frame(spark, EDGES[:2])):
        got = mixing.mix_plan(df).collect()
        sizes = Counter()
        for r in df.select("source", "text").collect():
            sizes[r.source] += len((r.text or "").encode().split())
        want = plain_targets(sizes)
        source = {r.doc_id: r.source for r in df.collect()}
        assert len(got) == df.count()
        for r in got:
            assert r.target == pytest.approx(want[source[r.doc_id]], abs=1e-4) and r.source_size == sizes[source[r.doc_id]]
            assert 0 <= r.taken <= 3 * r.size
            rate = r.target / r.source_size if r.source_size else 0
            assert not r.size or int(rate) <= r.taken // r.size <= int(rate) + 1
    assert sorted(rows_of(mixing.mix_plan(docs))) == sorted(rows_of(mixing.mix_plan(docs.repartition(5))))
    assert mixing.mix_plan(frame(spark, [])).count() == 0
    taken = {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()}
    words = Counter()
    for r in mixing.mix(docs).collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert {i: n for i, n in taken.items() if n} == +words


def test_mixing_draws_rows_apart(spark):
    """Rows without a doc_id, with the same one, and rows that are wholly equal: a source's taken words come near its target."""
    texts = [f"w{i} " * 4 for i in range(3_000)]
    rows = [(None, t, "en", "a", 1) for t in texts] + [(7, t, "en", "b", 1) for t in texts] + [(8, "same words here now", "en", "c", 1)] * 3_000 + [(i, "x y", None, None, 1) for i in range(100, 150)]
    for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(7)):
        got = mixing.mix_plan(df).collect()
        assert len(got) == len(rows)
        taken, target = Counter(), {}
        for r in got:
            taken[r.target, r.source_size] += r.taken
            target[r.target, r.source_size] = r.target
            assert r.taken <= 3 * r.size
        for k, t in target.items():
            assert abs(taken[k] - t) <= 0.06 * t + 30, (k, taken[k])
        if df.rdd.getNumPartitions() == 7:
            assert sorted((r.doc_id or -1, r.size, r.target, r.taken) for r in got) == before
        before = sorted((r.doc_id or -1, r.size, r.target, r.taken) for r in got)
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns and abs(mixed.filter("source = 'c'").count() * 4 - taken_of(got, 8)) == 0
    mixing_alone = mixing.placed(frame(spark, rows).select("doc_id", "text"), "doc_id")
    places = {}
    for r in mixing_alone.collect():
        places.setdefault(r.doc_id, []).append(r.place)
    assert sorted(places[7]) == list(range(3_000)) and sorted(places[None]) in (list(range(3_000)), [0] * 3_000)


def taken_of(rows, doc_id):
    return sum(r.taken for r in rows if r.doc_id == doc_id and r.size == 4)


# chat


def test_chat_round_trip(spark):
    texts = ["hi", None, "a\\b <|end|>\n<|turn user|> \\\\", queries.PLANTED_TURN, "", "é🙂"]
    rows = [(c, t, role, texts[((c or 0) + t) % len(texts)]) for c in (1, 2, None) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "a|>b"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    turns = chat.format_turns(chat.text_messages(df))
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    for c in (1, 2, None):
        own = [(r or "", x or "") for cc, _, r, x in rows if cc == c]
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == 6 and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(t.formatted) for t in turns.collect() if t.conv_id == c)
    assert chat.read_back(chat.format_turns(chat.text_messages(df.limit(0)))).count() == 0


def test_chat_parts(spark):
    parts = [[("text", "see <|image 0|>", None, None), ("image", None, "s3://a.png", 400.0), ("audio", None, "b.wav", 2.0), ("odd", "x", None, None), None, ("document", None, "c.pdf", 7.0)]]
    df = spark.createDataFrame([(1, 0, "user", parts[0]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert first.formatted == "<|turn user|>see \\<\\|image 0\\|><|image 0|><|audio 1|>x<|document 2|><|end|>\n"
    assert [tuple(a) for a in first.attachments] == [(0, "image", "s3://a.png", 101), (1, "audio", "b.wav", 101), (2, "document", "c.pdf", 9)]
    assert first.expanded_tokens == 211 and second.formatted == "<|turn assistant|><|end|>\n" and second.loss_from == second.loss_to


# top k


def plain_top(vectors, k=10):
    out = []
    for i, v in vectors:
        if i % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("boxes, scale", [(1 << 23, 8), (1 << 23, 2.0**-17), (0, 0.125), (80, 8)])
def test_top_k(spark, monkeypatch, boxes, scale):
    """Small, large and very large numbers, ties, a vector that a third of the rows share, with many cells, few of many shards, and one."""
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 20)
    monkeypatch.setattr(kd_search, "BLOCK_ROWS", 2)
    monkeypatch.setattr(kd_search, "BOX_NUMBERS", boxes)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 5) / scale]) for i in range(300)] + [(i, [1.0 / scale] * 5) for i in range(300, 450)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(1))
    got = kd_search.top_k(kd_search.scaled(df), kd_search.scaled(df).filter("vec_id % 100 = 0"))
    assert sorted(rows_of(got)) == plain_top([(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors])


def test_exact_kinds():
    assert [kd_search.exact_kind(64, 2**a, 2**b) for a, b in ((10, 10), (23, 22), (30, 20), (20, 30), (40, 40))] == ["float64", "float64", "int64", "int64", "object"]
    q = np.array([[2**40, -(2**41)]]).astype("object")
    assert kd_search.box_bounds(q, np.array([[0, -(2**40)]]).astype("object"), np.array([[2**40, 2**40]]).astype("object"))[0, 0] == 2**80 + 2**81


def test_shards_are_passed_over(spark, monkeypatch):
    """In cells of several shards, too, a query is sent to few of them."""
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 25)
    monkeypatch.setattr(kd_search, "CELLS", 16)
    asked = []
    searched = kd_search._searched
    monkeypatch.setattr(kd_search, "_searched", lambda rows, *a: (asked.append(rows.count()), searched(rows, *a))[1])
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 9
    vectors = [(i, [float(x) for x in centres[i % 16] + rng.normal(size=8) / 8]) for i in range(3_000)]
    df = kd_search.scaled(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = kd_search.top_k(df, df.filter("vec_id % 100 = 0"))
    assert sorted(rows_of(got)) == plain_top([(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors])
    assert asked[0] == 30 and asked[1] < 30 * 16


def test_top_k_edges(spark):
    odd = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (100, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = kd_search.scaled(spark.createDataFrame(odd, "vec_id long, embedding array<float>"))
    got = sorted(rows_of(kd_search.top_k(df, df.filter("vec_id % 100 = 0"))))
    assert got == [(0, 1, 7, 5 * 1024**2), (0, 2, 100, 5 * 1024**2), (100, 1, 0, 5 * 1024**2), (100, 2, 7, 5 * 1024**2)]
    assert kd_search.top_k(df.limit(0), df.limit(0)).count() == 0


# BPE


def test_bpe_round_trip(spark, docs):
    library = Tokenizer.from_file(queries.VOCABULARY)
    both = docs.select("doc_id", "text").unionByName(frame(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    want = {}
    for i, t in rows_of(both):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r[0]: r[1:] for r in rows_of(bpe.round_trip(both, queries.VOCABULARY))} == want
    some = bpe.decode_column(bpe.encode_column(frame(spark), queries.VOCABULARY), queries.VOCABULARY).collect()
    for r in some:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == library.decode(r.token_ids, skip_special_tokens=False)
    assert bpe.round_trip(frame(spark, []), queries.VOCABULARY).count() == 0


def test_bpe_random_unicode():
    mine, library = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    spans = [(32, 127), (128, 0x600), (0x600, 0x3000), (0x3000, 0xD7FF), (0xE000, 0x20000)]
    for _ in range(400):
        text = "".join(chr(rng.integers(*spans[rng.integers(0, 5)])) for _ in range(30))
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_long_words():
    """A long run of letters is merged in blocks as a short one is at once."""
    mine = bpe.WordBpe(queries.VOCABULARY)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (300, 1_000, 2_500)] + ["a" * 700, "ab" * 600, "the" * 300]
    for word in words:
        symbols = [mine.symbols[b] for b in word.encode()]
        symbols[-1] += mine.END
        parts = symbols
        while True:
            ranks = [mine.ranks.get(p, bpe.NO_RANK) for p in zip(parts, parts[1:])]
            if not ranks or min(ranks) == bpe.NO_RANK:
                break
            i = ranks.index(min(ranks))
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        assert mine.merge(word) == [mine.vocab[p] for p in parts]


# suffix-array dedup


def plain_substrings(rows, length):
    seen, out = set(), []
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("slab", "hot", "sort"), [(1 << 19, 1_500, 1 << 20), (700, 1, 50), (300, 50_000, 1), (1 << 19, 3, 400)])
def test_substring_dedup(spark, docs, monkeypatch, slab, hot, sort):
    for k, v in (("SLAB", slab), ("HOT_SPANS", hot), ("SORT_ROWS", sort)):
        monkeypatch.setattr(substring_dedup, k, v)
    both = docs.unionByName(frame(spark).select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    want = plain_substrings(rows_of(both.select("doc_id", "text")), 100)
    assert sorted(rows_of(substring_dedup.substring_dedup(both).drop("removed").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) == want


@pytest.mark.parametrize("texts, rows, listed", [(10, 1, 0), (4_000, 2, 10**6)])
def test_hot_anchors_change_nothing(spark, docs, monkeypatch, texts, rows, listed):
    """Anchors that count as hot from a few spans on, told from a few texts or all, their list joined or broadcast."""
    for k, v in (("HOT_TEXTS", texts), ("HOT_ROWS", rows), ("HOT_SHARE", 0.0), ("BROADCAST_ANCHORS", listed)):
        monkeypatch.setattr(substring_dedup, k, v)
    both = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2_000)).select("doc_id", "text")
    many = both.unionByName(spark.createDataFrame([(5_000 + i, f"{PASSAGE} {i} {PASSAGE}") for i in range(12)], both.schema))
    want = plain_substrings(rows_of(many), 100)
    assert sorted(rows_of(substring_dedup.substring_dedup(many).drop("removed").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) == want


@pytest.mark.parametrize("bits", [0, 2, 40])
@pytest.mark.parametrize("known", [0, 100_000])
def test_substring_hashes_only_find_candidates(monkeypatch, bits, known):
    """With hashes of few bits nearly everything collides; bytes decide, so results stay the same."""
    import pandas as pd

    def weak(x):
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) if bits else x * np.uint64(0)

    monkeypatch.setattr(substring_dedup, "_mix", weak)
    monkeypatch.setattr(substring_dedup, "SLAB", 900)
    monkeypatch.setattr(substring_dedup, "KNOWN_SPANS", known)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(0, 400, 30)]
    texts += [texts[3] + texts[5], texts[7][10:], "ab" * 150, "ab" * 90, texts[5], PASSAGE * 3]
    rows, length = list(enumerate(texts)), 40
    docs = pd.DataFrame({"doc_id": range(len(texts)), "rep": 0, "text": texts})
    spans = pd.concat(list(substring_dedup._spans(length)(iter([docs.iloc[:9], docs.iloc[20:], docs.iloc[9:20]]))), ignore_index=True)
    gone = [(r.doc_id, r.start, r.start + r.bytes) for r in spans.itertuples() if r.sure]
    left = spans[~spans["sure"]]
    left = left[left.groupby("kmer")["kmer"].transform("size") > 1].sort_values("kmer")
    left = left.assign(bytes=[texts[i].encode()[a : a + n] for i, a, n in zip(left["doc_id"], left["start"], left["bytes"])])
    for cut in substring_dedup._sorted_groups(length)(iter([left.iloc[:50], left.iloc[50:]])):
        gone += cut[["doc_id", "lo", "hi"]].itertuples(index=False, name=None)
    hot = [g for g in substring_dedup._own_groups(length)(iter([left.iloc[:70], left.iloc[70:]]))]
    assert sum(g["window"].isna().sum() for g in hot) > 0
    for i, n, removed, spans_, _ in plain_substrings(rows, length):
        runs = substring_dedup.merged([(a, z) for d, a, z in gone if d == i])
        assert (sum(z - a for a, z in runs), len(runs)) == (removed, spans_)


def test_substring_dedup_edges(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    twice = [(1, PASSAGE, None, None, 0), (1, PASSAGE, None, None, 0), (None, PASSAGE[:110], None, None, 0)]
    got = sorted(rows_of(substring_dedup.substring_dedup(frame(spark, twice)).select("doc_id", "n_removed")), key=str)
    assert got == [(1, 110), (1, len(PASSAGE)), (None, 0)]


# simhash


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(pairs, distance=4):
    ids = list(pairs)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (pairs[i] ^ pairs[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_dedup(spark, docs):
    both = docs.unionByName(frame(spark).select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    fps = {i: plain_fingerprint(t) for i, t in rows_of(both.select("doc_id", "text"))}
    roots = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(both).collect()}
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}
    assert simhash.near_dedup(frame(spark, [])).count() == 0
    assert simhash.keep_one(both, width=4).count() == len(set(roots.values()))
    assert simhash.keep_one(frame(spark, [EDGES[4], EDGES[4]])).count() == 1


@pytest.mark.parametrize(("bucket", "parts"), [(20_000, None), (8, None), (8, 3), (20_000, 2)])
def test_links_of_clusters(spark, monkeypatch, bucket, parts):
    """Fingerprints in chains and dense clusters: no link is lost, whatever the partitions and blocks."""
    rng = np.random.default_rng(5)
    fps = list(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
    for _ in range(500):
        f = fps[rng.integers(0, len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            f = f ^ np.uint64(1 << int(b))
        fps.append(f)
    nodes = {i: int(f) for i, f in enumerate(dict.fromkeys(map(int, fps)))}
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    if parts:
        whole = simhash.plan(np.array(list(nodes.values()), np.uint64), len(nodes), 4)
        layout = [(g, t) for g, t in zip(simhash.group_bits(np.array(list(nodes.values()), np.uint64), parts), {2: [2, 1], 3: [1, 1, 0]}[parts])]
        monkeypatch.setattr(simhash, "plan", lambda *a: layout)
        assert sum(t + 1 for _, t in whole) == 5
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in nodes.items()], "node long, fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df, 4)).collect()}
    want = plain_components(nodes)
    assert {i: got.get(i, i) for i in nodes} == want


def test_allocation_is_least():
    assert simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 9, 99]], 2) == [0, 1, -1]


# networks


def test_gradients():
    rng = np.random.default_rng(0)
    U = {k: v.astype(np.float64) for k, v in gru.init_direction(rng, 3).items()}
    x = {g: rng.normal(size=(4, 2, 3)) * 0.3 for g in gru.GATES}
    mask, goal = np.array([[1, 1], [1, 1], [1, 0], [1, 1]], float), rng.normal(size=(4, 2, 3))

    def loss():
        h, out = np.zeros((2, 3)), 0.0
        for t in range(4):
            r, z = gru.hard_sigmoid(x["r"][t] + h @ U["Ur"]), gru.hard_sigmoid(x["z"][t] + h @ U["Uz"])
            n = np.clip(x["n"][t] + (r * h) @ U["Un"], -1, 1)
            h = h + mask[t][:, None] * (1 - z) * (n - h)
            out += (h * goal[t]).sum()
        return out

    _, tape = gru.forward({g: v.astype(np.float32) for g, v in x.items()}, {k: v.astype(np.float32) for k, v in U.items()}, mask.astype(np.float32), True)
    gU, gI = gru.backward(goal.astype(np.float32), tape, {k: v.astype(np.float32) for k, v in U.items()})
    for store, grad in ((U, gU), (x, gI)):
        for k, v in store.items():
            at = tuple(rng.integers(0, n) for n in v.shape)
            v[at] += 1e-5
            up = loss()
            v[at] -= 2e-5
            down = loss()
            v[at] += 1e-5
            assert grad[k][at] == pytest.approx((up - down) / 2e-5, abs=2e-3)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = docs.unionByName(frame(spark).select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    got = {r.doc_id: r for r in language.identify(both).collect()}
    assert len(got) == both.count()
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held) > 100
    assert [got[10_000 + i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(frame(spark, [])).count() == 0 and language.keep_identified(frame(spark)).columns == frame(spark).columns


def test_toxicity(spark):
    """Held-out labels at sf0.1, within the spread of the folds (README)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, model).collect() if r.held_out and r.doc_id in known]
    toxic, clean = [[r.predicted for r in got if known[r.doc_id] == k] for k in (1, 0)]
    print(f"found {sum(toxic)} of {len(toxic)}, flagged {sum(clean)} of {len(clean)}")
    assert sum(toxic) >= 0.84 * len(toxic) > 50 and sum(clean) <= 0.06 * len(clean)
    edge = {r.doc_id: r for r in toxicity.score(frame(spark), model).collect()}
    assert edge[1].score == edge[2].score == edge[4].score == 0.0 and len(edge) == len(EDGES)
    assert toxicity.toxicity(frame(spark, []), labels.limit(0)).count() == 0


def test_toxicity_gradients():
    """Every part of the network against differences of its loss."""
    model = toxicity.init(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    windows = [(["bad", "word", "here", "word"], 0, 4), (["fine", "words"], 0, 1), (["x"], 0, 1), (["other", "bad", "longerword"], 1, 3)]
    y = np.array([1.0, 0.0, 0.0, 1.0])
    grads, _ = toxicity.gradients(model, windows, y)
    rng = np.random.default_rng(1)
    for name, v in model.p.items():
        g = grads[name]
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        for place in (at, tuple(rng.integers(0, n) for n in v.shape)):
            v[place] += 1e-3
            up = toxicity.gradients(model, windows, y)[1]
            v[place] -= 2e-3
            down = toxicity.gradients(model, windows, y)[1]
            v[place] += 1e-3
            assert g[place] == pytest.approx((up - down) / 2e-3, abs=1e-4, rel=0.05), name


def test_scorer_is_the_network():
    """The scorer's logits of all windows are those of the training pass."""
    model = toxicity.init(5)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(60)]
    got = toxicity.Scorer(model).logits([words])[0]
    assert len(got) == len(words) - toxicity.WORDS + 1
    for w, x in enumerate(got):
        loss = toxicity.gradients(model, [toxicity.window_in(words, w)], np.zeros(1))[1]  # log(1 + exp(logit))
        assert loss == pytest.approx(np.logaddexp(0, x), abs=1e-4)


def test_calibration_stands_labels_that_nothing_explains():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(-4, 0.5, 200), rng.normal(4, 0.5, 57), rng.normal(-4, 0.5, 3)]
    y = np.r_[np.zeros(200), np.ones(60)]
    slope, offset = toxicity.calibrate(x, y, np.where(y > 0, 0.1 / 60, 0.9 / 200))
    score = 1 / (1 + np.exp(-(slope * x + offset)))
    assert slope == 1.0 and (score[:200] < 0.3).all() and (score[200:257] >= 0.3).all()


def test_language_scorer_is_the_network():
    """Byte label probabilities of the fast pass are those of the training pass over the same windows."""
    model = language.train(["the cat and the dog " * 9, "le chat et le chien " * 9], ["en", "fr"])
    text = "the dog et le chat, the end".encode()
    p, logits = model.params, 0
    ids = np.frombuffer(text, np.uint8).astype(np.int64)[:, None]
    for d in "fb":
        E, U = model.direction(d)
        seen = ids if d == "f" else ids[::-1]
        out, _ = gru.forward({g: E[g][seen] for g in gru.GATES}, U, np.ones(seen.shape, np.float32), False)
        logits = logits + (out if d == "f" else out[::-1]) @ p[f"{d}V"]
    e = np.exp(logits + p["c"] - (logits + p["c"]).max(axis=-1, keepdims=True))
    want = (e / e.sum(axis=-1, keepdims=True)).mean(axis=0)[0]
    assert np.allclose(language.Scorer(model).probabilities([text])[0], want, atol=1e-4)


@pytest.mark.parametrize("most", [1, 5_000, 1 << 26])
def test_language_sample_is_bounded_as_a_whole(spark, monkeypatch, most):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs: seen.append(texts))
    monkeypatch.setattr(language, "ALL_CHARS", most)
    docs = spark.createDataFrame([(i, f"{'ab cd '[i % 5:]}" * 200, "xy"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    language.fit(docs)
    n = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60))
    assert len(seen[0]) == n and sum(map(len, seen[0])) <= max(most, n * language.WINDOW) and all(seen[0])


def test_windows_cover_every_word():
    """A window starts at every word, and lies whole in its stretch."""
    for n in range(1, 70):
        words = [str(i) for i in range(n)]
        assert toxicity.window_count(n) == (n - toxicity.WORDS + 1 if n >= toxicity.WORDS else 1)
        for w in range(toxicity.window_count(n)):
            stretch, start, end = toxicity.window_in(words, w)
            assert stretch[start:end] == words[w : w + toxicity.WORDS] and len(stretch) <= toxicity.STRETCH
            assert [i for i in toxicity.stretches_of(n)[w // toxicity.HOP] if i >= 0] == list(map(int, stretch))
    assert toxicity.window_count(0) == len(toxicity.stretches_of(0)) == 0


def test_long_text_scores_like_its_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 64)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    words = [w.replace("0", "a") for w in words]
    small = toxicity.Scorer(toxicity.init())
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 120_000)
    whole = toxicity.Scorer(toxicity.init()).logits([words])[0]
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 64)
    assert np.allclose(small.logits([words])[0], whole, atol=1e-4)


def test_repeated_rows_do_not_grow_the_toxicity_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, rate: seen.append((texts, toxic)))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"text {i} {c}") for i in ids for c in "cab"] + [(ids[0], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert seen == [([f"text {i} a" for i in ids], [i % 2 for i in ids])]

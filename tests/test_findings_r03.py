"""Cases that a review of the third round found."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import english, text
from cadenza.llm import simhash
from cadenza.operators import gather, nearest
from cadenza.sinks import published
from cadenza.sources import files


def test_half_milliseconds_are_exact(spark):
    """Seconds times a thousand miss some halves: every half up to ten seconds is told from whole microseconds."""
    df = spark.range(10_000).select((F.col("id") * 1_000 + 500).alias("us"))
    got = {r.us: r.ms for r in df.select("us", text.whole_ms(F.col("us")).alias("ms")).collect()}
    assert all(ms == round(us / 1_000) for us, ms in got.items())
    near = spark.createDataFrame([(1_499,), (1_501,), (-1_500,), (-501,)], "us long")
    assert [r.ms for r in near.select(text.whole_ms(F.col("us")).alias("ms")).collect()] == [1, 2, -2, -1]


def test_subtitles_of_half_milliseconds(spark):
    us = next(us for us in range(500, 10_000_000, 1_000) if round(us / 1_000_000 * 1000) != round(us / 1_000))
    line = spark.range(1).select(text.srt_block_ms(F.lit(1), text.whole_ms(F.lit(us)), F.lit(0), F.lit("a"))).first()[0]
    assert f"00:00:0{round(us / 1_000) // 1000},{round(us / 1_000) % 1000:03d} -->" in line


def test_pairs_beyond_the_likeliest(spark, monkeypatch):
    """Of three texts that meet, the nearest by sketch may be unlike while a farther one is alike: no link of the sets is left out."""
    rng, docs = np.random.default_rng(8), []
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))
    for g in range(12):  # variants of one text, many of a similarity around 0.8
        base = [word() for _ in range(150)]
        for v in range(14):
            own = list(base)
            for k in rng.choice(150, int(rng.integers(1, 5)), replace=False):
                own[k] = word()
            docs.append((g * 100 + v, " ".join(own)))
    sets = {d: set(simhash.shingle_set(t, 5).tolist()) for d, t in docs}
    lead = {d: d for d, _ in docs}
    find = lambda x: x if lead[x] == x else find(lead[x])
    for a, _ in docs:
        for b, _ in docs:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(simhash, "SET_ROWS", 2)
    monkeypatch.setattr(simhash, "MEET", 0.9999)
    monkeypatch.setattr(simhash, "MARGIN", 5.0)
    got = {r.doc_id for r in simhash.keep_similar(df).collect()}
    assert got == {find(d) for d, _ in docs}


def test_windows_are_dealt_by_blocks(spark):
    """A frame's sixteen features cost two or three shuffled rows, and clamped indexes are as often there as they are asked for."""
    features = spark.createDataFrame([(k, i, i * i) for k, n in (("a", 70), ("b", 5), ("c", 1)) for i in range(n)], "k string, idx long, v long")
    frames = spark.createDataFrame([(k, i, n) for k, n in (("a", 70), ("b", 5), ("c", 1)) for i in range(n)], "k string, frame long, n long").repartition(3)
    got = gather.clamped(frames, features, ("k",), "frame", "idx", (2, 1), 4, 6).groupBy("k", "frame").agg(F.sort_array(F.collect_list("idx")).alias("i")).collect()
    lengths = {"a": 70, "b": 5, "c": 1}
    assert len(got) == 76 and all(r.i == sorted(min(max(0, x), lengths[r.k] - 1) for x in range(2 * r.frame - 4, 2 * r.frame + 6)) for r in got)
    windows = gather.last_clamped_windows(frames, features, ("k",), "frame", "idx", (80, 25), 16)
    got = windows.groupBy("k", "frame").agg(F.sort_array(F.collect_list("idx")).alias("i"), F.sum("v").alias("v")).collect()
    for r in got:
        start = min(r.frame * 80 // 25, max(0, lengths[r.k] - 16))
        want = list(range(start, min(start + 16, lengths[r.k])))
        assert r.i == want and r.v == sum(x * x for x in want)
    assert "_block" in windows._jdf.queryExecution().toString()  # not joined index by index


def test_nearest_rows_by_products(monkeypatch):
    """Products only narrow down what is measured: distances and ties are those of the plain sum."""
    rng = np.random.default_rng(3)
    b = np.round(rng.normal(size=(300, 8)) * 2) / 2 + 1e6  # large norms, so that products lose many places
    b = np.r_[b, b[:100]]
    a = np.r_[b[50:90] + 0.25, np.round(rng.normal(size=(100, 8)) * 2) / 2 + 1e6]
    want = nearest.squared(a, b)
    for held in (1 << 22, 40, 8):
        monkeypatch.setattr(nearest, "HELD", held)
        d, at = nearest.nearest_rows(a, b)
        assert (at == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()


def test_files_are_read_by_name(spark, tmp_path):
    """What is read back is opened by name: no folder is listed, and a missing text is an error, a missing array none."""
    rows = spark.createDataFrame([("a", "boxes_pre_smooth", 0, [1.0, 2.0]), ("a", "boxes_pre_smooth", 1, [3.0, 4.0]), ("b", "affines_post_smooth", 0, [5.0])], "folder string, name string, idx long, values array<double>")
    published.dump_arrays(rows, str(tmp_path))
    back = files.arrays_of(spark.createDataFrame([("a",), ("b",), ("c",)], "folder string"), str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "x.txt").write_text("one\r\ntwo\n", newline="")
    names = spark.createDataFrame([("x.txt",)], "name string")
    assert [tuple(r) for r in files.texts(names, str(tmp_path)).collect()] == [("x.txt", "one\r\ntwo\n")]


def test_text_functions_take_few_rows(spark):
    """A batch of Arrow holds ten thousand whole texts, some times over: normal forms are made a hundred rows at a time."""
    t = F.col("t")
    df = spark.createDataFrame([("H\u00e9llo",), (None,)], "t string")
    out = df.select(text.basic_normal(t).alias("a"), text.basic_normal(t, False, True).alias("b"), text.compression_ratio(t).alias("c"), english.english_normal(t).alias("d"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [("h\u00e9llo", "h e l l o", 5 / len(zlib.compress("H\u00e9llo".encode())), "hello"), (None,) * 4]

"""Spectra, robust fits, array files, tickers and English forms against plain loops and known cases."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import english, text
from cadenza.operators import jobs, spectra, vectors
from cadenza.sources import files as sources
from cadenza.streaming import events as ev


def plain_stft(x, n_fft, hop, reflect):
    padded = np.pad(x, n_fft // 2, mode="reflect" if reflect else "constant")
    w = spectra.hann(n_fft)
    return np.array([[abs(sum(padded[t * hop + p] * w[p] * np.exp(-2j * np.pi * k * p / n_fft) for p in range(n_fft))) for k in range(n_fft // 2 + 1)] for t in range(1 + len(x) // hop)])


@pytest.mark.parametrize("reflect", [False, True])
@pytest.mark.parametrize("block", [2, 3, 512])
def test_stft_is_that_of_a_plain_loop(spark, monkeypatch, reflect, block):
    monkeypatch.setattr(spectra, "BLOCK", block)
    rng = np.random.default_rng(3)
    clips = {"long": rng.normal(size=61), "even": rng.normal(size=24), "least": rng.normal(size=5), "short": rng.normal(size=3)}
    df = spark.createDataFrame([(c, i, float(v)) for c, x in clips.items() for i, v in enumerate(x)], "clip string, idx long, x double")
    got = {(r[0], r[1]): r[2] for r in spectra.stft(df, ("clip",), "idx", "x", 8, 4, reflect).collect()}
    want = {(c, t): m for c, x in clips.items() if not (reflect and len(x) <= 4) for t, m in enumerate(plain_stft(x, 8, 4, reflect))}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert np.allclose(got[k], m)
    assert spectra.stft(df.limit(0), ("clip",), "idx", "x", 8, 4).count() == 0


def test_mel_forms(spark):
    basis = spectra.mel_basis(16_000, 400, 80)
    assert basis.shape == (80, 201) and (basis >= 0).all() and (basis.sum(axis=1) > 0).all()
    assert np.allclose(spectra.hz_of(spectra.mel_of(np.array([0.0, 440, 1000, 7600]))), [0, 440, 1000, 7600])
    assert np.allclose(spectra.mel_of(np.array([1000.0, 6400.0])), [15, 42])
    x = np.sin(2 * np.pi * 440 * np.arange(1600) / 16_000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "clip string, idx long, x double")
    mel = {r[1]: r[2] for r in spectra.log_mel_spectrogram(df, ("clip",), "idx", "x").collect()}
    padded = np.pad(x, 200, mode="reflect")
    power = np.array([np.abs(np.fft.rfft(padded[t * 160 : t * 160 + 400] * spectra.hann(400))) ** 2 for t in range(10)])
    level = np.log10(np.maximum(power @ basis.T, 1e-10))
    want = (np.maximum(level, level.max() - 8) + 4) / 4
    assert sorted(mel) == list(range(10)) and all(np.allclose(mel[t], want[t]) for t in range(10))
    scaled = spectra.mel_spectrogram(df, ("clip",), "idx", "x").collect()
    assert len(scaled) == 9 and all(0 <= v <= 1 and len(r[2]) == 80 for r in scaled for v in r[2])
    quiet = df.withColumn("x", F.col("x") * 0.01)  # louder ones are held at 1 in several bins
    linear = spectra.linear_spectrogram(quiet, ("clip",), "idx", "x").collect()
    assert all(int(np.argmax(r[2])) == 22 for r in linear if 3 <= r[1] <= 5)
    holes = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>").select(spectra.in_bands(F.col("v"), np.array([[1.0, 1.0]]))).collect()
    assert [r[0] for r in holes] == [[3.0], None]


def test_robust_similarity(spark):
    src = [[10.0, 10.0], [30.0, 12.0], [20.0, 22.0], [12.0, 31.0], [29.0, 33.0]]
    a, b, tx, ty = 1.5, 0.4, 7.0, -3.0
    dst = [[a * x - b * y + tx, b * x + a * y + ty] for x, y in src]
    off = [*dst[:4], [500.0, 900.0]]
    rows = [(0, src, dst), (1, src, off), (2, None, dst), (3, [[1.0, 1.0]] * 5, dst), (4, src[:1], dst[:1]), (5, src[:2], dst[:2])]
    df = spark.createDataFrame(rows, "id int, p array<array<double>>, q array<array<double>>")
    got = {r[0]: tuple(r[1]) for r in df.select("id", vectors.robust_similarity("p", "q")).collect()}
    for i, n in ((0, 5), (1, 4), (5, 2)):
        assert np.allclose(got[i][:4], (a, b, tx, ty)) and got[i][4] == n
    assert all(got[i] == (None,) * 5 for i in (2, 3, 4))


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "affines_pre_smooth.npy", np.arange(12.0).reshape(2, 2, 3))
    np.save(tmp_path / "other.npy", np.arange(3.0))
    (tmp_path / "boxes_pre_smooth.npy").write_bytes(b"no array")
    got = sorted((r["name"], r["idx"], r["values"]) for r in sources.arrays(spark, str(tmp_path)).collect())
    assert got == [("affines_pre_smooth", 0, [0, 1, 2, 3, 4, 5]), ("affines_pre_smooth", 1, [6, 7, 8, 9, 10, 11])]


def test_ticker(spark):
    stages = spark.createDataFrame([("a", 0, 21, 10), ("b", 0, 11, None), ("c", 0, 5, 10)], "job string, s long, e long, eta long")
    reports = spark.createDataFrame([("a", 10, 0.3), ("a", 16, 1.0), ("b", 6, 0.2), ("b", 40, 0.9), ("a", 17, None)], "job string, at long, p double")
    got = sorted(tuple(r) for r in jobs.ticked(stages, reports, ("job",), "s", "e", "eta", "at", "p", 5).collect())
    assert got == [("a", 5, 0.5), ("a", 10, 0.3), ("a", 15, 0.3), ("a", 20, 0.99), ("b", 10, 0.2)]
    codes = spark.createDataFrame([("completed",), ("failed",), ("cancelled",), ("running",), (None,)], "s string").select(jobs.exit_code(F.col("s"))).collect()
    assert [r[0] for r in codes] == [0, 1, 3, 2, 2]
    assert [ev.tick_value(*x) for x in ((0.5, 9, 10), (None, 5, 10), (None, 50, 10), (1.0, 0, None), (None, 5, None), (None, 5, 0))] == [0.5, 0.5, 0.99, 0.99, None, None]


def test_ticks_of_a_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("real", 0, t, "stage_started", "lipsync", None, 60.0), ("real", 1, t, "stage_progress", "lipsync", 0.4, None), ("late", 0, t, "stage_started", "lipsync", None, 60.0), ("mute", 0, t, "stage_started", "lipsync", None, None), ("over", 0, t, "job_completed", None, 1.0, None)]
    schema = f"{ev.EVENTS}, eta_seconds double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ev.with_ticks(stream, 200).writeStream.outputMode("append").format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        assert ev.wait(q, 1) == 2
        for _ in range(60):
            got = {tuple(r) for r in spark.sql("select * from ticks").collect()}
            if len(got) == 2:
                break
            ev.wait(q, 1)
    finally:
        q.stop()
    assert got == {("real", 0.4), ("late", 0.99)} and ev.wait(q, 5) == 0


FORMS = [
    ("two hundred and twelve", "212"), ("ninety nine", "99"), ("seven thirty five", "735"), ("nineteen eighty four", "1984"), ("three point one four", "3.14"), ("two point five million", "2500000"),
    ("six hundred thousand dollars", "$600000"), ("$3 million", "$3000000"), ("one double o seven", "1007"), ("nineteen sixties", "1960s"), ("fifty second", "52nd"), ("the third of may", "the 3rd of may"),
    ("minus forty", "-40"), ("five dollars and five cents", "$5.05"), ("twelve and a half percent", "12.5%"), ("forty per cent", "40%"), ("one", "one"), ("ones", "ones"), ("one thousand", "1000"), ("won't", "will not"),
    ("Mr. O'Neil can't (laughs) come, um, [noise] today.", "mister 0 neil can not come today"), ("1,234,567 people", "1234567 people"), ("10 th", "10th"), ("café naïve", "cafe naive"), ("a. b", "a b"), ("50% of it", "50% of it"), ("a % b", "a b"), ("", ""), (None, None),
]


def test_english_forms(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)], "i int, t string")
    got = dict(df.select("i", english.english_normal(F.col("t"))).collect())
    assert [got[i] for i in range(len(FORMS))] == [want for _, want in FORMS]
    assert df.filter("i = 0").select(english.english_normal(F.lit("the colour"), {"colour": "color"})).first()[0] == "the color"


def test_number_words_in_a_row():
    read = english.numbers_as_digits
    assert read("nineteen twenty one") == "1921" and read("one twenty three") == "123" and read("one two three") == "123"
    assert read("three and a half million") == "3500000" and read("so and a half") == "so and a half" and read("and a half") == ""
    assert read("minus foo") == "minus foo" and read("two and two") == "2 and 2" and read("one point") == "one point" and read("b747") == "b 747"
    assert read("two and a half and a half") == "2.5" and read("a dog and a half") == "a dog and a half" and read("first and a half") == "1st and a half"
    assert read("zero dollars and seven cents") == "¢7" and read("$20 ¢3 and ¢4") == "$20.03 and ¢4" and read("two and a half dollars") == "$2.5" and read("half and a half") == "half and a half"
    assert read("2.5.3 point") == "2.5.3 point" and read("$20 and five cents") == "$20.05"
    assert read("0 seventy") == "70" and read("point twenty thousand") == "200" and read("twenty 0 nineteen") == "20 19"
    assert read("hundreds of three hundred and and") == "100s of 300 and" and read("minus double seven") == "-77" and read("per person five per cent") == "per person 5%"


@pytest.mark.parametrize("n", [0, 7, 13, 20, 21, 90, 100, 101, 110, 219, 999, 1_000, 1_001, 1_999, 20_020, 100_000, 123_456, 1_000_000, 7_000_005])
def test_cardinals_read_back(n):
    """A number spelled out by rule is read back as its digits, with `and` after hundreds or without."""

    def spelled(n, link):
        for scale, name in ((1_000_000, "million"), (1_000, "thousand"), (100, "hundred")):
            if n >= scale:
                rest = f" {link if scale == 100 else ''} {spelled(n % scale, link)}" if n % scale else ""
                return f"{spelled(n // scale, link)} {name}{rest}"
        return english.UNITS[n - 1] if n < 20 else english.TENS[n // 10 - 2] + (f" {english.UNITS[n % 10 - 1]}" if n % 10 else "")

    for link in ("and", ""):
        assert english.numbers_as_digits(spelled(n, link) if n else "zero") == str(n)


def plain_basic(t, diacritics, letters):
    import re
    import unicodedata

    import regex

    t = re.sub(r"\(([^)]+?)\)", "", re.sub(r"[<\[][^>\]]*[>\]]", "", t.lower()))
    out = []
    for c in unicodedata.normalize("NFKC" if diacritics else "NFKD", t):
        kind = unicodedata.category(c)
        if not diacritics and c in text.PLAIN_LETTERS:
            out.append(text.PLAIN_LETTERS[c])
        elif diacritics or kind != "Mn":
            out.append(" " if kind[0] in "MSP" else c)
    t = "".join(out).lower()
    return re.sub(r"\s+", " ", " ".join(regex.findall(r"\X", t)) if letters else t)


@pytest.mark.parametrize(("diacritics", "letters"), [(True, False), (False, False), (True, True), (False, True)])
def test_basic_forms(spark, diacritics, letters):
    """Whole texts of a table, and letters that change in compatibility or canonical form, against a plain loop."""
    odd = ["\u01ff \u01fd a\u2122 \u3385 \u2121", "line\u2028next\u00a0x\u3000y", "e\u0301 \ud55c\uae00 \u0e01\u0e33", "<b>x</b> [noise] (aside) ok", "\u00df \u1e9e \u0141\u00f3d\u017a", ""]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    df = docs.unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    got = df.select("text", text.basic_normal(F.col("text"), diacritics, letters).alias("n")).collect()
    assert [r.n for r in got] == [None if r.text is None else plain_basic(r.text, diacritics, letters) for r in got]

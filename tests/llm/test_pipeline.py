"""The pipeline's stages on edge rows, with columns of every helper's name, and against plain versions."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import exact_dedup, language, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SENTENCE = {
    "en": "the weather was fine and they walked along the river until the evening came",
    "de": "das Wetter war schön und sie gingen am Fluss entlang bis der Abend kam",
    "fr": "le temps était beau et ils marchaient le long de la rivière jusqu'au soir",
}
HELPERS = (
    "row", "size", "source_size", "target", "copies", "name", "_size", "_copies", "_copy", "_target", "_id", "_text", "_digest", "digest", "keep_id", "group_size", "named",
    "lead", "node", "sketch", "text_hash", "component", "token_ids", "lang_pred", "score", "c0", "c1", "held_out", "group", "hash", "nth", "fp",
)
BIG = 2**53 + 1


def edge_rows():
    rows = [(None, None, None, None, None), (BIG, "", "en", "a", None), (3, " \n", "en", None, BIG), (4, "123 %%", None, "b", 1)]
    for k, (lang, s) in enumerate(SENTENCE.items()):
        for i in range(12):
            rows.append((100 * k + i + 10, f"{s} {i} " + " ".join(f"{w}{i}" for w in s.split()), lang, "ab"[i % 2], i))
        rows += [(900 + k, s, lang, "a", 1), (950 + k, s, lang, "a", 2), (950 + k, s, lang, "a", 2)]
    return rows


def frame(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in HELPERS})


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_keep_columns_as_they_are(spark):
    docs = frame(spark, edge_rows())
    before = set(plain(docs))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "bpe":
            assert set(out.columns) == set(docs.columns)
            assert plain(out.select(*sorted(set(docs.columns) - {"token_ids"}))) == plain(docs.select(*sorted(set(docs.columns) - {"token_ids"})))
        else:
            assert out.columns == docs.columns and set(plain(out)) <= before
        assert stage(spark, docs.limit(0), "").count() == 0


def test_each_stage_against_a_plain_version(spark):
    rows = edge_rows()
    docs = frame(spark, rows)
    kept = {(r[0], r[1]) for r in plain(corpus_pipeline.language_id(spark, docs, "").select("doc_id", "text"))}
    assert {(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)} == kept
    last = {}
    for i, t, *_ in rows:
        t = t or ""
        if t not in last or (i is not None and (last[t] is None or i > last[t])):
            last[t] = i
    exact = plain(corpus_pipeline.exact(spark, docs, "").select("doc_id", "text"))
    assert {((t or ""), i) for i, t in exact} == set(last.items()) and len(exact) == len(last)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.encode(spark, docs, "").select("text", "token_ids").collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids


def test_run(spark, tmp_path):
    rows = edge_rows()
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    got = out.collect()
    known = {(i, t) for i, t, *_ in rows}
    assert got and {(r.doc_id, r.text) for r in got} <= known and not any(r.text in (None, "", " \n", "123 %%") for r in got)
    assert not any(r.doc_id in (900, 901, 902) for r in got)  # equal texts of a larger id stay
    assert plain(corpus_pipeline.run(spark, str(tmp_path))) == plain(out)
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_no_labels_keep_all_texts_with_letters(spark):
    docs = frame(spark, [(1, "some words", None, "a", 1), (2, "??", None, "a", 1), (3, None, None, "a", 1)])
    assert [r.doc_id for r in language.keep_identified(docs).collect()] == [1]


def test_rare_languages_are_learned(spark):
    rows = [(i, f"{SENTENCE['en']} {i}", "en", "a", 1) for i in range(3_000)] + [(i, f"{SENTENCE['fr']} {i}", "fr", "a", 1) for i in range(5_000, 5_004)]
    assert language.fit(spark.createDataFrame(rows, DOCS)).langs == ["en", "fr"]


@pytest.mark.parametrize("ids", [[None] + list(range(2_000)), [10**17] + list(range(2_000)), [7] * 2_001])
def test_history_is_a_share_of_the_rows(spark, ids, monkeypatch):
    """A null, an outlying or a much repeated doc_id leaves about half of the distinct ids in the history."""
    seen = []
    build = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "build_index", lambda history, shards: seen.append(history.count()) or build(history, shards))
    docs = spark.createDataFrame([(i, f"text {n % 1_500}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = {(r.text_sha256, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    groups = {}
    for n, i in enumerate(ids):
        groups.setdefault(f"text {n % 1_500}", []).append(i)
    want = {(hashlib.sha256(t.encode()).hexdigest(), max((i for i in own if i is not None), default=None), len(own)) for t, own in groups.items()}
    assert got == want
    assert seen[0] in (0, 2_001) if len(set(ids)) == 1 else 850 < seen[0] < 1_150


def test_least_id_is_no_null(spark):
    docs = spark.createDataFrame([(-(2**63), "one two three four"), (None, "five six seven eight"), (5, "one two three four")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {(-(2**63), 5), (None, None), (5, 5)}
    assert {(r.doc_id, r.component_id) for r in simhash.near_dedup(docs).collect()} == {(-(2**63), -(2**63)), (None, None), (5, -(2**63))}

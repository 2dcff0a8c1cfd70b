"""Fingerprints of unrelated texts stay apart whatever their doc_ids."""

import numpy as np

from cadenza.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10_000, 80)) for _ in range(24)]
    ids = [None] * 8 + [7] * 8 + list(range(100, 108))
    rows = [(i, t, "en", "a", 1) for i, t in zip(ids, texts)]
    rows += [(200 + k, texts[k], "en", "a", 1) for k in (0, 9, 20)]  # twins of a text without an id, of a repeated id, of a plain one
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == sorted(texts)
    got = simhash.near_dedup(docs).collect()
    components = {r.fingerprint: set() for r in got}
    for r in got:
        components[r.fingerprint].add(r.component_id)
    assert len(components) == len(texts) and all(len(c) == 1 for c in components.values())
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id == {7: 7, 200: 200, 209: 7, 220: 104, **{i: i for i in range(100, 108)}}
    assert sum(r.component_id is None for r in got) == 7  # no row of these components has an id

"""What one task or one worker holds: near pairs of a bucket, and tables of words after the last task that used them."""

import time
import tracemalloc

import numpy as np
import public_tokenizers

from cadenza.llm import bpe, simhash


def doubtful_bucket(n: int) -> np.ndarray:
    """Sketches of which all pairs are in doubt: each differs from one centre in about 40 bits."""
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.random((1, simhash.SKETCH)) < 0.5, n, axis=0) ^ (rng.random((n, simhash.SKETCH)) < 40 / simhash.SKETCH)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def test_near_pairs_of_a_bucket_are_not_held_at_once(monkeypatch):
    node, words = np.arange(900) * 7 % 907, doubtful_bucket(900)

    def linked() -> tuple[set, list]:
        left_open: list[np.ndarray] = []
        return set(zip(*map(np.ndarray.tolist, simhash.link_bucket(node, words, 45, 101, left_open)))), left_open[0].tolist()

    whole = linked()
    monkeypatch.setattr(simhash, "NEAR_PAIRS", 20_000, raising=False)
    tracemalloc.start()
    parts = linked()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts == whole and len(whole[1]) == 900
    assert peak < 20_000_000  # 810,000 pairs at once take more


def test_open_pairs_come_in_parts_and_once(monkeypatch):
    node, words, group = np.arange(120) * 7 % 127, doubtful_bucket(120), np.arange(120) % 4
    monkeypatch.setattr(simhash, "NEAR_PAIRS", 1_000, raising=False)
    parts = [list(zip(a.tolist(), b.tolist())) for a, b in simhash.open_pairs(node, words, group, 101)]
    far = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    x, y = np.nonzero((far <= 101) & (group[:, None] != group[None]))
    assert len(parts) > 5
    assert sorted(p for part in parts for p in part) == sorted({(min(a, b), max(a, b)) for a, b in zip(node[x].tolist(), node[y].tolist())})


def test_tables_of_words_go_when_no_task_follows(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.2)
    path = public_tokenizers.path("word_bpe_49k.json")
    for text in ("A plain text, twice: a plain text.", "café 中文 it's 42", "", " \n "):
        with bpe.lent(path) as own:
            assert own.encode_array(text).tolist() == own.encode(text)
    with bpe.lent(path) as own:
        own.encode_array("some words")
        time.sleep(0.5)
        assert own.word_ids and own.stretch_ids  # not while a task runs
    time.sleep(1)
    assert not (own.word_ids or own.stretch_ids or own.known or own.stretches)

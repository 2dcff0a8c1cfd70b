"""Language ID: a bidirectional gated recurrent network over bytes labels every position, a document pools them.

The network is trained in numpy by backpropagation through time on random windows of a bounded sample of labelled rows.
Whole texts are then cut into windows of WINDOW bytes; every byte gets label probabilities from both directions, and a
document's probabilities are the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_sample, positional, quoted, renamed
from .gru import GATES, Adam, Fast, backward, forward, init_direction

WINDOW = 64
UNITS = 8
#: Labelled rows of a language that the network is fitted on, those of the smallest hashes; languages, those of the most rows;
#: characters of a row's text, and of all rows together; windows drawn from each language.
SAMPLE_ROWS, LANGS, FIT_CHARS, ALL_CHARS = 600, 500, 20_000, 1 << 26
LANG_WINDOWS = 1_600
EPOCHS = 6
#: Windows in one pass, and bytes of text gathered before a pass.
PASS_ROWS = 8_192
SLAB = PASS_ROWS * WINDOW
PAD = 256
NONE = "und"
LETTER = regex.compile(r"\p{L}")


def held_out():
    """True where crc32 of the doc_id as text leaves 2 on division by 4."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]

    def direction(self, d: str) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        return {g: self.params[f"{d}E{g}"] for g in GATES}, {f"U{g}": self.params[f"{d}U{g}"] for g in GATES}


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit on windows drawn from whole texts, as many for each language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    rows, labels = [], []
    for k, name in enumerate(names):
        own = [t.encode() for t, lang in zip(texts, langs) if lang == name and t]
        if not own:
            continue
        for i in rng.integers(0, len(own), LANG_WINDOWS):
            a = int(rng.integers(0, max(1, len(own[i]) - WINDOW + 1)))
            piece = own[i][a : a + WINDOW]
            rows.append(np.frombuffer(piece.ljust(WINDOW, b"\0"), np.uint8).astype(np.int64) if len(piece) == WINDOW else np.r_[np.frombuffer(piece, np.uint8), np.full(WINDOW - len(piece), PAD)].astype(np.int64))
            labels.append(k)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p |= {f"{d}E{g}": (rng.normal(size=(PAD + 1, UNITS)) * 0.5).astype(np.float32) for g in GATES}
        p |= {f"{d}{k}": v for k, v in init_direction(rng, UNITS).items()}
        p[f"{d}V"] = (rng.normal(size=(UNITS, len(names))) * 0.3).astype(np.float32)
    p["c"] = np.zeros(len(names), np.float32)
    model = Model(names, p)
    if not rows:
        return model
    x, y, adam, size = np.stack(rows), np.array(labels), Adam(p, 0.02), 256
    steps = EPOCHS * -(-len(x) // size)
    done = 0
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(x)), -(-len(x) // size)):
            ids = x[pick].T
            mask = (ids != PAD).astype(np.float32)
            runs = {}
            logits = p["c"]
            for d in "fb":
                seen, m = (ids, mask) if d == "f" else (ids[::-1], mask[::-1])
                E, U = model.direction(d)
                out, tape = forward({g: E[g][seen] for g in GATES}, U, m, True)
                runs[d] = seen, out, tape, U
                logits = logits + (out if d == "f" else out[::-1]) @ p[f"{d}V"]
            e = np.exp(logits - logits.max(axis=-1, keepdims=True))
            prob = e / e.sum(axis=-1, keepdims=True)
            prob[:, np.arange(len(pick)), y[pick]] -= 1
            g_logits = prob * mask[:, :, None] / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            grads["c"] = g_logits.sum(axis=(0, 1))
            for d in "fb":
                seen, out, tape, U = runs[d]
                g = g_logits if d == "f" else g_logits[::-1]
                grads[f"{d}V"] = np.einsum("tnh,tnc->hc", out, g)
                gU, gI = backward(g @ p[f"{d}V"].T, tape, U)
                for k, v in gU.items():
                    grads[f"{d}{k}"] = v
                for k in GATES:
                    np.add.at(grads[f"{d}E{k}"], seen.ravel(), gI[k].reshape(-1, UNITS))
            adam.step(grads, 1 - 0.9 * done / steps)
            done += 1
    return model


class Scorer:
    """Labels every byte of many texts at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.net = {}
        for d in "fb":
            E, U = model.direction(d)
            tables = {g: E[g].copy() for g in GATES}
            tables["z"][PAD] = 1e6  # padding leaves the state
            self.net[d] = Fast(tables, U, PASS_ROWS)

    def window_sums(self, windows: np.ndarray) -> np.ndarray:
        """Sums over positions of the label probabilities of (rows, WINDOW) byte windows."""
        p, ids = self.model.params, np.ascontiguousarray(windows.T.astype(np.intp))
        n, langs = len(windows), len(self.model.langs)
        vf, vb, c = np.ascontiguousarray(p["fV"].T), np.ascontiguousarray(p["bV"].T), p["c"][:, None]
        total, ahead = np.zeros((langs, n), np.float32), np.empty((WINDOW, langs, n), np.float32)
        back, weight = np.empty((langs, n), np.float32), np.empty(n, np.float32)
        h = self.net["f"].start(n)
        for t in range(WINDOW):
            self.net["f"].step(ids[t], h)
            np.matmul(vf, h.T, out=ahead[t])
        h = self.net["b"].start(n)
        for t in range(WINDOW - 1, -1, -1):
            self.net["b"].step(ids[t], h)
            label = ahead[t]
            label += np.matmul(vb, h.T, out=back)
            label += c
            np.exp(label, out=label)
            np.divide(ids[t] != PAD, label.sum(axis=0), out=weight, casting="unsafe")
            label *= weight
            total += label
        return total.T

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean over all positions of each text; texts are not empty."""
        windows = [-(-len(t) // WINDOW) for t in texts]
        flat = np.full(sum(windows) * WINDOW, PAD, np.uint16)
        at = 0
        for t, w in zip(texts, windows):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += w * WINDOW
        flat = flat.reshape(-1, WINDOW)
        sums = np.concatenate([self.window_sums(flat[a : a + PASS_ROWS]) for a in range(0, len(flat), PASS_ROWS)])
        starts = np.cumsum([0, *windows[:-1]])
        return np.add.reduceat(sums.astype(np.float64), starts, axis=0) / np.array([len(t) for t in texts])[:, None]


def fit(docs: DataFrame) -> Model:
    """A model from labelled rows that are not held out: at most SAMPLE_ROWS of each of the LANGS most frequent labels.

    Of a text over FIT_CHARS characters a stretch of that length, from a place given by its hash, is learned; with so many rows that
    they could pass ALL_CHARS, of shorter stretches.
    """
    digest = F.xxhash64("text")
    known = docs.select("doc_id", "lang", "text", digest.alias("digest")).filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = hash_sample(known, ["doc_id", "digest"], SAMPLE_ROWS, "lang", LANGS)  # ids, not texts
    picked = cut(picked.toDF("of", "id", "learned"))
    chars = max(WINDOW, min(FIT_CHARS, ALL_CHARS // max(1, picked.count())))
    at = 1 + F.pmod(F.col("digest"), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int")
    found = known.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")) & (F.col("digest") == F.col("learned")))
    pieces = found.select("id", "of", "learned", F.substring("text", at, F.lit(chars)).alias("text"))
    rows = pieces.dropDuplicates(["id", "of", "learned"]).orderBy("id", "of", "learned").collect()  # bounded by the sample
    return train([r.text for r in rows], [r.of for r in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` plus lang_pred and score; its own columns pass through as they are."""
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            pred, score = [NONE] * len(texts), [0.0] * len(texts)
            slab, where, size = [], [], 0

            def flush() -> None:
                if slab:
                    prob = scorer.probabilities(slab)
                    for i, k in zip(where, prob.argmax(axis=1)):
                        pred[i] = model.langs[k]
                    for i, s in zip(where, prob.max(axis=1)):
                        score[i] = float(min(1.0, s))
                    slab.clear(), where.clear()

            for i, t in enumerate(texts):
                if model.langs and t is not None and LETTER.search(t):
                    slab.append(t.encode())
                    where.append(i)
                    size += len(slab[-1])
                    if size >= SLAB:
                        flush()
                        size = 0
            flush()
            yield batch.append_column("lang_pred", pa.array(pred)).append_column("score", pa.array(score))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Text that is null or has no letter gets `und` and score 0, and so does every text when no row has a label to learn
    from. Rows that repeat get the same prediction. Other columns are ignored.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(marked, fit(docs)).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, whose language is identified with at least that score.

    Null text and text without a letter go. Where no row has a label to learn from, all texts with a letter stay.
    """
    model = fit(docs)
    if not model.langs:
        return docs.filter(quoted("text").rlike(r"\p{L}"))
    scored = predict(positional(docs), model, f"c{docs.columns.index('text')}")
    return renamed(scored.filter((F.col("lang_pred") != NONE) & (F.col("score") >= least)), docs.columns)

"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as a vector of its hash bucket and as the end states of a gated network run over its characters both ways.
A bidirectional network over words runs through stretches of STRETCH words, which overlap so that every window of WORDS words in a row
lies in one; attention weighs the positions of each window, whichever word it starts at, and a document's score is that of its
worst window. All parts are trained together in numpy by backpropagation, on windows of a bounded sample of labelled rows: first
every window carries its document's label, then only the windows that the network itself finds worst.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample
from .gru import GATES, Adam, Fast, backward, ends_backward, ends_forward, forward, init_direction
from .language import held_out

#: Words of a window and of a stretch; HOP windows start in a stretch, one at each word.
WORDS, STRETCH = 16, 32
HOP = STRETCH - WORDS + 1
UNITS, CHAR_UNITS, CHAR_DIM, BUCKETS = 12, 12, 8, 4_096
#: Letters of a word that the character network reads at a time; a longer run of letters is several words.
LETTERS = 20
#: Labelled rows of each class that the network is fitted on, those of the smallest hashes, and characters of a row's text.
SAMPLE_TOXIC, SAMPLE_CLEAN, FIT_CHARS = 700, 1_100, 60_000
#: Windows in a training step, steps of the phases, windows in a pass, words that a task remembers.
BATCH, FIRST_STEPS, SECOND_STEPS, LAST_STEPS = 128, 250, 500, 100
PASS_ROWS = 4_096
KNOWN_WORDS = 120_000
#: What a missed toxic text costs in calibration, in false alarms. This and the steps were chosen by folds of rows that are not held out.
MISS_COST = 3.0
#: The score at the cut between the classes.
CUT_SCORE = 0.3
CHARS = 512
TOKEN = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if isinstance(text, str) else []


def bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


def scatter(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by id."""
    return np.stack([np.bincount(ids, v, n) for v in values.T], axis=1).astype(np.float32)


def char_ids(words: list[str]) -> np.ndarray:
    """(letters, words) character ids, 0 after a word's end."""
    wide = max(map(len, words), default=1)
    codes = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.ascontiguousarray(np.where(codes > 0, 1 + codes % (CHARS - 1), 0).reshape(-1, wide).T)


def window_count(n: int) -> int:
    """Windows of n words: one starts at every word that has a whole window before it ends; a shorter text is one, no words are none."""
    return max(1, n - WORDS + 1) if n else 0


def stretches_of(n: int) -> np.ndarray:
    """(stretches, STRETCH) positions over n words, -1 after the end: window w lies in stretch w // HOP, from its word w % HOP on."""
    starts = np.arange(0, window_count(n), HOP)
    at = starts[:, None] + np.arange(STRETCH)
    return np.where(at < n, at, -1)


def window_in(words: list[str], w: int) -> tuple[list[str], int, int]:
    """The stretch of window w, and where in it the window starts and ends."""
    first, at = w // HOP * HOP, w % HOP
    return words[first : first + STRETCH], at, min(at + WORDS, len(words) - first)


@dataclass
class Model:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0

    def letters(self, d: str) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gate inputs of each character, and the recurrent weights, of one direction."""
        return {g: self.p["char"] @ self.p[f"c{d}W{g}"] for g in GATES}, {f"U{g}": self.p[f"c{d}U{g}"] for g in GATES}

    def chars(self, words: list[str]):
        """Gate inputs (words, UNITS) of both word directions, by name, and what backpropagation needs.

        The words come longest first.
        """
        p, ends, tapes = self.p, [], {}
        active = [sum(len(w) > t for w in words) for t in range(len(words[0]))]
        for d in "fb":
            ids = char_ids(words if d == "f" else [w[::-1] for w in words])
            tables, U = self.letters(d)
            end, tape = ends_forward(tables, U, ids, active)
            ends.append(end)
            tapes[d] = ids, tape, U
        buckets = np.array([bucket(w) for w in words], np.int64)
        feature = np.concatenate([*ends, p["word"][buckets]], axis=1)
        gates = {f"{d}{g}": feature @ p[f"w{d}W{g}"] + p[f"w{d}b{g}"] for d in "fb" for g in GATES}
        return gates, (feature, buckets, active, tapes)


def init(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    norm = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    p = {"char": norm(CHARS, CHAR_DIM, scale=0.5), "word": norm(BUCKETS, CHAR_DIM, scale=0.1)}
    for d in "fb":
        p |= {f"c{d}W{g}": norm(CHAR_DIM, CHAR_UNITS, scale=0.4) for g in GATES} | {f"c{d}{k}": v for k, v in init_direction(rng, CHAR_UNITS).items()}
        p |= {f"w{d}W{g}": norm(2 * CHAR_UNITS + CHAR_DIM, UNITS, scale=0.3) for g in GATES} | {f"w{d}b{g}": np.zeros(UNITS, np.float32) for g in GATES}
        p |= {f"w{d}{k}": v for k, v in init_direction(rng, UNITS).items()}
    p |= {"A": norm(2 * UNITS, UNITS, scale=0.3), "a": norm(UNITS, scale=0.5), "v": norm(2 * UNITS, scale=0.3), "c": np.zeros(1, np.float32)}
    return Model(p)


def _attend(p: dict[str, np.ndarray], h: np.ndarray, mask: np.ndarray):
    """Window logits from states (steps, rows, 2 * UNITS): attention over the steps, then one linear unit."""
    t = np.clip(h @ p["A"], -1, 1)
    e = np.where(mask > 0, t @ p["a"], np.float32(-1e9))
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.zeros_like(h[0])
    for own, state in zip(w, h):
        pooled += own[:, None] * state
    return pooled @ p["v"] + p["c"][0], (t, w, pooled)


def gradients(model: Model, windows: list[tuple[list[str], int, int]], y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean logistic loss of windows, each a stretch's words and its bounds in it, and the loss."""
    p = model.p
    vocab = sorted({w for x, _, _ in windows for w in x}, key=lambda w: (-len(w), w))
    number = {w: i for i, w in enumerate(vocab)}
    ids, own = np.full((STRETCH, len(windows)), -1, np.int64), np.zeros((STRETCH, len(windows)), np.float32)
    for r, (x, start, end) in enumerate(windows):
        ids[: len(x), r] = [number[w] for w in x]
        own[start:end, r] = 1
    mask = (ids >= 0).astype(np.float32)
    gates, (feature, buckets, active, tapes) = model.chars(vocab)
    runs, states = {}, []
    for d in "fb":
        seen, m = (ids, mask) if d == "f" else (ids[::-1], mask[::-1])
        out, tape = forward({g: gates[f"{d}{g}"][seen] for g in GATES}, {f"U{g}": p[f"w{d}U{g}"] for g in GATES}, m, True)
        runs[d] = seen, tape
        states.append(out if d == "f" else out[::-1])
    h = np.concatenate(states, axis=2)
    logit, (t, w, pooled) = _attend(p, h, own)
    dl = ((1 / (1 + np.exp(-logit))) - y).astype(np.float32) / len(y)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["v"], grads["c"][0] = pooled.T @ dl, dl.sum()
    dpool = dl[:, None] * p["v"]
    dh = w[:, :, None] * dpool
    dw = np.einsum("trh,rh->tr", h, dpool)
    de = w * (dw - (w * dw).sum(axis=0))
    grads["a"] = np.einsum("trh,tr->h", t, de)
    dt = de[:, :, None] * p["a"] * (np.abs(t) < 1)
    grads["A"] = h.reshape(-1, 2 * UNITS).T @ dt.reshape(-1, UNITS)
    dh = dh + dt @ p["A"].T
    dfeature = np.zeros_like(feature)
    for k, d in enumerate("fb"):
        seen, tape = runs[d]
        side = dh[:, :, k * UNITS : (k + 1) * UNITS]
        gU, gI = backward(side if d == "f" else side[::-1], tape, {f"U{g}": p[f"w{d}U{g}"] for g in GATES})
        for name, v in gU.items():
            grads[f"w{d}{name}"] = v
        at = np.where(seen < 0, len(vocab), seen).ravel()
        for g in GATES:
            per_word = scatter(at, gI[g].reshape(-1, UNITS), len(vocab) + 1)[:-1]
            grads[f"w{d}b{g}"] = per_word.sum(axis=0)
            grads[f"w{d}W{g}"] = feature.T @ per_word
            dfeature += per_word @ p[f"w{d}W{g}"].T
    grads["word"] = scatter(buckets, dfeature[:, 2 * CHAR_UNITS :] , BUCKETS)
    for k, d in enumerate("fb"):
        char, tape, U = tapes[d]
        gU, gI = ends_backward(dfeature[:, k * CHAR_UNITS : (k + 1) * CHAR_UNITS], tape, U)
        for name, v in gU.items():
            grads[f"c{d}{name}"] = v
        seen = np.concatenate([char[t, :n] for t, n in enumerate(active)])
        for g in GATES:
            per_char = scatter(seen, np.concatenate(gI[g]), CHARS)
            grads[f"c{d}W{g}"] = p["char"].T @ per_char
            grads["char"] += per_char @ p[f"c{d}W{g}"].T
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    return grads, loss


class Scorer:
    """Scores all windows of many texts at once; a table of known words holds their gate inputs."""

    def __init__(self, model: Model) -> None:
        self.model, p = model, model.p
        self.tables = {f"{d}{g}": np.zeros((KNOWN_WORDS + 1, UNITS), np.float32) for d in "fb" for g in GATES}
        scale = {"r": (0.25, 0.5), "z": (0.25, 0.5), "n": (1.0, 0.0)}
        self.scale = scale
        self.known: dict[str, int] = {}
        self.net = {}
        for d in "fb":
            self.net[d] = Fast({g: np.zeros((1, UNITS), np.float32) for g in GATES}, {f"U{g}": p[f"w{d}U{g}"] for g in GATES}, PASS_ROWS)
            self.net[d].tables = {g: self.tables[f"{d}{g}"] for g in GATES}
            self.tables[f"{d}z"][KNOWN_WORDS] = 1e6  # padding leaves the state
        self.letters = {}
        for d in "fb":
            tables, U = model.letters(d)
            tables["z"][0] = 1e6
            self.letters[d] = Fast(tables, U, 8_192)

    def _gates(self, words: list[str]) -> dict[str, np.ndarray]:
        """What Model.chars gives, without what training needs."""
        p, ends = self.model.p, []
        for d in "fb":
            state = self.letters[d].start(len(words))
            for row in char_ids(words if d == "f" else [w[::-1] for w in words]):
                self.letters[d].step(row, state)
            ends.append(state)
        feature = np.concatenate([*ends, p["word"][np.fromiter(map(bucket, words), np.int64, len(words))]], axis=1)
        return {f"{d}{g}": feature @ p[f"w{d}W{g}"] + p[f"w{d}b{g}"] for d in "fb" for g in GATES}

    def _learn(self, words: set[str]) -> None:
        new = sorted(words - self.known.keys(), key=len)  # of like length, so little padding
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = sorted(words, key=len)
        for a in range(0, len(new), 8_192):
            part = new[a : a + 8_192]
            gates = self._gates(part)
            rows = np.arange(len(self.known), len(self.known) + len(part))
            for k, v in gates.items():
                m, b = self.scale[k[1]]
                self.tables[k][rows] = v * m + b
            self.known.update(zip(part, rows.tolist()))

    def logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The logit of every window of each word list."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):  # as many texts as the table of words is sure to hold
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= KNOWN_WORDS):
                size += len(texts[stop])
                stop += 1
            out += self._some(texts[start:stop])
            start = stop
        return out

    def _some(self, texts: list[list[str]]) -> list[np.ndarray]:
        counts = [window_count(len(t)) for t in texts]
        rows = []
        for t in texts:
            pieces = range(0, len(t), KNOWN_WORDS) if len(t) > KNOWN_WORDS else (0,)
            if len(pieces) > 1:  # longer than the table: scored piece by piece, each with the overlap of a window
                rows.append(None)
                continue
            rows.append(t)
        flat, at = [], []
        base = 0
        self._learn({w for t in rows if t is not None for w in t})
        get = self.known.__getitem__
        for t in rows:
            if t is None:
                at.append(None)
                continue
            flat.append(np.fromiter(map(get, t), np.intp, len(t)))
            w = stretches_of(len(t))
            at.append(np.where(w < 0, -1, w + base))
            base += len(t)
        words = np.r_[np.concatenate(flat) if flat else np.zeros(0, np.intp), KNOWN_WORDS]
        ids = np.concatenate([a for a in at if a is not None] or [np.zeros((0, STRETCH), np.int64)])
        got = np.concatenate([self._pass(words[ids[a : a + PASS_ROWS]]) for a in range(0, len(ids), PASS_ROWS)] or [np.zeros((0, HOP))])
        out, k = [], 0
        for t, a, n in zip(texts, at, counts):
            if a is None:
                step = (KNOWN_WORDS - STRETCH) // HOP * HOP
                out.append(np.concatenate([self._some([t[i : i + step + WORDS - 1]])[0][:step] for i in range(0, n, step)]))
            else:
                out.append(got[k : k + len(a)].ravel()[:n])
                k += len(a)
        return out

    def _pass(self, ids: np.ndarray) -> np.ndarray:
        """The logits (stretches, HOP) of the windows that start in each stretch; those over a text's end are of no use."""
        p, n = self.model.p, len(ids)
        ids = np.ascontiguousarray(ids.T)
        h = np.empty((STRETCH, n, 2 * UNITS), np.float32)
        for d, steps in (("f", range(STRETCH)), ("b", range(STRETCH - 1, -1, -1))):
            state = self.net[d].start(n)
            half = slice(0, UNITS) if d == "f" else slice(UNITS, 2 * UNITS)
            for t in steps:
                self.net[d].step(ids[t], state)
                h[t, :, half] = state
        flat = h.reshape(-1, 2 * UNITS)
        e = (np.clip(flat @ p["A"], -1, 1) @ p["a"]).reshape(STRETCH, n).astype(np.float64)
        e[ids == KNOWN_WORDS] = -np.inf
        weight = np.exp(e - e.max(axis=0))
        worth = weight * (flat @ p["v"]).reshape(STRETCH, n)
        return (self._sums(worth) / np.maximum(self._sums(weight), 1e-300) + p["c"][0]).T

    @staticmethod
    def _sums(x: np.ndarray) -> np.ndarray:
        """(HOP, n) sums over WORDS steps in a row from each of the first HOP, by doubling; WORDS is a power of two."""
        width = 1
        while width < WORDS:
            x = x[:-width] + x[width:]
            width *= 2
        return x


def train(texts: list[str], toxic: list[int], rate: float = 0.5, seed: int = 11) -> Model:
    """Fit on four of five texts and calibrate on the fifth, for a corpus of which a share of `rate` is toxic."""
    rng, model = np.random.default_rng(seed), init(seed)
    docs = [(words_of(t), y) for t, y in zip(texts, toxic)]
    docs = [(w, y) for w, y in docs if w]
    sides = [[w for w, y in docs if y == k] for k in (0, 1)]
    if not all(sides):
        return Model(model.p, 0.0, -4.0 if not sides[1] else 4.0)
    adam = Adam(model.p, 0.01)
    few = min(map(len, sides)) < 50
    everything = sides
    aside = [side if few else side[::5] for side in sides]
    sides = [side if few else [w for i, w in enumerate(side) if i % 5] for side in sides]

    def windows(side: list[list[str]], n: int, worst: list[np.ndarray] | None) -> list[tuple[list[str], int, int]]:
        out = []
        for i in rng.integers(0, len(side), n):
            count = window_count(len(side[i]))
            k = int(rng.integers(0, count)) if worst is None else int(worst[i][rng.integers(0, len(worst[i]))])
            out.append(window_in(side[i], k))
        return out

    def worst_of(side: list[list[str]], share: float) -> list[np.ndarray]:
        return [np.argsort(-x)[: max(1, int(len(x) * share))] for x in Scorer(model).logits(side)]

    half, total = BATCH // 2, FIRST_STEPS + SECOND_STEPS

    def run(steps: range, rate_of) -> None:
        worst = clean = None
        for step in steps:
            if step >= FIRST_STEPS and (worst is None or (step - FIRST_STEPS) % 70 == 0):
                worst, clean = worst_of(sides[1], 0.02), worst_of(sides[0], 0.02)
            positive = windows(sides[1], half, worst)
            negative = windows(sides[0], half // 2, None) + windows(sides[0], half - half // 2, clean)
            grads, _ = gradients(model, positive + negative, np.r_[np.ones(half), np.zeros(half)])
            adam.step(grads, rate_of(step))

    run(range(total), lambda step: 1 - 0.9 * step / total)
    x = np.concatenate([[s.max() for s in Scorer(model).logits(side)] for side in aside])
    y = np.r_[np.zeros(len(aside[0])), np.ones(len(aside[1]))]
    model.slope, model.offset = calibrate(x, y, np.where(y > 0, MISS_COST * rate / max(1, len(aside[1])), (1 - rate) / len(aside[0])))
    sides = everything  # the texts set aside for the cut are learned last
    run(range(total, total + LAST_STEPS), lambda step: 0.2)
    return model


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that give CUT_SCORE to the logit at which cutting document labels costs least.

    Cost counts labels on the wrong side by weight, so a label that no logit explains pulls no further than any other. Of cuts
    whose costs are within a hundredth of all weight of the least, the middle is taken; the slope is that of the network.
    """
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], weight[order] / weight.sum()
    cost = np.r_[0.0, np.cumsum(w * (y > 0))] + np.r_[np.cumsum((w * (y == 0))[::-1])[::-1], 0.0]  # cut before row k
    cuts = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    good = cuts[cost <= cost.min() + 0.01]
    return 1.0, float(np.log(CUT_SCORE / (1 - CUT_SCORE)) - (good.min() + good.max()) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents that are not held out.

    Of rows that repeat a doc_id the smallest text is learned, so the sample stays bounded however often one repeats; of a text
    over FIT_CHARS characters a stretch of that length, from a place given by its hash.
    """
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    toxic, whole = known.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    picked = hash_sample(known.filter("toxic = 1"), ["doc_id"], SAMPLE_TOXIC).withColumn("toxic", F.lit(1)).unionByName(hash_sample(known.filter("toxic = 0"), ["doc_id"], SAMPLE_CLEAN).withColumn("toxic", F.lit(0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    at = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - FIT_CHARS + 1)).cast("int")
    rows = rows.withColumn("text", F.substring("text", at, F.lit(FIT_CHARS))).orderBy("doc_id").collect()  # bounded by the sample sizes
    return train([r.text for r in rows], [int(r.toxic) for r in rows], toxic / whole if whole else 0.5)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows of every row: the score of the worst of all its windows.

    Null and empty texts, and texts without a letter, have no window and score 0. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            logits, part, size = [], [], 0
            for t in batch.column("text").to_pylist():
                part.append(words_of(t))
                size += len(part[-1])
                if size >= KNOWN_WORDS // 2:
                    logits += [(x.max(initial=-np.inf), len(x)) for x in scorer.logits(part)]
                    part, size = [], 0
            logits += [(x.max(initial=-np.inf), len(x)) for x in scorer.logits(part)]
            worst = np.array([x for x, _ in logits], np.float64)
            some = np.isfinite(worst)
            value = np.where(some, 1 / (1 + np.exp(-np.clip(model.slope * np.where(some, worst, 0) + model.offset, -30, 30))), 0.0)
            done = [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array([n for _, n in logits], pa.int64())]
            yield pa.RecordBatch.from_arrays(done, ["doc_id", "held_out", "score", "predicted", "n_windows"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_windows long")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels), threshold)

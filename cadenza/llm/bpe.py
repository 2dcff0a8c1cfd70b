"""Byte-pair encoding with word ends, and decoding, over a contiguous array of part boundaries and ranks per word.

A word's parts are held as boundaries in one array with the rank of each adjacent pair beside them. The array is scanned
for the minimum, that boundary is deleted, and the two neighbouring ranks are refreshed, until no pair has a rank.
Words are short, so the scans are cheap; what a task has learned about a word is kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import positional, quoted, renamed

#: Entries in a table of words, or of stretches of words without a space; a task holds two tables of each, which bounds its memory.
KNOWN_WORDS = 200_000
#: Rows that are encoded before they are handed on: bounds the ids that a task holds besides those of one text.
CHUNK_ROWS = 256
#: Seconds after a task's end at which a worker that has got no other one empties its tables.
IDLE_SECONDS = 3.0
#: A longer one is not remembered.
KNOWN_CHARS = 64
NO_RANK = 1 << 60
#: Words or stretches of a text whose ids are joined and hashed at once.
HASH_WORDS = 4_096
#: Ranks in a block of a long word's array, or their number's root if that is more: the minimum is sought in the blocks' minima, then in one block.
BLOCK = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    moved = {b: chr(0x100 + n) for n, b in enumerate(rest)}
    return [moved.get(b, chr(b)) for b in range(256)]


#: Of a word or a stretch of words: number of tokens, ids as text, decoded text.
Entry = tuple[int, str, str]


class Known[T](dict[str, T]):
    """Entries, learned when first asked for; long keys are not kept.

    A full table becomes the one before it, from which keys still asked for are taken over, so rare ones go first.
    """

    def __init__(self, learn: Callable[[str], T]) -> None:
        self.learn, self.before = learn, {}

    def __missing__(self, key: str) -> T:
        entry = self.before.get(key) or self.learn(key)
        if len(key) <= KNOWN_CHARS:
            if len(self) >= KNOWN_WORDS:
                self.before = dict(self)
                self.clear()
            self[key] = entry
        return entry

    def forget(self) -> None:
        self.clear()
        self.before = {}


class WordBpe:
    """The tokenizer of a vocabulary file with lower case, dropped white space and word ends."""

    END = "</w>"

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.vocab = vocab
        self.pieces = {i: p for p, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: p for p, i in self.special.items()}
        self.symbols = byte_symbols()
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        # The vocabulary's own splitting pattern.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # Beyond Latin, normal forms and letter classes are taken from the library, so that Unicode versions agree.
        self.beyond = regex.compile(r"[^\x00-\u024f]")
        self.forms = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(self.words.pattern), "removed", invert=True)
        self.known, self.stretches = Known(self._learn_word), Known(self._learn_stretch)
        # For columns of ids, only these are kept, four bytes each.
        self.special_ids = {s: np.int32(i).tobytes() for s, i in self.special.items()}
        self.word_ids, self.stretch_ids = Known(lambda word: np.array(self.merge(word), np.int32).tobytes()), Known(lambda stretch: b"".join(map(self.word_ids.__getitem__, self.words.findall(stretch))))
        self.idle: threading.Timer | None = None

    def merge(self, word: str) -> list[int]:
        """Ids of one word, by the rank array."""
        text = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
        parts, bounds = [*text[:-1], text[-1] + self.END], [*range(len(text)), len(text) + len(self.END)]
        text, rank = text + self.END, self.ranks.get
        pair = [rank(p, NO_RANK) for p in zip(parts, parts[1:])]
        if len(pair) > 4 * BLOCK:
            return self._merge_long(text, bounds, pair)
        while pair:
            low = min(pair)
            if low == NO_RANK:
                break
            i = pair.index(low)
            del bounds[i + 1]
            del pair[i]
            a, b = bounds[i], bounds[i + 1]
            part = text[a:b]
            if i < len(pair):
                pair[i] = rank((part, text[b : bounds[i + 2]]), NO_RANK)
            if i:
                pair[i - 1] = rank((text[bounds[i - 1] : a], part), NO_RANK)
        return [self.vocab[text[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, text: str, bounds: list[int], pair: list[int]) -> list[int]:
        """The same for a long word: the array in blocks of boundaries and ranks, each with its least rank.

        A block holds the starts of its parts and the rank of each with the part after it, which may lie in a later block.
        """
        ranks, end, size = self.ranks, bounds[-1], max(BLOCK, isqrt(len(pair)))
        starts = [bounds[a : min(a + size, len(bounds) - 1)] for a in range(0, len(bounds) - 1, size)]
        pair = [*pair, NO_RANK]
        held = [pair[a : a + size] for a in range(0, len(pair), size)]
        least = [min(h) for h in held]
        after, before = list(range(1, len(starts) + 1)), list(range(-1, len(starts) - 1))  # neighbouring blocks that are not empty

        def start_of(block: int, i: int, step: int) -> int:
            """The start `step` parts after part i of a block; the end of the word after its last."""
            i += step
            while block < len(starts) and i >= len(starts[block]):
                i -= len(starts[block])
                block = after[block]
            return starts[block][i] if block < len(starts) else end

        def refresh(block: int, i: int) -> None:
            a, b = starts[block][i], start_of(block, i, 1)
            held[block][i] = ranks.get((text[a:b], text[b : start_of(block, i, 2)]), NO_RANK) if b < end else NO_RANK
            least[block] = min(held[block])

        while (low := min(least)) != NO_RANK:
            block = least.index(low)
            i = held[block].index(low)
            gone, at = (block, i + 1) if i + 1 < len(starts[block]) else (after[block], 0)
            del starts[gone][at], held[gone][at]
            if starts[gone]:
                least[gone] = min(held[gone])
            else:
                least[gone] = NO_RANK
                after[before[gone]] = after[gone]
                if after[gone] < len(starts):
                    before[after[gone]] = before[gone]
            refresh(block, i)
            if i:
                refresh(block, i - 1)
            elif before[block] >= 0:
                refresh(before[block], len(starts[before[block]]) - 1)
        flat = [a for block in starts for a in block]
        return [self.vocab[text[a:b]] for a, b in zip(flat, [*flat[1:], end])]

    def split(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if self.beyond.search(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.forms.normalize_str(text))]
        return self.words.findall(text.lower())

    def _learn_word(self, word: str) -> Entry:
        ids = self.merge(word)
        return len(ids), " ".join(map(str, ids)), self.decode_ids(ids)

    def _learn_stretch(self, stretch: str) -> Entry:
        entries = list(map(self.known.__getitem__, self.words.findall(stretch)))
        return entries[0] if len(entries) == 1 else (sum(e[0] for e in entries), " ".join(e[1] for e in entries), " ".join(e[2] for e in entries))

    def blocks(self, text: str) -> Iterator[list[Entry]]:
        """The entries of `text` in order, in lists of up to `HASH_WORDS`; none is without tokens.

        No word holds a space, so what stands between two of them is split alike wherever it occurs, and its entry is
        looked up whole; texts beyond Latin go word by word.
        """
        for kind, units in self.spans(text):
            if kind == "special":
                yield [(1, str(self.special[s]), self.decode_ids([self.special[s]])) for s in units]
                continue
            known = self.known if kind == "words" else self.stretches
            for a in range(0, len(units), HASH_WORDS):
                if some := [e for e in map(known.__getitem__, units[a : a + HASH_WORDS]) if e[0]]:
                    yield some

    def spans(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """The parts of `text` in order: a special token, or words, or stretches between spaces."""
        for k, piece in enumerate(self.split_special.split(text)):
            if k % 2:
                yield "special", [piece]
            elif self.beyond.search(piece):
                yield "words", self.split(piece)
            else:
                yield "stretches", piece.lower().replace("\n", " ").split(" ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for some in self.blocks(text) for _, ids, _ in some for i in ids.split()]

    def encode_array(self, text: str) -> np.ndarray:
        """The ids as a compact array, for columns of them."""
        tables = {"special": self.special_ids, "words": self.word_ids, "stretches": self.stretch_ids}
        return np.frombuffer(b"".join(ids for kind, units in self.spans(text) for ids in map(tables[kind].__getitem__, units)), np.int32)

    def forget(self) -> None:
        for table in (self.known, self.stretches, self.word_ids, self.stretch_ids):
            table.forget()

    def decode_ids(self, ids: list[int]) -> str:
        """The pieces of ids, as the file's missing decoder leaves them: joined by spaces."""
        return " ".join(self.pieces[i] for i in ids if i in self.pieces)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


@contextmanager
def lent(path: str) -> Iterator[WordBpe]:
    """The worker's tokenizer for one task. If no other task follows soon, its tables are emptied: a worker lives on in later stages."""
    bpe = tokenizer(path)
    if bpe.idle:
        bpe.idle.cancel()
    try:
        yield bpe
    finally:
        bpe.idle = threading.Timer(IDLE_SECONDS, bpe.forget)
        bpe.idle.daemon = True
        bpe.idle.start()


def encode_column(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` plus token_ids array<int> of each whole text, in place of a column of that name; null text has no tokens.

    All other columns pass through as they are, whatever their names and types.
    """
    kept = [c for c in docs.columns if c != "token_ids" or c == text]
    rows = positional(docs.select(*map(quoted, kept)))
    source = f"c{kept.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(path) as bpe:
            for whole in batches:
                for a in range(0, whole.num_rows, CHUNK_ROWS):
                    part = whole.slice(a, CHUNK_ROWS)
                    ids = [bpe.encode_array(t) if t is not None else np.zeros(0, np.int32) for t in part.column(source).to_pylist()]
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    yield part.append_column("token_ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))

    schema = rows.select("*", F.array().cast("array<int>").alias("token_ids")).schema
    return renamed(rows.mapInArrow(run, schema), kept, "token_ids")


def decode_column(docs: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """`docs` plus decoded string of each array of ids."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series(["" if v is None else bpe.decode_ids(list(v)) for v in column])

    return docs.withColumn("decoded", decoded(ids))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text (null: empty); other columns are ignored.

    Ids and decoded text are hashed as they are made; no list of all of them is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(path) as bpe:
            for batch in batches:
                counts, ids_sha, words_sha = [], [], []
                for text in batch.column("text").to_pylist():
                    n, ids, words = 0, hashlib.sha256(), hashlib.sha256()
                    for some in bpe.blocks(text) if text is not None else ():
                        c, i, w = zip(*some, strict=True)
                        gap = b" " if n else b""
                        n += sum(c)
                        ids.update(gap + " ".join(i).encode())
                        words.update(gap + " ".join(w).encode())
                    counts.append(n)
                    ids_sha.append(ids.hexdigest())
                    words_sha.append(words.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(words_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Chat formatting of typed content parts.

A visitor walks the parts of a message in order. Text becomes escaped text; an image, audio or document part becomes an
ordered placeholder, and its reference and the tokens it will expand to are recorded. A turn is

    <|turn ROLE|>BODY<|end|>\\n

and inside ROLE and BODY a backslash precedes every `\\`, `<` and `|`, so no text can contain a control string and taking
one backslash away from each pair gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a part of a kind stands for: a base, and so many for each unit of its size.
EXPANSION = {"image": (1, 0.25), "audio": (1, 50.0), "document": (2, 1.0)}
LOSS_ROLE = "assistant"

PART = "struct<type:string,text:string,ref:string,units:double>"
TURNS = "conv_id long, turn long, role string, formatted string, loss_from int, loss_to int, attachments array<struct<slot:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"


class Flatten:
    """Visits the parts of one message; `body`, `attachments` and `expanded` are what it has gathered."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []
        self.expanded = 0

    def visit(self, part) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part) -> None:
        self.body.append(escape(part["text"] or ""))

    def _attach(self, part) -> None:
        base, rate = EXPANSION[part["type"]]
        units = part["units"]
        tokens = base + int(rate * units) if units is not None and units == units and units > 0 else base
        slot = len(self.attachments)
        self.attachments.append((slot, part["type"], part["ref"], tokens))
        self.expanded += tokens
        self.body.append(f"<|{part['type']} {slot}|>")

    visit_image = visit_audio = visit_document = _attach

    def visit_unknown(self, part) -> None:
        self.visit_text({"text": part["text"]})


def escape(text: str) -> str:
    return re.sub(r"[\\<|]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_TURN = re.compile(r"<\|turn ((?:\\.|[^\\<|])*)\|>(.*)<\|end\|>\n", re.S)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders stay in the text as they stand."""
    m = _TURN.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2])


TURN_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
    ("attachments", pa.list_(pa.struct([("slot", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()),
])
ATTACHED = ("slot", "kind", "ref", "tokens")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            visitor, role = Flatten(), row["role"] or ""
            for part in row["parts"] or []:
                if part is not None:
                    visitor.visit(part)
            head, body = f"<|turn {escape(role)}|>", "".join(visitor.body)
            loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
            attached = [dict(zip(ATTACHED, a)) for a in visitor.attachments]
            out.append((row["conv_id"], row["turn"], role, f"{head}{body}<|end|>\n", *loss, attached, visitor.expanded))
        columns = zip(*out) if out else [[]] * len(TURN_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, TURN_FIELDS)], schema=TURN_FIELDS)


def format_turns(messages: DataFrame) -> DataFrame:
    """One formatted turn per row of (conv_id, turn, role, parts): the text, its loss mask (code points), attachments.

    A conversation's prompt is its rows' `formatted` in the order of turn. Null role is an empty one; null parts, null
    texts and no parts give an empty body; an unknown kind of part counts as text. Other columns are ignored.
    """
    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART}>")).mapInArrow(_format, TURNS)


def text_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as messages of one text part each."""
    text = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return rows.select("conv_id", "turn", "role", F.array(text).alias("parts"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reading:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, lo: int, hi: int) -> None:
        role, text = parse_turn(formatted)
        masked = unescape(formatted[lo:hi])
        self.turns += 1
        self.chars += len(formatted)
        self.loss_chars += len(masked)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(masked.encode())

    def row(self):
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST_FIELDS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation and turn; only running digests are held, so a hot conversation needs no memory."""
    now, done = None, []
    frame = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), DIGEST_FIELDS)], schema=DIGEST_FIELDS)
    for batch in batches:
        for conv, formatted, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Reading(conv)
            now.add(formatted, lo, hi)
        if done:
            yield frame()
            done = []
    if now is not None:
        done = [now.row()]
        yield frame()


def read_back(turns: DataFrame) -> DataFrame:
    """What the formatted turns say per conversation, parsed from the output alone.

    Rows of equal turn are ordered by their formatted text. A null conv_id is a conversation of its own.
    """
    ordered = turns.select("conv_id", "turn", "formatted", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(_read_back, DIGEST)

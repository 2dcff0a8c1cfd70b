"""Server-sent events: frames as columns, and a parser that takes bytes in any pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_END = re.compile(rb"\r\n|\n|\r")
# The events that a client listens for.
NAMED_EVENTS = ["job_started", "stage_started", "stage_progress", "stage_completed", "stage_skipped", "pipeline_etas", "job_completed", "error", "ping", "stream_end"]
EVENTS = "n long, id string, event string, data string"


def frame(event: Column, data: Column, id_: Column | None = None) -> Column:
    """The text of one event. Each line of the data is a line of its own; line ends in names do not pass, null data is empty."""
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    head = F.lit("") if id_ is None else F.coalesce(F.concat(F.lit("id: "), one_line(F.replace(id_.cast("string"), F.lit("\0"), F.lit(""))), F.lit("\n")), F.lit(""))
    name = F.coalesce(F.concat(F.lit("event: "), one_line(event), F.lit("\n")), F.lit(""))
    return F.concat(head, name, F.lit("data: "), F.regexp_replace(F.coalesce(data, F.lit("")), r"\r\n|\r|\n", "\ndata: "), F.lit("\n\n"))


class Parser:
    """Takes the bytes of one connection as they come and gives its events; what it remembers is a short JSON text."""

    def __init__(self, state: str | None = None) -> None:
        held = json.loads(state) if state else {}
        self.rest = bytes.fromhex(held.get("rest", ""))
        self.data, self.event, self.id, self.skip, self.begun = held.get("data", []), held.get("event"), held.get("id"), held.get("skip", False), held.get("begun", False)

    def state(self) -> str:
        return json.dumps({"rest": self.rest.hex(), "data": self.data, "event": self.event, "id": self.id, "skip": self.skip, "begun": self.begun})

    def feed(self, chunk: bytes) -> Iterator[tuple[str | None, str, str]]:
        """(last id, event, data) of each event that ends in `chunk`."""
        if not chunk:
            return
        if self.skip:  # a \r ended the line before, so a \n belongs to it
            chunk, self.skip = chunk.removeprefix(b"\n"), False
        buffer, at = self.rest + chunk, 0
        for end in LINE_END.finditer(buffer, len(self.rest)):
            yield from self._line(buffer[at : end.start()])
            at = end.end()
        self.rest, self.skip = buffer[at:], chunk.endswith(b"\r")

    def _line(self, raw: bytes) -> Iterator[tuple[str | None, str, str]]:
        raw, self.begun = raw if self.begun else raw.removeprefix(b"\xef\xbb\xbf"), True
        if not raw:
            if self.data:
                yield self.id, self.event or "message", "\n".join(self.data)
            self.data, self.event = [], None
            return
        name, _, value = raw.decode("utf-8", "replace").partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            self.data.append(value)
        elif name == "event":
            self.event = value
        elif name == "id" and "\0" not in value:
            self.id = value


def parsed(chunks: DataFrame, keys: tuple[str, ...], seq: str, data: str) -> DataFrame:
    """keys and EVENTS of the binary chunks of each connection in the order of `seq`; n counts a connection's events from 0.

    A connection is one stream of bytes and is read in one pass, which holds its unfinished event; null chunks are empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parser, n = None, Parser(), 0
        for pdf in frames:
            out = []
            for *k, chunk in pdf[[*keys, data]].itertuples(index=False):
                k = [None if pd.isna(x) else x for x in k]
                if k != key:
                    key, parser, n = k, Parser(), 0
                for event in parser.feed(bytes(chunk) if chunk is not None else b""):
                    out.append((*k, n, *event))
                    n += 1
            yield pd.DataFrame(out, columns=[*keys, "n", "id", "event", "data"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keys).schema)
    return chunks.select(*keys, seq, data).repartition(*keys).sortWithinPartitions(*keys, seq).mapInPandas(run, f"{own}, {EVENTS}")


def resumed(events: DataFrame, clients: DataFrame, keys: tuple[str, ...], seq: str, last_id: str) -> DataFrame:
    """The events that each client has not seen: those after its last id, all of them where it is null. `clients` has one row per client."""
    return events.join(clients, list(keys)).filter(F.col(last_id).isNull() | (F.col(seq) > F.col(last_id)))

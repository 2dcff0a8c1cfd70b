"""Models and codecs are not part of this engine: a deployment registers its own by kind and name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: What a backend of a kind takes and returns: columns of the rows that it is mapped over.
KINDS = {
    "transcribe": "job_id string, language string, segments array<struct<start:double,end:double,text:string>>",
    "translate": "job_id string, pos int, source_text string, text string",
    "tts": "job_id string, output_path string, backend string, segments_synthesized int",
    "lipsync": "job_id string, output_path string, backend string, passthrough boolean",
    "probe": "path string, duration double, rate int, channels int",
}
_registered: dict[tuple[str, str], Callable] = {}


class BackendUnavailable(RuntimeError):
    """No such model or codec is registered."""


def register(kind: str, name: str, run: Callable) -> None:
    """`run` maps an iterator of pandas frames to one of the kind's columns; load its model on its first batch."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of backend: {kind}")
    _registered[kind, name] = run


def apply(df: DataFrame, kind: str, name: str) -> DataFrame:
    if (kind, name) not in _registered:
        raise BackendUnavailable(f"{kind} backend {name!r} is not registered")
    return df.mapInPandas(_registered[kind, name], KINDS[kind])

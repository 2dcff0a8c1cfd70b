"""Text functions: normalisation, time stamps, subtitles, parsing of tool output."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Letters that a canonical decomposition leaves whole, and their plain spelling.
PLAIN_LETTERS = {
    "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L",
}
# Asides that are left out.
BRACKETS = [(r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", "")]


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def timestamp(seconds: Column, hours: bool = False, marker: str = ".") -> Column:
    """[HH:]MM:SS.mmm, milliseconds rounded half to even; hours only if asked for or not zero."""
    return clock(F.bround(seconds * 1000, 0), hours, marker)


def whole_ms(micros: Column) -> Column:
    """Milliseconds of whole microseconds, halves to even; no product of seconds moves a half."""
    low, rest = F.floor(micros / 1000), F.pmod(micros, F.lit(1000))
    return low + F.when((rest > 500) | ((rest == 500) & (F.pmod(low, F.lit(2)) == 1)), 1).otherwise(0)


def clock(milliseconds: Column, hours: bool = False, marker: str = ".") -> Column:
    """As `timestamp`, of whole milliseconds."""
    ms = milliseconds.cast("long")
    h = F.floor(ms / 3_600_000)
    m, s, r = F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    rest = F.format_string(f"%02d:%02d{marker}%03d", m, s, r)
    head = F.format_string("%02d:", h)
    return F.concat(head, rest) if hours else F.concat(F.when(h > 0, head).otherwise(F.lit("")), rest)


def srt_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    """One subtitle: number, times in seconds, text with its arrows broken."""
    return srt_block_ms(number, F.bround(start * 1000, 0), F.bround(end * 1000, 0), text)


def srt_block_ms(number: Column, start: Column, end: Column, text: Column) -> Column:
    """`srt_block` of times in whole milliseconds."""
    arrow = F.concat(clock(start, True, ","), F.lit(" --> "), clock(end, True, ","))
    return F.concat_ws("\n", number.cast("string"), arrow, F.replace(strip(text), F.lit("-->"), F.lit("->")), F.lit(""))


def vtt_block(start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat(timestamp(start), F.lit(" --> "), timestamp(end)), F.replace(strip(text), F.lit("-->"), F.lit("->")), F.lit(""))


def drawtext_escape(c: Column) -> Column:
    """Backslash, colon and quote escaped for a filter argument."""
    for ch in ("\\", ":", "'"):
        c = F.replace(c, F.lit(ch), F.lit(f"\\{ch}"))
    return c


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./\\](\.[^./\\]*)$", 1))


def silence_marks(line: Column) -> Column:
    """struct(kind, at_us) of a silence detector's log line, null for other lines."""
    start, end = F.regexp_extract(line, r"silence_start:\s*(-?[0-9.]+)", 1), F.regexp_extract(line, r"silence_end:\s*(-?[0-9.]+)", 1)
    number = lambda c: F.round(c.try_cast("double") * 1_000_000).cast("long")
    return F.when(start != "", F.struct(F.lit("start").alias("kind"), number(start).alias("at_us"))).when(end != "", F.struct(F.lit("end").alias("kind"), number(end).alias("at_us")))


def listed(c: Column) -> Column:
    """The non-empty trimmed items of a comma-separated text."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def optional_int(c: Column) -> Column:
    return F.when(c != "None", c.try_cast("int"))


def optional_float(c: Column) -> Column:
    return F.when(c != "None", c.try_cast("double"))


def http_outcome(status: Column) -> Column:
    """What a service's status says about the request."""
    return F.when(status < 400, "ok").when(status == 400, "bad request").when(status == 422, "invalid input").when(status == 501, "not implemented").when(status == 503, "not ready").otherwise("failed")


# Functions of whole texts take rows a hundred at a time: a batch of Arrow is ten thousand, which long texts fill with gigabytes.
_by_rows = lambda returns: F.udf(returnType=returns, useArrow=False)
ODD = regex.compile(r"[\p{M}\p{S}\p{P}]")
LETTER = regex.compile(r"\X")


@_by_rows(StringType())
def plain_text(t: str | None) -> str | None:
    """Compatibility form with marks, symbols and punctuation as spaces, letters kept."""
    return None if t is None else ODD.sub(" ", unicodedata.normalize("NFKC", t))


def without_diacritics_but(kept: str = ""):
    """Decomposed, then special letters spelled out, non-spacing marks dropped, and other marks, symbols and punctuation but `kept` as spaces."""

    return _by_rows(StringType())(lambda t: None if t is None else bare(t, kept))


@cache
def _marks(kept: str) -> tuple[dict[int, str], regex.Pattern, regex.Pattern]:
    return str.maketrans(PLAIN_LETTERS), regex.compile(r"\p{Mn}"), regex.compile((f"(?![{regex.escape(kept)}])" if kept else "") + r"[\p{M}\p{S}\p{P}]")


def bare(t: str, kept: str = "") -> str:
    """What `without_diacritics_but` makes of one text."""
    table, gone, odd = _marks(kept)
    return odd.sub(" ", gone.sub("", unicodedata.normalize("NFKD", t).translate(table)))


def without_diacritics(c: Column) -> Column:
    return without_diacritics_but()(c)


@_by_rows(StringType())
def spaced_letters(t: str | None) -> str | None:
    """A space between the letters as they are seen: a base with its marks is one."""
    return None if t is None else " ".join(LETTER.findall(t))


def basic_normal(c: Column, diacritics: bool = True, letters: bool = False) -> Column:
    """Lower case without bracketed parts, symbols and runs of white space; `letters` sets all letters apart."""
    bare = F.lower(c)
    for pattern, to in BRACKETS:
        bare = F.regexp_replace(bare, pattern, to)
    plain = F.lower((plain_text if diacritics else without_diacritics)(bare))  # compatibility forms bring capitals back
    return F.regexp_replace(spaced_letters(plain) if letters else plain, r"(?U)\s+", " ")


@_by_rows(DoubleType())
def compression_ratio(t: str | None) -> float | None:
    """Characters of a text for each byte of it compressed."""
    return None if t is None else len(t) / len(zlib.compress(t.encode()))


def utc_iso(micros: Column) -> Column:
    """A time in microseconds as ISO text in UTC."""
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def short_id(job: Column) -> Column:
    return F.substring(job, 1, 8)


def artifact_url(base: str, job: Column, name: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/")), F.lit("/jobs/"), job, F.lit("/artifacts/"), name)


# What a language model is told before the text to translate.
PROMPT = (
    "You are a professional translator. Translate the following text from %s to %s. Preserve the speaker's tone and register. "
    "Match the approximate length of the original so the translated speech fits in roughly the same time. Output only the translation, no commentary.\n\nText: %s"
)


def translation_prompt(source: Column, target: Column, c: Column) -> Column:
    return F.format_string(PROMPT, source, target, c)


def access_refused(error: Column) -> Column:
    """Whether a download failed because the model is gated."""
    low = F.lower(error)
    return low.contains("gated repo") | error.contains("401") | (low.contains("access") & low.contains("restricted"))


def http_message(status: Column, body: Column) -> Column:
    """What a failed request is reported as: the service's own words from its JSON body, by kind of failure."""
    detail = F.coalesce(F.get_json_object(body, "$.detail"), body)
    field = lambda name: F.get_json_object(detail, f"$.{name}")
    words = F.coalesce(field("error"), detail)
    staged = F.concat(F.coalesce(field("message"), detail), F.coalesce(F.concat(F.lit(" "), field("next_step")), F.lit("")))
    return (
        F.when(status == 501, F.concat(F.lit("not implemented ("), F.coalesce(field("phase"), F.lit("scaffold")), F.lit("): "), staged))
        .when(status == 503, F.concat(F.lit("weights missing: "), detail, F.coalesce(F.concat(F.lit(" Fix: "), field("fix")), F.lit(""))))
        .when(status == 422, F.concat(F.lit("could not process the clip: "), words))
        .when(status == 400, F.concat(F.lit("rejected request: "), detail))
        .when(status == 500, F.concat(F.lit("crashed: "), words))
        .otherwise(F.concat(F.lit("failed (HTTP "), status.cast("string"), F.lit("): "), detail))
    )


def event_payload(data: Column) -> Column:
    """struct(json, raw): an event's data as JSON where it parses, else as it is."""
    parsed = F.when(F.get_json_object(data, "$").isNotNull(), data)
    return F.struct(parsed.alias("json"), F.when(parsed.isNull(), data).alias("raw"))


def joined_digest(df: DataFrame, keys: tuple[str, ...], order: str, c: str, between: str, out: str) -> DataFrame:
    """keys, out: the MD5 of a key's texts in order with `between` set between them.

    Rows come sorted by key and only a running digest is held, so a key of very many texts needs no memory.
    """
    rows = df.select(*keys, order, c)
    schema = rows.select(*keys, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, done, types = None, None, [], []
        for batch in batches:
            types = [*(batch.schema.field(k).type for k in keys), pa.string()]
            columns = [batch.column(k).to_pylist() for k in keys]
            for *now, t in zip(*columns, batch.column(c).to_pylist()):
                if running is not None and now == key:
                    running.update((between + t).encode())
                    continue
                if running is not None:
                    done.append([*key, running.hexdigest()])
                key, running = now, hashlib.md5(t.encode(), usedforsecurity=False)
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], [*keys, out])
                done = []
        if running is not None:
            done.append([*key, running.hexdigest()])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], [*keys, out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order, c).mapInArrow(run, schema)

"""Alignment of transcribed words with the expected text, and what it says about where speech ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unmatched words in a row that end an alignment once something has matched.
MOST_MISSES = 3
#: Headroom after the last word, least gain, least share of expected words and of the source's length.
HEADROOM, LEAST_GAIN, LEAST_MATCH, LEAST_SOURCE = 0.08, 0.10, 0.5, 0.5
MICRO = 1_000_000


def normal_word(c: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def tokens(text: Column) -> Column:
    """The normal words of a text, without those that nothing is left of."""
    return F.filter(F.transform(F.split(text, r"\s+"), normal_word), lambda w: w != "")


def _alike(word: Column, expected: Column) -> Column:
    prefix = (F.length(word) >= 3) & expected.startswith(word)
    return (word == expected) | prefix | ((F.length(expected) >= 3) & word.startswith(expected))


def align(words: Column, expected: Column) -> Column:
    """struct(matched, expected_n, last_end) of words (array of struct(word, end), normal and not empty) and expected words.

    One pointer into the expected words moves on at every match. Words after the last expected one, or after
    MOST_MISSES unmatched in a row once something has matched, are not read. Both arrays are those of one
    segment, so a fold in one row is bounded.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("misses"), F.lit(None).cast("bigint").alias("last_end"), F.lit(False).alias("done"))

    def step(s: Column, w: Column) -> Column:
        over = s["done"] | (s["at"] >= F.size(expected))
        hit = F.coalesce(_alike(w["word"], F.get(expected, s["at"])), F.lit(False))
        misses = F.when(hit, 0).otherwise(s["misses"] + 1)
        new = F.struct(
            F.when(hit, s["at"] + 1).otherwise(s["at"]).alias("at"),
            misses.alias("misses"),
            F.when(hit, w["end"]).otherwise(s["last_end"]).alias("last_end"),
            (~hit & (misses >= MOST_MISSES) & s["last_end"].isNotNull()).alias("done"),
        )
        return F.when(over, s).otherwise(new)

    done = F.aggregate(words, start, step)
    return F.struct(done["at"].cast("long").alias("matched"), F.size(expected).cast("long").alias("expected_n"), done["last_end"].alias("last_end"))


def tail_trim(matched: Column, expected_n: Column, word_end: Column, segment_end: Column, current: Column, source: Column) -> dict[str, Column]:
    """tier, trim_to, action of a synthesised clip, all times in microseconds.

    The later of the aligned word end (if enough words matched) and the last segment's end is kept, with headroom. Nothing
    is cut if that would leave too little of the source's length, or save too little.
    """
    tier1 = F.when(matched / F.greatest(F.lit(1), expected_n) >= LEAST_MATCH, word_end)
    chosen = F.greatest(tier1, segment_end)
    trim_to = F.when(chosen.isNotNull(), F.least(current, chosen + int(HEADROOM * MICRO)))
    tier = F.when(chosen.isNull(), "none").when(F.coalesce(chosen == tier1, F.lit(False)), "word-align").otherwise("vad-segment")
    action = (
        F.when(chosen.isNull(), "no-endpoint")
        .when((source > 0) & (trim_to < source * LEAST_SOURCE), "below-floor")
        .when(current - trim_to < int(LEAST_GAIN * MICRO), "little-gain")
        .otherwise("trim")
    )
    return {"tier": tier, "trim_to": trim_to, "action": action}

"""Interval operators over (key, start, end) rows in whole microseconds: islands, merge, complement, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import KEY, SLICE, Timeline, first_known, own_rows, previous, running_sum, sliced


def islands(df: DataFrame, t: Timeline, start: str, end: str, gap: int, name: str = "island") -> DataFrame:
    """`df` plus the number, from 0, of its row's island: a row starts one if it starts over `gap` after the row before ends.

    The row before counts, not the largest end so far, so a short row inside a long one moves the end back. Breaks are counted
    inside each slice; a slice carries in the breaks before it and whether its own first row is one.
    """
    own, place = own_rows(t), F.struct(*t.order)
    apart = lambda a, b: F.when(a - b > gap, 1).otherwise(0)
    broken = sliced(df, t).withColumn("cadenza__break", apart(F.col(start), F.lag(end).over(own)))
    inside = broken.withColumn("cadenza__run", F.sum("cadenza__break").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.min_by(start, place).alias("_head"), F.max_by(end, place).alias("_tail"), F.sum("cadenza__break").alias("_breaks")]

    def outs(upto: WindowSpec, _: WindowSpec) -> list[Column]:
        first = apart(F.col("_head"), F.lag("_tail").over(upto))
        before = F.coalesce(F.sum("_breaks").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return [before.alias("_before"), first.alias("_first")]

    parts = inside.groupBy(KEY, SLICE).agg(*aggs)
    upto = Window.partitionBy(KEY).orderBy(SLICE)
    heads = parts.select(KEY, SLICE, *outs(upto, upto))
    based = heads.select(KEY, SLICE, (F.col("_before") + F.sum("_first").over(upto.rowsBetween(Window.unboundedPreceding, 0))).alias("cadenza__base"))
    return inside.join(based, [KEY, SLICE]).select(*df.columns, (F.col("cadenza__base") + F.col("cadenza__run")).cast("long").alias(name))


def island_spans(df: DataFrame, t: Timeline, start: str, end: str, gap: int) -> DataFrame:
    """keys, island, start, end, n: from the first row's start to the last row's end of each island."""
    place = F.struct(*t.order)
    return islands(df, t, start, end, gap).groupBy(*t.keys, "island").agg(F.min_by(start, place).alias("start"), F.max_by(end, place).alias("end"), F.count("*").alias("n"))


def longest(spans: DataFrame, keys: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end: each key's longest span, the earliest of equal ones."""
    best = F.max_by(F.struct(start, end), F.struct(F.col(end) - F.col(start), -F.col(start)))
    return spans.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col(f"_best.{start}").alias(start), F.col(f"_best.{end}").alias(end))


def merge(df: DataFrame, t: Timeline, start: str, end: str, nearer: int) -> DataFrame:
    """keys, island, start, end, n: rows less than `nearer` apart become one, which ends where its last row ends."""
    return island_spans(df, t, start, end, nearer - 1)


def complement(df: DataFrame, t: Timeline, start: str, end: str, low: str, high: str) -> DataFrame:
    """keys, start, end of what the rows leave of [low, high], two columns that are constant in a key."""
    place = F.struct(*t.order)
    gaps = previous(df, t, {"_prev_end": end}).select(*t.keys, F.coalesce("_prev_end", low).alias("_from"), F.col(start).alias("_to"))
    tails = df.groupBy(*t.keys).agg(F.max_by(end, place).alias("_from"), F.max(high).alias("_to"))
    return gaps.unionByName(tails).filter("_from < _to").select(*t.keys, F.col("_from").alias("start"), F.col("_to").alias("end"))


def assemble(df: DataFrame, t: Timeline, start: str, end: str, dropped: str, least: int) -> DataFrame:
    """keys, pos, kind, offset, length: the output timeline of segments.

    A kept segment lies after a silence of its source gap if that is over `least`, but not the first kept one. A dropped
    segment becomes a silence of its own length if that is over `least`; the gap before it is lost. A key without
    kept segments has no timeline.
    """
    place = F.struct(*t.order)
    rows = first_known(previous(df, t, {"_prev_end": end}), t, {"_first": F.when(~F.col(dropped), place)}).filter("_first is not null")
    piece = lambda sub, kind, length: F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), length.cast("long").alias("length"))
    gap = F.when(~F.col(dropped) & (place != F.col("_first")), F.col(start) - F.col("_prev_end"))
    own = F.col(end) - F.col(start)
    pieces = F.array(piece(0, "silence", gap), F.when(F.col(dropped), piece(1, "silence", own)).otherwise(piece(1, "segment", own)))
    wanted = F.filter(pieces, lambda p: (p["kind"] == "segment") | F.coalesce(p["length"] > least, F.lit(False)))
    flat = rows.withColumn("_piece", F.explode(wanted)).select(*dict.fromkeys([*t.keys, *t.order]), F.col("_piece.sub").alias("_sub"), F.col("_piece.kind").alias("kind"), F.col("_piece.length").alias("length"))
    summed = running_sum(flat, Timeline(t.keys, (*t.order, "_sub"), t.width), {"_upto": F.col("length"), "_nth": F.lit(1)})
    return summed.select(*t.keys, (F.col("_nth") - 1).alias("pos"), "kind", (F.col("_upto") - F.col("length")).alias("offset"), "length")


def prepend(timeline: DataFrame, keys: tuple[str, ...], lead: int) -> DataFrame:
    """The timeline after a silence of `lead`."""
    shifted = timeline.withColumns({"pos": F.col("pos") + 1, "offset": F.col("offset") + lead})
    heads = timeline.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("pos"), F.lit("silence").alias("kind"), F.lit(0).cast("long").alias("offset"), F.lit(lead).cast("long").alias("length"))
    return heads.unionByName(shifted.select(*heads.columns))

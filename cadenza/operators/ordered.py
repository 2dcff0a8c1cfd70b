"""Row-order operators per key that do not put a key's rows into one task.

A key may hold a third of all rows (one very long clip). So rows are grouped by (key, slice), a slice being a stretch of
the order column; what a slice needs from the slices before it is a few values per slice, found in a second, small window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Timeline:
    """Rows of `keys` in the order of `order`, whose first column is a whole number cut into slices of `width`."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int = DAY_US


#: Names of the two columns that rows are dealt by while an operator runs.
KEY, SLICE = "cadenza__key", "cadenza__slice"


def sliced(df: DataFrame, t: Timeline) -> DataFrame:
    """`df` with its key and slice, by which a window over a slice's own rows deals them."""
    slice_ = F.coalesce(F.expr(f"`{t.order[0]}` div {t.width}"), F.lit(-(2**62)))
    return df.withColumns({KEY: F.struct(*t.keys), SLICE: slice_})


def own_rows(t: Timeline) -> WindowSpec:
    return Window.partitionBy(KEY, SLICE).orderBy(*t.order)


def carry(dealt: DataFrame, aggs: list[Column], outs: Callable[[WindowSpec, WindowSpec], list[Column]]) -> DataFrame:
    """`dealt` joined to values of its slice: `aggs` are made per slice, before the shuffle as far as they can, and `outs` turns them
    into the values to join, over the slices of a key in order and as a whole."""
    parts = dealt.groupBy(KEY, SLICE).agg(*aggs)
    upto = Window.partitionBy(KEY).orderBy(SLICE)
    return dealt.join(parts.select(KEY, SLICE, *outs(upto, Window.partitionBy(KEY))), [KEY, SLICE])


def _attach(df: DataFrame, t: Timeline, aggs: list[Column], outs: Callable[[WindowSpec, WindowSpec], list[Column]]) -> tuple[DataFrame, WindowSpec]:
    return carry(sliced(df, t), aggs, outs), own_rows(t)


def previous(df: DataFrame, t: Timeline, cols: dict[str, str]) -> DataFrame:
    """`df` plus, by new name, column values of the row before; null in a key's first row."""
    here = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    joined, own = _attach(df, t, [F.max_by(here, F.struct(*t.order)).alias("_tail")], lambda upto, _: [F.lag("_tail").over(upto).alias("_tail")])
    before = F.coalesce(F.lag(here).over(own), F.col("_tail"))
    return joined.withColumn("_before", before).select(*df.columns, *[F.col("_before")[n].alias(n) for n in cols])


def running_sum(df: DataFrame, t: Timeline, cols: dict[str, Column]) -> DataFrame:
    """`df` plus, by new name, sums of whole-number expressions from a key's first row up to this one."""
    aggs = [F.sum(c).alias(f"_sum_{n}") for n, c in cols.items()]
    prior = lambda n, upto: F.coalesce(F.sum(f"_sum_{n}").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_prior_{n}")
    joined, own = _attach(df, t, aggs, lambda upto, _: [prior(n, upto) for n in cols])
    upto_here = own.rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *[(F.col(f"_prior_{n}") + F.coalesce(F.sum(c).over(upto_here), F.lit(0))).cast("long").alias(n) for n, c in cols.items()])


def running_max(df: DataFrame, t: Timeline, cols: dict[str, Column]) -> DataFrame:
    """`df` plus, by new name, the largest value of an expression in the rows before this one; null where there is none."""
    aggs = [F.max(c).alias(f"_max_{n}") for n, c in cols.items()]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    joined, own = _attach(df, t, aggs, lambda upto, _: [F.max(f"_max_{n}").over(before(upto)).alias(f"_max_{n}") for n in cols])
    return joined.select(*df.columns, *[F.greatest(F.col(f"_max_{n}"), F.max(c).over(before(own))).alias(n) for n, c in cols.items()])


def numbered(df: DataFrame, t: Timeline, name: str = "idx") -> DataFrame:
    """`df` plus each row's position in its key, from 0."""
    return running_sum(df, t, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def counted(df: DataFrame, t: Timeline, name: str = "n") -> DataFrame:
    """`df` plus the number of rows of its key."""
    joined, _ = _attach(df, t, [F.count("*").alias("_n")], lambda _, whole: [F.sum("_n").over(whole).alias(name)])
    return joined.select(*df.columns, name)


def first_known(df: DataFrame, t: Timeline, cols: dict[str, Column]) -> DataFrame:
    """`df` plus, by new name, the first non-null value of an expression in its key."""
    place = F.struct(*t.order)
    aggs = [F.min_by(F.struct(place.alias("at"), c.alias("v")), F.when(c.isNotNull(), place)).alias(f"_{n}") for n, c in cols.items()]
    joined, _ = _attach(df, t, aggs, lambda _, whole: [F.min(f"_{n}").over(whole).alias(f"_{n}") for n in cols])
    return joined.select(*df.columns, *[F.col(f"_{n}.v").alias(n) for n in cols])


def last_known(df: DataFrame, t: Timeline, cols: dict[str, Column]) -> DataFrame:
    """`df` plus, by new name, the last non-null value of an expression up to this row; null before the first."""
    place = F.struct(*t.order)
    aggs = [F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_before_{n}") for n, c in cols.items()]
    prior = lambda n, upto: F.last(f"_before_{n}", True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}")
    joined, own = _attach(df, t, aggs, lambda upto, _: [prior(n, upto) for n in cols])
    here = own.rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *[F.coalesce(F.last(c, True).over(here), F.col(f"_before_{n}")).alias(n) for n, c in cols.items()])


def filled(df: DataFrame, t: Timeline, cols: list[str]) -> DataFrame:
    """`df` with nulls of `cols` replaced by the last known value, leading ones by the first; all-null keys stay null."""
    place = F.struct(*t.order)
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_last_{c}") for c in cols]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_first_{c}") for c in cols]

    def outs(upto: WindowSpec, whole: WindowSpec) -> list[Column]:
        before = [F.last(f"_last_{c}", True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_last_{c}") for c in cols]
        return before + [F.first(f"_first_{c}", True).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_first_{c}") for c in cols]

    joined, own = _attach(df, t, aggs, outs)
    here = own.rowsBetween(Window.unboundedPreceding, 0)
    new = {c: F.coalesce(F.last(c, True).over(here), F.col(f"_last_{c}"), F.col(f"_first_{c}")) for c in cols}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def framed(df: DataFrame, t: Timeline, idx: str = "idx", fill: tuple[str, ...] = (), n: str | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """`numbered`, `filled`, `counted` and `previous` at once: rows are dealt, and their slices summed up, one time for all.

    `before` takes column values, as they are after filling, from the row before.
    """
    place, before = F.struct(*t.order), before or {}
    known = lambda c: F.when(F.col(c).isNotNull(), place)
    aggs = [F.count("*").alias("_rows"), *[F.max_by(F.col(c), known(c)).alias(f"_last_{c}") for c in fill], *[F.min_by(F.col(c), known(c)).alias(f"_first_{c}") for c in fill]]
    plain = [c for c in before.values() if c not in fill]
    if plain:
        aggs.append(F.max_by(F.struct(*plain), place).alias("_tail"))

    def outs(upto: WindowSpec, whole: WindowSpec) -> list[Column]:
        prior, every = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = [F.coalesce(F.sum("_rows").over(prior), F.lit(0)).alias("_prior"), F.sum("_rows").over(whole).alias("_n")]
        for c in fill:
            out += [F.last(f"_last_{c}", True).over(prior).alias(f"_last_{c}"), F.first(f"_first_{c}", True).over(every).alias(f"_first_{c}")]
        return out + ([F.lag("_tail").over(upto).alias("_tail")] if plain else [])

    joined, own = _attach(df, t, aggs, outs)
    here = own.rowsBetween(Window.unboundedPreceding, 0)
    held = {c: F.coalesce(F.last(c, True).over(here), F.col(f"_last_{c}"), F.col(f"_first_{c}")) for c in fill}
    at = F.col("_prior") + F.row_number().over(own) - 1
    rows = joined.withColumns({f"_held_{c}": e for c, e in held.items()} | {"_idx": at.cast("long")})
    past = []
    for name, c in before.items():
        if c in fill:  # the row before, or what the slices before leave behind, or, before the first known value, that
            past.append(F.when(F.col("_idx") > 0, F.coalesce(F.lag(f"_held_{c}").over(own), F.col(f"_last_{c}"), F.col(f"_first_{c}"))).alias(name))
        else:
            past.append(F.when(F.row_number().over(own) == 1, F.col("_tail")[c]).otherwise(F.lag(c).over(own)).alias(name))
    return rows.select(*[F.col(f"_held_{c}").alias(c) if c in fill else F.col(c) for c in df.columns], F.col("_idx").alias(idx), *([F.col("_n").alias(n)] if n else []), *past)


def neighbourhoods(df: DataFrame, keys: tuple[str, ...], idx: str, before: int, after: int, block: int = 4_096) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt to blocks of `block` positions, with copies of the neighbours that a block needs.

    Use the window, then keep the rows with `_home`. `idx` counts from 0 in each key.
    """
    first, last = F.expr(f"greatest(0, `{idx}` - {after}) div {block}"), F.expr(f"(`{idx}` + {before}) div {block}")
    dealt = df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_home", F.col("_block") == F.expr(f"`{idx}` div {block}"))
    return dealt, Window.partitionBy(*keys, "_block").orderBy(idx)


def exact_percentiles(df: DataFrame, value: str, shares: list[float], width: int) -> DataFrame:
    """One row with p<share> columns: exact percentiles of a whole-number column, linear between neighbours.

    Values are counted, and the counts summed up in value order by slices, so no task holds them all.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("count")).withColumn("_all", F.lit(0))
    t = Timeline(("_all",), (value,), width)
    prior = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_prior")
    joined, own = _attach(counts, t, [F.sum("count").alias("_n")], lambda upto, whole: [prior(upto), F.sum("_n").over(whole).alias("n")])
    joined = joined.withColumn("upto", F.col("_prior") + F.sum("count").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = []
    for s in shares:
        rank = (F.col("n") - 1) * F.lit(s)
        low, high = (F.min(F.when(F.col("upto") > F.floor(rank) + k, F.col(value))) for k in (0, 1))
        part = F.max(rank - F.floor(rank))
        out.append((low + F.coalesce(high - low, F.lit(0)) * part).alias(f"p{round(s * 100)}"))
    return joined.agg(*out)

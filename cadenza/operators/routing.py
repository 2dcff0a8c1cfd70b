"""Lookups, preference routing and request validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup table of more rows than this is joined by shuffle, not broadcast.
BROADCAST_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lookup(df: DataFrame, names: DataFrame, key: str, out: str, default: Column | None = None) -> DataFrame:
    """`df` plus `out` from `names` (one row per key); a miss gets `default`, null if there is none."""
    found = df.join(small(names.select(key, out)), key, "left")
    return found if default is None else found.withColumn(out, F.coalesce(out, default))


def unsupported(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, n: the values of `df` that `names` lacks, counted before they are matched."""
    return df.groupBy(key).agg(F.count("*").alias("n")).join(small(names.select(key)), key, "left_anti")


def choose_backend(df: DataFrame, prefs: DataFrame, ready: DataFrame, key: str, default: str) -> DataFrame:
    """`df` plus backend, ideal, suboptimal: the first preferred backend that is ready, else `default`.

    `prefs` is (key, backend, rank), `ready` is (backend). Routes are made once per key value, then looked up. Where no
    preferred backend is ready, `default` counts as the ideal one.
    """
    usable = prefs.join(small(ready.select("backend")), "backend", "left_semi")
    chosen = usable.groupBy(key).agg(F.min_by("backend", "rank").alias("backend"))
    routes = prefs.groupBy(key).agg(F.min_by("backend", "rank").alias("ideal")).join(chosen, key, "left")
    found = df.join(small(routes), key, "left")
    picked = F.coalesce("backend", F.lit(default))
    return found.withColumns({"backend": picked, "ideal": F.when(F.col("backend").isNull(), default).otherwise(F.col("ideal"))}).withColumn("suboptimal", F.col("backend") != F.col("ideal"))


def normal(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition is true; null rows of a condition pass it."""
    return reduce(lambda done, rule: F.when(done.isNotNull(), done).when(rule[1], rule[0]), rules, F.lit(None).cast("string"))


def not_in(c: Column, allowed: list[str]) -> Column:
    return c.isNotNull() & ~normal(c).isin(allowed)


def outside(c: Column, low: float, high: float) -> Column:
    return c.isNotNull() & ~c.between(low, high)


def to_boolean(c: Column) -> Column:
    """true, false, or null where the text is null or neither."""
    return F.when(normal(c).isin("1", "true", "yes", "on"), True).when(normal(c).isin("0", "false", "no", "off", ""), False)


def known_knobs(knobs: Column) -> Column:
    """A map without its null values, null if nothing is left."""
    kept = F.map_filter(knobs, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def forwarded(knobs: Column, allowed: list[str]) -> Column:
    """The non-null entries of a map whose keys are on the list."""
    return F.map_filter(knobs, lambda k, v: v.isNotNull() & k.isin(allowed))


def first_available(choices: list[tuple[str, Column]]) -> Column:
    """The name of the first choice whose condition holds."""
    return F.coalesce(*[F.when(ok, F.lit(name)) for name, ok in choices])


def resolve_alias(df: DataFrame, codes: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """`df` plus code: the name itself if it is a code, else its alias's code, else null."""
    own = small(codes.select(F.col("code").alias(name), F.col("code").alias("_own")))
    other = small(aliases.select(F.col("alias").alias(name), F.col("code").alias("_other")))
    return df.join(own, name, "left").join(other, name, "left").withColumn("code", F.coalesce("_own", "_other")).drop("_own", "_other")


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    """A setting's text if it is one of the values, else the default."""
    held = normal(c)
    return F.when(held.isin(allowed), held).otherwise(default)


def held_number(c: Column, low: float, high: float, default: float) -> Column:
    """A setting's number held to a range; the default where it is missing or no number."""
    number = F.regexp_replace(c, r"^\s+|\s+$", "").try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), number))), F.lit(default))


def merged(base: Column, over: Column, names: dict[str, str] | None = None) -> Column:
    """Entries of two maps, those of `over` first; null values of `over` count as not given. Keys are renamed by `names`."""
    given = F.map_filter(over, lambda _, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(given), k), F.lit(False)))
    both = F.map_concat(kept, given)
    if not names:
        return both
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(both, lambda k, _: F.coalesce(F.element_at(table, k), k))

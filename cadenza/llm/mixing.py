"""Mixing sources to target weights with DataFrame functions only.

Sizes are added up per source, targets are filled by weight under a cap, and a document is taken floor(rate) times plus
once more when a hash-seeded draw falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, unboxed

#: A run of anything but space, \t, \n, \v, \f and \r is a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A target stops at so many times its source's size.
CAP = 3
#: Weights by the sources' order, repeating.
WEIGHTS = 3
#: Rows that are equal are numbered in so many shares.
SALTS = 64
#: More distinct sources than this are joined by shuffle, not broadcast.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source of (source, size) rows.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops at CAP
    times its source's size; the excess goes to the others by weight until none is above. That fixed point is found in
    one pass: in the order of cap / weight, a source is capped when the level left for the rest exceeds its own.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(WEIGHTS)) + 1).cast("long")).withColumn("cap", F.col("source_size") * CAP)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    prior, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(prior), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    filled = weighed.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)  # past the first that is not capped, levels only fall
    return filled.select("source", "source_size", F.round(F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(final * F.col("weight")), 6).alias("target"))


def placed(rows: DataFrame, key: str) -> DataFrame:
    """`rows` plus place: 0, 1, 2, .. among the rows of a key, in no particular order; keys that repeat may hold very many rows.

    Rows are numbered in SALTS shares of a key, and the shares' counts added up. Nothing is shuffled but keys where none repeats.
    """
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit(True).alias("_more"))
    if repeated.isEmpty():
        return rows.withColumn("place", F.lit(0).cast("long"))
    told = rows.withColumn("_tie", F.monotonically_increasing_id()).join(repeated, key, "left").withColumn("_salt", F.when(F.col("_more"), F.pmod("_tie", F.lit(SALTS))))
    alone = told.filter(F.col("_more").isNull()).withColumn("place", F.lit(0).cast("long"))
    more = told.filter("_more").withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_tie")) - 1)
    shares = told.filter("_more").groupBy(key, "_salt").agg(F.count("*").alias("_n"))  # at most SALTS a key
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = more.join(shares.select(key, "_salt", before.alias("_before")), [key, "_salt"]).withColumn("place", F.col("_before") + F.col("_nth"))
    return alone.select(*rows.columns, "place").unionByName(numbered.select(*rows.columns, "place"))


def with_copies(docs: DataFrame, seed: str = "mix", whole: bool = True) -> DataFrame:
    """row (the columns of `docs`, or but doc_id and source where not `whole`), size, source_size, target and copies, the times that the mix takes a row.

    Null text and text without words have size 0; sources of size 0 get target 0 and no copies. The draw is a hash of the seed,
    doc_id, text and the row's place among rows that are equal in these and the source. So reruns agree, rows without a doc_id
    or with the same one draw apart, and of equal rows as many are taken whatever their order. An empty table gives an empty result.
    """
    text = F.coalesce("row.text", F.lit(""))
    own = F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.md5(text))
    sized = boxed(docs).withColumns({"size": F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long"), "own": own})
    targets = source_targets(sized.select("row.source", "size")).withColumnRenamed("source", "name")
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "own", F.col("place").cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    keyed = sized.withColumn("equal", F.md5(F.concat_ws(":", "own", F.coalesce(F.concat(F.lit("="), F.col("row.source")), F.lit("")))))
    if not whole:
        keyed = keyed.withColumn("row", F.struct("row.doc_id", "row.source"))
    joined = placed(keyed, "equal").join(targets, F.col("row.source").eqNullSafe(F.col("name")))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).select("row", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row of `docs`, with its columns as they are, as many times as it is taken."""
    taken = with_copies(docs, seed).filter("copies > 0")
    return unboxed(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return with_copies(docs.select("doc_id", "text", "source"), whole=False).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

"""What the operators share: materialised tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.002
#: Rows of a hot key go to so many shuffle keys.
SALTS = 64
#: Tables written by this process and not yet released.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set a local session takes a temporary one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="cadenza-")  # one machine only
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written so far and says how many; call it once their results have been used."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """`df` by a reliable checkpoint in the shared folder; used inside iterations, Spark's cleaner drops old ones."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join `rows` to `groups` (one row per key, `size` counting its rows) without one task per hot key.

    The list of hot keys is broadcast: by HOT_SHARE it has at most 500 entries however large the input. Their rows
    are salted over SALTS shuffle keys and the group row is copied to each of these. Null keys match nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(1000, int(total * HOT_SHARE))
    hot = groups.filter(F.col(size) > bound).select(F.col(key), F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if t in ("bigint", "int")] or [key]), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    copies = groups.withColumn("_salt", F.explode(F.when(F.col(size) > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def hash_sample(rows: DataFrame, keys: list[str], most: int, by: str | None = None, groups: int = 1_000) -> DataFrame:
    """(by, keys) of at most `most` distinct keys, those of the smallest hashes; of each value of `by` where it is given.

    Of very many values of `by` the `groups` most frequent count. A cut on the hash comes first, so that tasks send few rows on.
    """
    hashed, group = F.xxhash64(*keys), F.lit(0) if by is None else F.col(by)
    sizes = rows.groupBy(group.alias("group")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(groups)
    share = F.least(F.lit(1.0), F.lit(8.0 * most) / F.col("n"))
    some = rows.select(group.alias("group"), *keys, hashed.alias("hash")).join(F.broadcast(sizes), "group").filter((F.col("hash") / 2.0**64 + 0.5) <= share)
    nth = F.row_number().over(Window.partitionBy("group").orderBy("hash", *keys))
    few = some.select("group", "hash", *keys).distinct().withColumn("nth", nth).filter(F.col("nth") <= most)
    return few.select(*([F.col("group").alias(by)] if by else []), *keys)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns in one struct `row`, so that helper columns beside it clash with none of them."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def positional(docs: DataFrame) -> DataFrame:
    """`docs` with its columns renamed to c0, c1, ..; `renamed` gives the names back."""
    return docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def renamed(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """c0, c1, .. of `df` under the given names, then the columns `more`."""
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

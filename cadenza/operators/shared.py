"""Tables and lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a temporary folder in a local session and the warehouse, which is shared, on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    return tempfile.mkdtemp(prefix="cadenza-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def plain_path(path: str) -> str:
    """A path for Python's own file calls: a shared folder mounted at the same place on driver and executors."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"needs a mounted folder, not {path.split('://')[0]}://")
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` by a reliable checkpoint, for loops whose plan would double."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)

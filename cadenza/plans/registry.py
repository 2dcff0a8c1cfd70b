"""Queries over the driver's tables by name, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds of a zoneless time stamp, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()))


def six(c: Column) -> Column:
    """Six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)

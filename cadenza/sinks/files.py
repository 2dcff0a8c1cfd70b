"""Sinks: change logs, subtitles, reports. Tables of generated media keep their provenance columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("watermark", "metadata_comment")


def append_log(df: DataFrame, path: str, version: str = "version") -> None:
    """A new version of each row; `operators.jobs.latest` reads the last ones."""
    df.withColumn(version, F.current_timestamp()).write.mode("append").parquet(path)


def outputs(df: DataFrame, path: str) -> None:
    """Generated media; refuses a table without its provenance columns."""
    if lost := [c for c in PROVENANCE if c not in df.columns]:
        raise ValueError(f"a table of generated media needs {', '.join(lost)}")
    df.write.mode("append").parquet(path)


def lines(df: DataFrame, keys: tuple[str, ...], order: str, line: str, path: str) -> None:
    """Text files of ordered lines, keys kept together and sorted within files."""
    df.repartition(*keys).sortWithinPartitions(*keys, order).select(line).write.mode("overwrite").text(path)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def passthrough(jobs: DataFrame, job: str, source: str, backend: str, name: str = "lipsynced.mp4") -> DataFrame:
    """job, source, output_path, passthrough, watermark, metadata_comment: jobs whose backend is none hand their input on as it is.

    The copy keeps its provenance columns like any other output; nothing is made of it yet, so it needs no comment of its own.
    """
    own = jobs.filter((F.col(backend) == "none") & F.col(source).isNotNull())
    return own.select(job, source, F.lit(name).alias("output_path"), F.lit(True).alias("passthrough"), F.lit(False).alias("watermark"), F.lit(None).cast("string").alias("metadata_comment"))


def stability_report(stats: DataFrame, columns: dict[str, str], title: str) -> DataFrame:
    """line (pos, text): a row of figures as a person reads it, two to a line; null figures say that there is none."""
    cell = lambda n: F.concat(F.rpad(F.lit(f"{n}:"), 7, " "), F.when(F.col(columns[n]).isNotNull(), F.lpad(F.format_string("%.2f", F.col(columns[n]).cast("double")), 8, " ")).otherwise(F.lit("       -")))
    names = list(columns)
    pairs = [F.concat_ws("   ", *map(cell, names[i : i + 2])) for i in range(0, len(names), 2)]
    return stats.select(F.posexplode(F.array(F.lit(title), *[F.concat(F.lit("  "), p) for p in pairs])).alias("pos", "text"))

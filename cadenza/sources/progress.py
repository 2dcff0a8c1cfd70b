"""Progress files, `<folder>/<job>/progress.json`, each overwritten as its job goes on: a source for streams and batches, and their writer.

A stream's offset is the largest modification time seen, in nanoseconds, however many files there are; a batch reads the files changed
after the offset before it, as they stand by then. A file that is half written, gone or no progress document gives no row, and one
when it is written again. The folder must be mounted at the same place on driver and executors.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.shared import plain_path

FORMAT, FILE = "progress_files", "progress.json"
PROGRESS = "job_id string, phase string, percent double, timestamp double, modified_ns long"
#: Files that one task reads.
TASK_FILES = 512


@dataclass
class Files(InputPartition):
    names: list[tuple[str, str]]


def changed(folder: str, after: int, upto: int | None = None) -> Iterator[tuple[int, str, str]]:
    """(modified, job, path) of the progress files changed after one time and not after another."""
    try:
        jobs = list(os.scandir(folder))
    except FileNotFoundError:
        return
    for job in jobs:
        path = f"{job.path}/{FILE}"
        try:
            at = os.stat(path).st_mtime_ns
        except OSError:
            continue
        if after < at and (upto is None or at <= upto):
            yield at, job.name, path


def read_document(job: str, path: str) -> tuple | None:
    """A row of PROGRESS, or None for what is no whole progress document."""
    try:
        with open(path, "rb") as f:
            at = os.fstat(f.fileno()).st_mtime_ns
            doc = json.loads(f.read())
    except (OSError, ValueError):
        return None
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    if not isinstance(doc, dict) or number(doc.get("percent")) is None:
        return None
    phase = doc.get("phase")
    return job, phase if isinstance(phase, str) else None, number(doc["percent"]), number(doc.get("timestamp")), at


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.settle = plain_path(options["path"]), int(options.get("settle_ms", "0")) * 1_000_000

    def parts(self, after: int, upto: int | None) -> list[InputPartition]:
        names = sorted((job, path) for _, job, path in changed(self.folder, after, upto))
        return [Files(names[i : i + TASK_FILES]) for i in range(0, len(names), TASK_FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return (row for job, path in partition.names if (row := read_document(job, path)))


class ProgressReader(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.parts(-1, None)


class ProgressStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"ns": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        """With `settle_ms`, files changed just now wait, for file systems whose times are coarse."""
        held = time.time_ns() - self.settle if self.settle else None
        return {"ns": max((at for at, _, _ in changed(self.folder, -1, held)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.parts(start["ns"], end["ns"])

    def commit(self, end: dict) -> None:
        pass  # nothing is kept by offset


class ProgressWriter(DataSourceWriter):
    """Each row takes the place of its job's file, in one step; a row whose job is no bare name is an error."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = plain_path(options["path"])

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for row in iterator:
            if not row.job_id or "/" in row.job_id or row.job_id.startswith("."):
                raise ValueError(f"no job name: {row.job_id!r}")
            home = f"{self.folder}/{row.job_id}"
            os.makedirs(home, exist_ok=True)
            staged = f"{home}/.{FILE}-{uuid.uuid4().hex}"
            with open(staged, "w") as f:
                json.dump({"phase": row.phase, "percent": row.percent, "timestamp": time.time()}, f)
            os.replace(staged, f"{home}/{FILE}")
        return WriterCommitMessage()


class ProgressFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PROGRESS

    def reader(self, schema) -> DataSourceReader:
        return ProgressReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ProgressStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ProgressWriter(self.options)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """PROGRESS of every job, as its file stands."""
    spark.dataSource.register(ProgressFiles)
    return spark.read.format(FORMAT).load(path)


def progress_stream(spark: SparkSession, path: str, settle_ms: int = 0) -> DataFrame:
    """PROGRESS of every job's file again each time it has changed, without what was overwritten in between."""
    spark.dataSource.register(ProgressFiles)
    return spark.readStream.format(FORMAT).option("settle_ms", str(settle_ms)).load(path)


def overwrite_progress(df: DataFrame, path: str, version: str) -> None:
    """Writes each job's last row of `df` (job_id, phase, percent and `version`) over its progress file."""
    df.sparkSession.dataSource.register(ProgressFiles)
    last = df.groupBy("job_id").agg(F.max_by(F.struct("phase", F.col("percent").cast("double").alias("percent")), version).alias("last")).select("job_id", "last.*")
    last.write.format(FORMAT).mode("append").save(path)


def latest_progress(seen: DataFrame) -> DataFrame:
    """job_id, phase, percent of the last change of each job's file among the rows that a stream has given."""
    return seen.groupBy("job_id").agg(F.max_by(F.struct("phase", "percent"), "modified_ns").alias("last")).select("job_id", "last.*")

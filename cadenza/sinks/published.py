"""Files that appear whole or not at all: tasks stage them, and the driver's commit makes them visible in one step.

`cache`: entries by key, in Parquet; a manifest names the files of a commit, the last commit of a key wins, and what no manifest names
(a task that died, a job that was aborted) is a miss. `npy`, `lines`: one array or text file for each group of rows. The folder must be mounted at
the same place on driver and executors.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text as forms_of
from ..operators.ordered import Timeline, numbered
from ..operators.shared import plain_path

COMMIT = "version long, files array<string>"
#: Threads of a commit.
COMMITTERS = 16
#: Forms of subtitle files.
FORMS = ["txt", "vtt", "srt"]


@dataclass
class StagedFiles(WriterCommitMessage):
    """(staged path, place) of what a task has written."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Staging(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = plain_path(options["path"])

    def staged(self, suffix: str) -> str:
        """A new file's path; names that begin with a dot are no data to Spark's readers."""
        os.makedirs(f"{self.folder}/staged", exist_ok=True)
        return f"{self.folder}/staged/{uuid.uuid4().hex}{suffix}"

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for path, _ in m.files if isinstance(m, StagedFiles) else ():
                if os.path.exists(path):
                    os.remove(path)


class CacheWriter(_Staging):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        path, out, done = self.staged(".parquet"), None, []
        try:
            for batch in iterator:
                if out is None:
                    out, done = pq.ParquetWriter(path, batch.schema), [(path, os.path.basename(path))]
                out.write_batch(batch)
        finally:
            if out is not None:
                out.close()
        return StagedFiles(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [name for m in messages if isinstance(m, StagedFiles) for _, name in m.files]
        os.makedirs(f"{self.folder}/commits", exist_ok=True)
        staged = f"{self.folder}/commits/.{uuid.uuid4().hex}"
        with open(staged, "w") as f:
            json.dump({"version": time.time_ns(), "files": files}, f)
        os.rename(staged, f"{self.folder}/commits/{uuid.uuid4().hex}.json")


class ArrayWriter(_Staging):
    """Rows (folder, name, idx, values, rows, width) in order, an array's together; its header says how many there are."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, out, now, left = [], None, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            places = list(zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist()))
            rows, width, values = batch.column("rows").to_pylist(), batch.column("width").to_pylist(), batch.column("values")
            for i, place in enumerate(places):
                if place != now:
                    if left:
                        raise ValueError(f"{now}: {left} rows are missing")
                    if out:
                        out.close()
                    now, left = place, rows[i]
                    done.append((self.staged(".npy"), f"{place[0]}/{place[1]}.npy"))
                    out = open(done[-1][0], "wb")  # noqa: SIM115  closed when the next array begins
                    np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (rows[i], width[i])})
                row = np.array(values[i].as_py(), "<f8")
                if len(row) != width[i]:
                    raise ValueError(f"{now}: rows of {len(row)} and of {width[i]} numbers")
                out.write(row.tobytes())
                left -= 1
        if out:
            out.close()
        return StagedFiles(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged = [f for m in messages if isinstance(m, StagedFiles) for f in m.files]
        with ThreadPoolExecutor(COMMITTERS) as pool:  # file calls wait for the file system, not for one another
            list(pool.map(lambda home: os.makedirs(home, exist_ok=True), {os.path.dirname(f"{self.folder}/{place}") for _, place in staged}))
            list(pool.map(lambda f: os.replace(f[0], f"{self.folder}/{f[1]}"), staged, chunksize=1_000))


class LineWriter(_Staging):
    """Rows (place, line) in order, a file's together; each line ends with a line end."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, out, now = [], None, None
        for batch in iterator:
            for place, line in zip(batch.column("place").to_pylist(), batch.column("line").to_pylist()):
                if place != now:
                    if out:
                        out.close()
                    now = place
                    done.append((self.staged(".lines"), place))
                    out = open(done[-1][0], "w", encoding="utf-8")  # noqa: SIM115  closed when the next file begins
                out.write(f"{line}\n")
        if out:
            out.close()
        return StagedFiles(done)

    commit = ArrayWriter.commit


class LineFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_files"

    def writer(self, schema: StructType, overwrite: bool) -> _Staging:
        return LineWriter(self.options)


class PublishedCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published_cache"

    def writer(self, schema: StructType, overwrite: bool) -> _Staging:
        return CacheWriter(self.options)


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_files"

    def writer(self, schema: StructType, overwrite: bool) -> _Staging:
        return ArrayWriter(self.options)


def publish(entries: DataFrame, path: str, value: str = "value", best_effort: bool = True) -> bool:
    """Commits the entries of one job to a cache, all or none, and says whether it did; entries without a value are not written.

    With `best_effort` a failure is only reported, as the work that the entries come from must not depend on the cache.
    """
    entries.sparkSession.dataSource.register(PublishedCache)
    try:
        entries.filter(F.col(value).isNotNull()).write.format("published_cache").mode("append").save(path)
    except PySparkException:
        if not best_effort:
            raise
        return False
    return True


def published(spark: SparkSession, path: str, key: str, schema: str | StructType) -> DataFrame:
    """The entries of a cache, of each key the last that was committed; `schema` is that of what was published. None in a new cache."""
    if not os.path.isdir(f"{plain_path(path)}/commits"):
        return spark.createDataFrame([], schema)
    commits = spark.read.schema(COMMIT).json(f"{path}/commits").select("version", F.explode("files").alias("cadenza__file"))
    staged = spark.read.schema(schema).parquet(f"{path}/staged")
    rows = staged.select(F.struct(*staged.columns).alias("row"), F.col("_metadata.file_name").alias("cadenza__file")).join(commits, "cadenza__file")
    return rows.groupBy(F.col(f"row.{key}").alias("cadenza__key")).agg(F.max_by("row", F.struct("version", "cadenza__file")).alias("row")).select("row.*")


def subtitle_files(segments: DataFrame, path: str, file: str, start: str, end: str, text: str, width: int = 3_600_000) -> None:
    """`<file>.txt`, `.vtt` and `.srt` below `path` of the segments of each file in the order of `start`, all files of a job or none.

    Times are whole milliseconds, of which `width` make a slice; equal starts go by end, then text. A null text is an empty one.
    """
    segments.sparkSession.dataSource.register(LineFiles)
    rows = numbered(segments.select(F.col(file).alias("file"), F.col(start).alias("at"), F.col(end).alias("to"), F.coalesce(F.col(text), F.lit("")).alias("text")), Timeline(("file",), ("at", "to", "text"), width))
    begin, stop = F.col("at") / 1000, F.col("to") / 1000
    forms = {"txt": forms_of.strip(F.col("text")), "vtt": forms_of.vtt_block(begin, stop, F.col("text")), "srt": forms_of.srt_block(F.col("idx") + 1, begin, stop, F.col("text"))}
    lines = rows.select("file", "idx", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("line")) for k, v in forms.items()])).alias("l")).select("file", "idx", "l.*")
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("idx"), F.lit("vtt").alias("form"), F.lit("WEBVTT\n").alias("line"))
    placed = lines.unionByName(heads).select(F.concat("file", F.lit("."), "form").alias("place"), "idx", "line")
    placed.repartition("place").sortWithinPartitions("place", "idx").write.format("line_files").mode("append").save(path)


def dump_arrays(df: DataFrame, path: str) -> None:
    """`.npy` files `<folder>/<name>.npy` below `path`, of (folder, name, idx, values): rows of one width in the order of idx.

    `sources.files.arrays` reads them back. A file is written by one task, a row at a time; rows of unlike width are an error, and then
    no file of the dump appears.
    """
    df.sparkSession.dataSource.register(ArrayFiles)
    sizes = df.groupBy("folder", "name").agg(F.count("*").alias("rows"), F.max(F.size("values")).alias("width"))
    rows = df.select("folder", "name", "idx", F.col("values").cast("array<double>").alias("values")).join(sizes, ["folder", "name"])
    rows.repartition("folder", "name").sortWithinPartitions("folder", "name", "idx").write.format("npy_files").mode("append").save(path)

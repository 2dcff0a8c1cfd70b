"""Sources: job documents, artifact listings, transcripts and detection caches, read with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import plain_path

#: Files, and rows of arrays, of a batch.
FILES, ROWS = 256, 10_000
VIDEO = [".mp4", ".mov", ".webm", ".mkv", ".m4v"]
CACHE_VERSION = 2

STAGE = "struct<name:string,status:string,duration_ms:bigint,output:string,error:string,progress:double,eta_seconds:double>"
JOBS = f"""job_id string, status string, current_stage string, target_language string, source_language string, lipsync_backend string,
tts_backend string, lipsync_quality map<string,string>, enable_stabilization boolean, enable_output_stabilization boolean,
source_duration_seconds double, input_filename string, created_at timestamp, completed_at timestamp, error string, stages array<{STAGE}>"""
WORD = "struct<start:double,end:double,text:string>"
TRANSCRIPTS = f"""job_id string, language string, language_probability double, duration double, text string, first_speech_seconds double,
segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>"""
DETECTIONS = "schema int, detector string, video string, frames array<struct<index:bigint,bbox:array<int>,score:double,kps:array<array<double>>>>"


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job documents, one JSON file each; what a document lacks is null, its stages an empty list."""
    return spark.read.schema(JOBS).json(path, multiLine=True).withColumn("stages", F.coalesce("stages", F.array().cast(f"array<{STAGE}>")))


def stages(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", F.posexplode("stages").alias("pos", "stage")).select("job_id", "pos", "stage.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPTS).json(path, multiLine=True)


def segments(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("job_id", F.posexplode("segments").alias("pos", "segment")).select("job_id", "pos", "segment.start", "segment.end", "segment.text", "segment.words")


def detections(documents: DataFrame, column: str = "value") -> DataFrame:
    """clip, idx, bbox, score, kps of cached detections in JSON texts; other versions and bad texts are misses."""
    doc = F.from_json(column, DETECTIONS, {"mode": "PERMISSIVE"})
    held = documents.select(doc.alias("d")).filter(F.col("d.schema") == CACHE_VERSION)
    return held.select(F.col("d.video").alias("clip"), F.explode("d.frames").alias("f")).select("clip", F.col("f.index").alias("idx"), "f.bbox", "f.score", "f.kps")


def artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length, modified of the files below a folder, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def safe_name(c: Column) -> Column:
    """True for a bare file name: no separators, no leading dot."""
    return ~c.rlike(r"[/\\]") & ~c.startswith(".") & (c != "")


def uploads(files: DataFrame, most_bytes: int) -> DataFrame:
    """`files` plus reject_reason: extension, size, or null."""
    from ..functions.text import extension
    from ..operators.routing import first_failure

    return files.withColumn("reject_reason", first_failure([("extension", ~extension(F.col("name")).isin(VIDEO)), ("size", F.col("length") > most_bytes)]))


# The arrays that a smoothing run leaves behind.
DUMPS = ["affines_pre_smooth", "affines_post_smooth", "boxes_pre_smooth", "boxes_post_smooth"]


def texts(places: DataFrame, path: str) -> DataFrame:
    """name, text of the files that `places` (name) tells below a mounted folder: each is opened where its name is, and no folder is listed.

    A file that is not there is an error.
    """
    home = plain_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, FILES):
                names, found = batch.column("name").slice(a, FILES), []
                for name in names.to_pylist():
                    with open(f"{home}/{name}", encoding="utf-8", newline="") as f:
                        found.append(f.read())
                yield pa.RecordBatch.from_arrays([names, pa.array(found, pa.string())], ["name", "text"])

    return places.select("name").mapInArrow(run, "name string, text string")


def arrays_of(folders: DataFrame, path: str, names: list[str] = DUMPS) -> DataFrame:
    """As `arrays`, of the folders that `folders` (folder) tells below a mounted one, which is not listed."""
    home = plain_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("folder", pa.string()), ("name", pa.string()), ("idx", pa.int64()), ("values", pa.list_(pa.float64()))])
        for batch in batches:
            out: list[tuple] = []
            for folder in batch.column("folder").to_pylist():
                for name in names:
                    try:
                        array = np.atleast_1d(np.load(f"{home}/{folder}/{name}.npy", allow_pickle=False)).astype(float)
                    except (FileNotFoundError, ValueError, EOFError):
                        continue
                    rows = array.reshape(len(array), -1)
                    for a in range(0, len(rows), ROWS):
                        part = rows[a : a + ROWS]
                        ends = pa.array(np.arange(0, part.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(part) + 1])
                        out.append((folder, name, np.arange(a, a + len(part)), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))))
                        if sum(len(x[2]) for x in out) >= ROWS:
                            yield joined(out, schema)
                            out = []
            if out:
                yield joined(out, schema)

    def joined(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        size = [len(x[2]) for x in out]
        columns = [pa.array(np.repeat(np.array([x[k] for x in out], object), size), pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([x[2] for x in out])), pa.concat_arrays([x[3] for x in out])], schema=schema)

    return folders.select("folder").mapInArrow(run, "folder string, name string, idx long, values array<double>")


def arrays(spark: SparkSession, path: str, names: list[str] = DUMPS) -> DataFrame:
    """folder, name, idx, values: each first-axis row of the `.npy` files of these names below a folder, flattened.

    Files that are not there are left out; a file that is no array of numbers is skipped.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(names)}}}.npy").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                try:
                    array = np.atleast_1d(np.load(BytesIO(content), allow_pickle=False)).astype(float)
                except (ValueError, EOFError):
                    continue
                folder, _, name = where.rpartition("/")
                rows = list(array.reshape(len(array), -1))
                yield pd.DataFrame({"folder": folder, "name": name.removesuffix(".npy"), "idx": np.arange(len(rows)), "values": rows})

    return found.select("path", "content").mapInPandas(run, "folder string, name string, idx long, values array<double>")

"""Queries that run as streams over the `events` table until all of it is read, written to the shared folder and read back.

Jobs are users, stages are event types; a stream ends by itself and keeps nothing in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_path
from ..streaming import events as ev
from .registry import query, six


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of job events (EVENTS); a purchase ends a job."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name one file
    kind = F.when(F.col("event_type") == "purchase", "job_completed").when(F.col("event_type") == "view", "stage_progress").otherwise("stage_started")
    return rows.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.col("event_type").alias("stage"), (F.col("value") / 100).alias("percent"))


def finished(stream: DataFrame, name: str, mode: str = "append", clock: bool = False) -> DataFrame:
    """Runs a stream until it has read what there is and reads its output; a whole result takes the place of the one before.

    With `clock` it is one batch, as timeouts by the machine's clock would keep a stream that runs until nothing is left from ending.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(**({"once": True} if clock else {"availableNow": True}))
    if mode == "append":
        running = writer.format("parquet").option("path", out).start()
    else:
        running = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS stage, max(event_id) AS seq, CASE event_type WHEN 'purchase' THEN 'job_completed' WHEN 'view' THEN 'stage_progress' ELSE 'stage_started' END AS event, round(arg_max(value, event_id) / 100, 6) AS percent FROM events GROUP BY user_id, event_type""")
def stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = finished(ev.stage_board(stream_of(spark, sf_dir)), "stage-board", "complete")
    return board.select("job_id", "stage", "seq", "event", six(F.col("percent")).alias("percent"))


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, and taken once."""
    rows = stream_of(spark, sf_dir)
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return finished(ev.deduplicated(twice), "events-once").select("job_id", "seq")


@query("""WITH E AS (SELECT user_id, event_id, event_type, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS stop FROM events)
SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'purchase' THEN 'job_completed' WHEN 'view' THEN 'stage_progress' ELSE 'stage_started' END AS event, count(*) AS n FROM E WHERE stop IS NULL OR event_id <= stop GROUP BY ALL""")
def stream_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = finished(ev.with_heartbeats(stream_of(spark, sf_dir), 3_600_000), "heartbeats", clock=True)
    return sent.filter("event <> 'ping'").groupBy("job_id", "event").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE E AS (SELECT user_id, greatest(0, least(1, value / 100)) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'view'),
R AS (SELECT user_id, rn, p, p AS seen, CASE WHEN p >= 0.02 THEN p ELSE 0 END AS last, p >= 0.02 AS ok FROM E WHERE rn = 1
  UNION ALL SELECT E.user_id, E.rn, E.p, greatest(seen, E.p), CASE WHEN E.p >= seen AND (E.p - last >= 0.02 OR E.p >= 1) THEN E.p ELSE last END, E.p >= seen AND (E.p - last >= 0.02 OR E.p >= 1)
  FROM R JOIN E ON E.user_id = R.user_id AND E.rn = R.rn + 1)
SELECT CAST(user_id AS VARCHAR) AS job_id, 'view' AS stage, round(p, 6) + 0.0 AS percent FROM R WHERE ok""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = finished(ev.emitted_progress(stream_of(spark, sf_dir)), "progress", clock=True)
    return sent.select("job_id", "stage", six(F.col("percent")).alias("percent"))

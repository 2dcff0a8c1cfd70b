"""What goes in and out by files, bytes and clocks: progress files, server-sent events, published caches, array dumps, documents,
timers, and selection over score rows. Queries write below the shared folder and read back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sse
from ..operators import hypotheses, jobs, nearest
from ..operators.ordered import Timeline
from ..operators.shared import plain_path, shared_path
from ..sinks import files as out
from ..sinks import published
from ..sources import files, progress
from ..streaming import timers
from .registry import query, six, table
from .streams import finished, stream_of
from .timeline import KEYS, frames

WAVES = 3


def _progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phase"), (F.col("value") / 100).alias("percent"))


@query(f"""WITH R AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % {WAVES} DESC, event_id DESC) AS r FROM events)
SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS phase, round(value / 100, 6) + 0.0 AS percent FROM R WHERE r = 1""")
def progress_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs overwrite their progress files in three waves; a stream that is stopped after each of them and started again follows.

    Beside them lies a file that is never written to its end.
    """
    folder, seen, state = (shared_path(spark, f"progress-{k}") for k in ("files", "seen", "state"))
    rows = _progress_rows(spark, sf_dir)
    half = f"{plain_path(folder)}/half"
    for wave in range(WAVES):
        progress.overwrite_progress(rows.filter(F.col("seq") % WAVES == wave), folder, "seq")
        if wave == 0:
            os.makedirs(half, exist_ok=True)
            with open(f"{half}/{progress.FILE}", "w") as f:
                f.write('{"phase": "denoise", "perc')
        followed = progress.progress_stream(spark, folder).writeStream.format("parquet").option("path", seen).option("checkpointLocation", state).trigger(availableNow=True).start()
        followed.awaitTermination()
    last = progress.latest_progress(spark.read.parquet(seen))
    return last.select("job_id", "phase", six(F.col("percent")).alias("percent"))


CHUNK = 7


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n, CAST(event_id AS VARCHAR) AS id,
CASE event_type WHEN 'view' THEN 'stage_progress' WHEN 'purchase' THEN 'message' ELSE event_type END AS event,
CASE WHEN event_id % 3 = 0 THEN props || chr(10) || 'é: ' || event_type ELSE props END AS data FROM events""")
def sse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as frames, some after a comment, cut into pieces of seven bytes and parsed again."""
    c = F.col
    rows = table(spark, sf_dir, "events")
    name = F.when(c("event_type") == "view", "stage_progress").when(c("event_type") != "purchase", c("event_type"))
    data = F.when(c("event_id") % 3 == 0, F.concat("props", F.lit("\r\né: "), "event_type")).otherwise(c("props"))
    wire = F.concat(F.when(c("event_id") % 4 == 0, ": a comment\n\n").otherwise(""), sse.frame(name, data, c("event_id"))).cast("binary")
    bytes_ = rows.select("user_id", "event_id", wire.alias("wire"))
    at = F.explode(F.sequence(F.lit(1), F.octet_length("wire"), F.lit(CHUNK)))
    chunks = bytes_.withColumn("at", at).select("user_id", (c("event_id") * 1_000_000 + c("at")).alias("seq"), F.substring("wire", c("at"), F.lit(CHUNK)).alias("chunk"))
    return sse.parsed(chunks, ("user_id",), "seq", "chunk")


@query("""WITH C AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS last FROM events GROUP BY user_id)
SELECT user_id, event_id, event_id % 2 = 0 AS listed FROM events JOIN C USING (user_id) WHERE last IS NULL OR event_id > last""")
def sse_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients still have to be sent that have seen a user's last signup."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    clients = rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("last"))
    return sse.resumed(rows, clients, KEYS, "event_id", "last").select("user_id", "event_id", (F.col("event_id") % 2 == 0).alias("listed"))


@query("""WITH K AS (SELECT doc_id, substr(sha256(coalesce(text, '') || '|' || coalesce(lang, '')), 1, 16) AS key FROM documents),
A AS (SELECT key, min(doc_id) AS v FROM K WHERE doc_id % 3 = 0 GROUP BY key), B AS (SELECT key, max(doc_id) + 1000000 AS v FROM K WHERE doc_id % 4 = 0 GROUP BY key)
SELECT K.doc_id, CASE WHEN doc_id % 10 = 7 THEN 'disabled' WHEN coalesce(B.v, A.v) IS NULL THEN 'miss' ELSE 'hit' END AS outcome, CASE WHEN doc_id % 10 <> 7 THEN coalesce(B.v, A.v) END AS held
FROM K LEFT JOIN A USING (key) LEFT JOIN B USING (key)""")
def cache_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs publish entries, the later of which win, and a third one dies while it writes, which leaves nothing; then all texts are looked up."""
    folder, schema = shared_path(spark, "cache"), "key string, value long"
    rows = table(spark, sf_dir, "documents").select("doc_id", jobs.content_key([F.col("text"), F.col("lang")]).alias("key"))
    published.publish(rows.filter("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("value")), folder, best_effort=False)
    published.publish(rows.filter("doc_id % 4 = 0").groupBy("key").agg((F.max("doc_id") + 1_000_000).alias("value")), folder, best_effort=False)
    dies = F.when(F.col("doc_id") % 50 == 49, F.raise_error(F.lit("a task dies"))).otherwise(F.lit(-1)).cast("long")
    if published.publish(rows.select("key", dies.alias("value")), folder):
        raise AssertionError("a failed job was published")
    held = published.published(spark, folder, "key", schema).withColumnRenamed("value", "held")
    return jobs.cached(rows, held, "key", "held", F.col("doc_id") % 10 != 7).select("doc_id", "outcome", "held")


_DUMPED = """SELECT user_id, idx, CASE WHEN event_id % 7 <> 0 THEN value ELSE -1 END AS x, CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) ELSE -1 END AS y
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events)"""


@query(f"""WITH D AS ({_DUMPED}) SELECT user_id, 'boxes_pre_smooth' AS name, idx, round(x, 6) + 0.0 AS first, round(x + y, 6) + 0.0 AS total FROM D
UNION ALL SELECT user_id, 'affines_post_smooth', idx, round(y, 6) + 0.0, round(3 * y, 6) + 0.0 FROM D WHERE user_id % 2 = 0""")
def array_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and affines of every clip as `.npy` files, read back; clips of odd users leave no affines."""
    folder = shared_path(spark, "dumps")
    x, y = (F.coalesce(F.col(c), F.lit(-1.0)) for c in ("x", "y"))
    rows = frames(spark, sf_dir).select(F.col("user_id").cast("string").alias("folder"), "user_id", "idx", x.alias("x"), y.alias("y"))
    boxes = rows.select("folder", F.lit("boxes_pre_smooth").alias("name"), "idx", F.array("x", "y").alias("values"))
    affines = rows.filter("user_id % 2 = 0").select("folder", F.lit("affines_post_smooth").alias("name"), "idx", F.array("y", "y", "y").alias("values"))
    published.dump_arrays(boxes.unionByName(affines), folder)
    back = files.arrays_of(rows.select("folder").distinct(), folder)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return back.select(F.col("folder").cast("long").alias("user_id"), "name", "idx", six(F.col("values")[0]).alias("first"), six(total).alias("total"))


IDLE = 12 * 3_600_000


@query(f"""WITH E AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS t FROM events), L AS (SELECT user_id, min(struct_pack(t := t, i := event_id)) AS stop FROM E WHERE event_type = 'purchase' GROUP BY user_id),
K AS (SELECT E.*, stop FROM E LEFT JOIN L USING (user_id) WHERE stop IS NULL OR (t, event_id) <= (stop.t, stop.i)),
G AS (SELECT user_id, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), CASE WHEN stop IS NULL THEN (SELECT max(t) + 1 FROM E) END) AS upto FROM K)
SELECT CAST(user_id AS VARCHAR) AS job_id, 'ping' AS event, unnest(range(t + {IDLE}, upto, {IDLE})) AS at_ms FROM G WHERE upto IS NOT NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), CASE event_type WHEN 'purchase' THEN 'job_completed' WHEN 'view' THEN 'stage_progress' ELSE 'stage_started' END, t FROM K""")
def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of users up to their first purchase, and a ping for each twelve hours of silence."""
    with timers.state_store(spark):
        return finished(timers.with_heartbeats(stream_of(spark, sf_dir), IDLE), "timed-heartbeats")


EVERY, ETA = 6 * 3_600_000, 480 * 3_600


@query(f"""WITH E AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS t FROM events), J AS (SELECT user_id, min(t) AS s, max(t) AS e FROM E GROUP BY user_id), T AS (SELECT user_id, s, unnest(range(s + {EVERY}, e, {EVERY})) AS tick FROM J),
R AS (SELECT user_id, t, arg_max((event_id % 100) / 100.0::DOUBLE, event_id) AS p FROM E WHERE event_type = 'view' GROUP BY user_id, t)
SELECT CAST(T.user_id AS VARCHAR) AS job_id, tick AS at_ms, round(least(0.99::DOUBLE, coalesce(R.p, (tick - s) / 1000 / {ETA}::DOUBLE)), 6) + 0.0 AS percent FROM T ASOF LEFT JOIN R ON T.user_id = R.user_id AND T.tick >= R.t""")
def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ticker says of users every six hours between their first and last event; views report a share."""
    ends = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))).alias("end"))
    rows = stream_of(spark, sf_dir).join(ends, "job_id")
    kind = F.when((F.col("ts") == F.col("end.ts")) & (F.col("seq") == F.col("end.seq")), "stage_completed").when(F.col("event") == "stage_progress", "stage_progress").otherwise("stage_started")
    told = rows.select("job_id", "seq", "ts", kind.alias("event"), "stage", (F.col("seq") % 100 / F.lit(100.0)).alias("percent"), F.lit(float(ETA)).alias("eta_seconds"))
    with timers.state_store(spark):
        said = finished(timers.with_ticks(told, EVERY), "timed-ticks")
    return said.select("job_id", "at_ms", six(F.col("percent")).alias("percent"))


@query("""WITH D AS (SELECT a.vec_id, b.vec_id AS code, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS d FROM embeddings a, embeddings b WHERE b.vec_id % 2 = 1)
SELECT vec_id, CAST(arg_min(code, struct_pack(d := round(d, 9), c := code)) AS BIGINT) AS code FROM D GROUP BY vec_id""")
def nearest_code_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of half of all vectors to each vector, by pivots."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    book = rows.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("own"), "embedding")
    return nearest.nearest_by_pivots(rows, book, "vec_id", "own", "embedding", pivots=64)


BEAMS, END = 3, 0


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, step, beam, token, logprob: a clip's frames as scores, five for each open hypothesis."""
    rows = frames(spark, sf_dir).filter("c is not null")
    return rows.select("user_id", F.expr("idx div 15").alias("step"), (F.col("idx") % BEAMS).cast("int").alias("beam"), (F.col("c") % 7).alias("token"), (-(F.col("c") % 1009) / F.lit(64.0) - F.col("idx") % 5).alias("logprob"))


@query()
def beam_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = hypotheses.selected(score_rows(spark, sf_dir), "user_id", "step", "beam", "token", "logprob", BEAMS, END, 2.0)
    return best.select("user_id", "rank", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"), six(F.col("sum_logprob")).alias("sum_logprob"), "ended")


STAMPS, TEXT_END, BLANK, SUPPRESSED, LATEST = 60, 50, [3], [7, 8], 20


@query(f"""WITH T AS (SELECT user_id, event_id, (event_id * 37 + user_id) % 100 AS token, row_number() OVER w - 1 AS idx, lag((event_id * 37 + user_id) % 100) OVER w AS one, lag((event_id * 37 + user_id) % 100, 2) OVER w AS two
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
M AS (SELECT *, coalesce(one >= {STAMPS}, false) AS after, idx < 2 OR two >= {STAMPS} AS pair FROM T), X AS (SELECT *, after AND pair AS stamps, after AND NOT pair AS texts FROM M)
SELECT user_id, event_id, texts AS text_masked, stamps AS timestamps_masked, CASE WHEN token IN (7, 8) THEN 'suppressed' WHEN idx = 0 AND token IN (3, {TEXT_END}) THEN 'blank' WHEN idx = 0 AND token > {STAMPS + LATEST} THEN 'late start'
  WHEN texts AND token < {TEXT_END} THEN 'text' WHEN stamps AND token >= {STAMPS} THEN 'timestamp' END AS broken FROM X""")
def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 37 + F.col("user_id")) % 100).alias("token"))
    masked = hypotheses.timestamp_masks(rows, Timeline(KEYS, ("event_id",), 65_536), "token", STAMPS, TEXT_END)
    rule = hypotheses.broken_rule(F.col("idx"), F.col("token"), F.col("text_masked"), F.col("timestamps_masked"), STAMPS, TEXT_END, BLANK, SUPPRESSED, LATEST)
    return masked.select("user_id", "event_id", "text_masked", "timestamps_masked", rule.alias("broken"))


@query("""WITH S AS (SELECT l_orderkey, l_linenumber AS token, -l_discount * 10 AS p FROM lineitem)
SELECT l_orderkey, coalesce(ln(sum(exp(p)) FILTER (token >= 4)) > max(p) FILTER (token < 4) + 1e-12, count(*) FILTER (token >= 4) > 0) AS forced FROM S GROUP BY l_orderkey""")
def timestamp_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("token"), (-F.col("l_discount").cast("double") * 10 - F.when(F.col("l_linenumber") < 4, 0).otherwise(1e-12)).alias("p"))
    return hypotheses.timestamps_forced(rows, ["l_orderkey"], "token", "p", 4)


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, max(event_id) AS last, 'lipsynced.mp4' AS output_path, true AS passthrough FROM events WHERE user_id % 3 = 0 AND event_type <> 'error' GROUP BY user_id""")
def passthrough_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without a lip-sync backend hand their video on, with their provenance columns."""
    rows = table(spark, sf_dir, "events").withColumn("backend", F.when(F.col("user_id") % 3 == 0, "none").otherwise("wav2lip"))
    jobs_ = rows.groupBy(F.col("user_id").cast("string").alias("job_id"), "backend").agg(F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("last"))
    handed = out.passthrough(jobs_, "job_id", "last", "backend")
    folder = shared_path(spark, "passthrough")
    out.outputs(handed, folder)
    return spark.read.parquet(folder).select("job_id", "last", "output_path", "passthrough")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job documents of users: their event types as stages, in the order of their names; some users have none, or no status."""
    rows = table(spark, sf_dir, "events")
    stages = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    stage = F.struct(F.col("event_type").alias("name"), F.when(F.col("last") % 2 == 0, "done").otherwise("running").alias("status"), F.col("n").alias("duration_ms"))
    docs = stages.groupBy("user_id").agg(F.array_sort(F.collect_list(stage)).alias("stages"), F.sum("n").alias("n"))  # an event type each
    own = F.when(F.col("user_id") % 5 != 0, F.col("stages"))
    return docs.select(F.col("user_id").cast("string").alias("job_id"), F.when(F.col("user_id") % 4 != 0, "running").alias("status"), F.col("n").cast("double").alias("source_duration_seconds"), own.alias("stages"))


@query("""WITH S AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL), R AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INTEGER) AS pos, event_type AS name, CASE WHEN last % 2 = 0 THEN 'done' ELSE 'running' END AS stage_status, n AS duration_ms FROM S WHERE user_id % 5 <> 0),
D AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS seconds FROM events GROUP BY user_id)
SELECT CAST(D.user_id AS VARCHAR) AS job_id, CASE WHEN D.user_id % 4 <> 0 THEN 'running' END AS status, seconds, CAST(NULL AS VARCHAR) AS error, pos, name, stage_status, duration_ms FROM D LEFT JOIN R USING (user_id)""")
def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job documents written as JSON and read back with the defaults of what they lack, and their stages."""
    folder = shared_path(spark, "jobs")
    out.as_json(_documents(spark, sf_dir)).write.text(folder)
    docs = spark.read.schema(files.JOBS).json(folder).withColumn("stages", F.coalesce("stages", F.array().cast(f"array<{files.STAGE}>")))
    stages = files.stages(docs).select("job_id", "pos", "name", F.col("status").alias("stage_status"), "duration_ms")
    return docs.select("job_id", "status", F.col("source_duration_seconds").alias("seconds"), "error").join(stages, "job_id", "left").select("job_id", "status", "seconds", "error", "pos", "name", "stage_status", "duration_ms")


@query(r"""WITH D AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n') AS l FROM documents), S AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM D)
SELECT CAST(doc_id AS VARCHAR) AS job_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(pos AS DOUBLE) AS start, text, len(string_split(text, ' ')) AS words FROM S""")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as the segments of transcripts, written as JSON and read by the next stage."""
    rows = table(spark, sf_dir, "documents")
    words = lambda t: F.transform(F.split(t, " "), lambda w: F.struct(F.lit(None).cast("double").alias("start"), w.alias("text")))
    segments = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct((i + 1).cast("double").alias("start"), (i + 2).cast("double").alias("end"), t.alias("text"), words(t).alias("words")))
    folder = shared_path(spark, "transcripts")
    out.as_json(rows.select(F.col("doc_id").cast("string").alias("job_id"), F.col("lang").alias("language"), segments.alias("segments"))).write.text(folder)
    back = files.segments(spark.read.schema(files.TRANSCRIPTS).json(folder))
    return back.select("job_id", "pos", "start", "text", F.size("words").cast("long").alias("words"))


@query("""SELECT CAST(user_id AS VARCHAR) AS clip, idx, CAST(event_id % 300 AS INTEGER) AS x1, CASE WHEN event_id % 7 <> 0 THEN value / 100 END AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events) WHERE user_id % 4 > 1""")
def detection_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of clips as cached documents: of a quarter of the clips the version is old, of another the text is cut off."""
    rows = frames(spark, sf_dir)
    box = F.array(*[(F.col("event_id") % 300 + k).cast("int") for k in (0, 10, 50, 90)])
    frame = F.struct(F.col("idx").alias("index"), box.alias("bbox"), (F.col("x") / 100).alias("score"))
    docs = rows.groupBy("user_id").agg(F.collect_list(frame).alias("frames"))  # one document holds one clip
    doc = F.to_json(F.struct(F.when(F.col("user_id") % 4 == 0, 1).otherwise(files.CACHE_VERSION).alias("schema"), F.lit("faces").alias("detector"), F.col("user_id").cast("string").alias("video"), "frames"))
    cut = F.when(F.col("user_id") % 4 == 1, F.substring(doc, F.lit(1), F.length(doc) - 3)).otherwise(doc)
    return files.detections(docs.select(cut.alias("value"))).select("clip", "idx", F.col("bbox")[0].alias("x1"), "score")


@query("""WITH L AS (SELECT user_id, CAST(sum(length(event_type) + 1) - 1 AS BIGINT) AS n FROM events GROUP BY user_id)
SELECT 'job-' || user_id || CASE WHEN user_id % 3 = 0 THEN '.mp4' ELSE '.txt' END AS name, n AS length, true AS safe, CASE WHEN user_id % 3 <> 0 THEN 'extension' WHEN n > 400 THEN 'size' END AS reject_reason FROM L""")
def artifact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of its event types for each user, listed without being read, and which of them could be uploaded again."""
    folder = shared_path(spark, "artifacts")
    home = plain_path(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            os.makedirs(home, exist_ok=True)
            for name, text in zip(pdf["name"], pdf["text"]):
                with open(f"{home}/{name}", "w") as f:
                    f.write(text)
            yield pd.DataFrame({"n": [len(pdf)]})

    name = F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, ".mp4").otherwise(".txt"))
    texts = table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.array_join(F.collect_list("event_type"), "\n").alias("text"))  # a file is one text
    texts.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    listed = files.uploads(files.artifacts(spark, folder), 400)
    return listed.select("name", "length", files.safe_name(F.col("name")).alias("safe"), "reject_reason")


@query("""WITH D AS (SELECT doc_id, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n FROM documents)
SELECT 'tsv' AS form, lang || chr(9) || count(*) || chr(9) || sum(n) AS line FROM D GROUP BY lang
UNION ALL SELECT 'json', '{"lang":"' || lang || '","n":' || count(*) || ',"chars":' || sum(n) || '}' FROM D GROUP BY lang""")
def report_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures as a TSV list and as JSON, as they stand in the files written."""
    rows = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    tsv, json = shared_path(spark, "report-tsv"), shared_path(spark, "report-json")
    out.tsv(rows, tsv)
    out.as_json(rows).write.text(json)
    both = [spark.read.text(path).select(F.lit(form).alias("form"), F.col("value").alias("line")) for form, path in (("tsv", tsv), ("json", json))]
    return both[0].unionByName(both[1])


@query("""WITH E AS (SELECT count(value) AS n, avg(value) AS m, max(value) AS x FROM events), L AS (SELECT [('mean', m), ('max', x)] AS l FROM E)
SELECT CAST(0 AS INTEGER) AS pos, 'Values' AS text UNION ALL SELECT 1, '  mean:  ' || lpad(printf('%.2f', m), 8, ' ') || '   max:   ' || lpad(printf('%.2f', x), 8, ' ') FROM E UNION ALL SELECT 2, '  none:         -' """)
def readable_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "events").agg(F.avg("value").alias("m"), F.max("value").alias("x"), F.lit(None).cast("double").alias("nothing"))
    return out.stability_report(stats, {"mean": "m", "max": "x", "none": "nothing"}, "Values")


@query("""WITH G AS (SELECT l_orderkey, l_linenumber, max(l_quantity) / 10 AS ratio, -20 * max(l_discount) AS p, max(l_tax) * 10 AS quiet FROM lineitem GROUP BY ALL),
R AS (SELECT l_orderkey, (l_linenumber - 1) * 0.2::DOUBLE AS t, ratio > 2.4 OR p < -1 AS failed, quiet > 0.6 AND p < -1 AS silent FROM G)
SELECT l_orderkey, round(arg_min(t, o), 6) + 0.0 AS temperature, arg_min(failed, o) AS failed, arg_min(silent, o) AS silent FROM (SELECT *, struct_pack(f := failed, t := CASE WHEN failed THEN -t ELSE t END) AS o FROM R) GROUP BY l_orderkey""")
def temperature_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the results of an order's decodings at rising temperatures."""
    c = lambda n: F.col(n).cast("double")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(n).alias(n) for n in ("l_quantity", "l_discount", "l_tax")])
    rows = lines.select("l_orderkey", ((F.col("l_linenumber") - 1) * F.lit(0.2)).alias("t"), (c("l_quantity") / 10).alias("ratio"), (-20 * c("l_discount")).alias("p"), (c("l_tax") * 10).alias("quiet"))
    best = hypotheses.accepted(rows, ["l_orderkey"], "t", "ratio", "p", "quiet")
    return best.select("l_orderkey", six(F.col("t")).alias("temperature"), "failed", "silent")


_AT = lambda ms, mark: f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"
_BLOCK = lambda head, mark: f"string_agg({head}{_AT('a', mark)} || ' --> ' || {_AT('b', mark)} || chr(10) || t || chr(10) || chr(10), '' ORDER BY n)"


@query(f"""WITH S AS (SELECT user_id, event_type || ' -> ' || event_id AS t, 3600000 + event_id * 1000 AS a, 3600500 + event_id * 1000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
F AS (SELECT user_id, string_agg(replace(t, ' -> ', ' --> ') || chr(10), '' ORDER BY n) AS txt, 'WEBVTT' || chr(10) || chr(10) || {_BLOCK('', '.')} AS vtt, {_BLOCK("n || chr(10) || ", ',')} AS srt FROM S GROUP BY user_id)
SELECT user_id || '.txt' AS name, txt AS text FROM F UNION ALL SELECT user_id || '.vtt', vtt FROM F UNION ALL SELECT user_id || '.srt', srt FROM F""")
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments, a second apart from the first hour on, in the three forms of subtitle files."""
    folder = shared_path(spark, "subtitles")
    start = 3_600_000 + F.col("event_id") * 1000
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), start.alias("start"), (start + 500).alias("end"), F.concat(F.lit(" "), "event_type", F.lit(" --> "), F.col("event_id").cast("string"), F.lit(" ")).alias("text"))
    published.subtitle_files(rows, folder, "file", "start", "end", "text")
    forms = F.explode(F.array(*map(F.lit, published.FORMS)))
    return files.texts(rows.select("file").distinct().select("file", forms.alias("form")).select(F.concat("file", F.lit("."), "form").alias("name")), folder)

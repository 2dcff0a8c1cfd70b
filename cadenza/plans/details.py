"""Queries of gates, texts, numbers, faces, caches and access rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal, text
from ..operators import faces, gather, jobs, ordered, routing, scans, series
from ..sources import files
from .registry import micros, query, six, table
from .timeline import FILLED, FRAMES, KEYS, SEGMENTS, Fr, emphasised, filled_frames, frames, points

_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' WHEN 'click' THEN 'running' ELSE 'queued' END"


def _status():
    pairs = {"purchase": "completed", "error": "failed", "signup": "cancelled", "click": "running"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.col("event_type")), F.lit("queued"))


def _pick(values: list, at):
    """The at-th of a list of constants, from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


@query(f"""WITH J AS (SELECT event_id AS i, {_STATUS} AS s FROM events), C AS (SELECT *, CASE WHEN i % 11 = 0 THEN 404 WHEN s IN ('completed', 'failed', 'cancelled') THEN 409 WHEN i % 3 = 0 THEN 404 ELSE 200 END AS code FROM J)
SELECT i AS event_id, CAST(code AS INTEGER) AS cancel_code, CASE WHEN code = 200 THEN 'cancelled' ELSE s END AS status, CASE WHEN s = 'completed' AND i % 2 = 0 AND i % 5 <> 0 THEN 'final-' || i || '.mp4' END AS result,
CASE i % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE i % 2 = 0 END OR i % 7 = 0 AS skipped, CAST(CASE s WHEN 'completed' THEN 0 WHEN 'failed' THEN 1 WHEN 'cancelled' THEN 3 ELSE 2 END AS INTEGER) AS exit_code FROM C""")
def job_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), F.col("s")
    rows = table(spark, sf_dir, "events").select("event_id", _status().alias("s"))
    code = jobs.cancel_outcome(i % 11 != 0, s, i % 3 != 0)
    path = F.when(i % 5 != 0, F.concat(F.lit("final-"), i.cast("string"), F.lit(".mp4")))
    asked = F.when(i % 3 == 0, False).when(i % 3 == 1, True)
    skip = jobs.skips_output_stabilising(F.coalesce(asked, i % 2 != 0), True, i % 7 != 0)
    return rows.select("event_id", code.alias("cancel_code"), jobs.cancelled(s, code).alias("status"), jobs.result_path(s, F.when(i % 2 == 0, "done").otherwise("skipped"), path).alias("result"), skip.alias("skipped"), jobs.exit_code(s).alias("exit_code"))


@query("""WITH P AS (SELECT event_id, event_type, value, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' ELSE 'failed' END AS s, CASE WHEN event_id % 4 <> 0 THEN (event_id % 50) / 50.0::DOUBLE END AS p, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 90 AS BIGINT) END AS obs FROM events),
B AS (SELECT *, coalesce(p, 0) AS d, coalesce('[' || repeat('#', CAST(floor(p * 16) AS INTEGER)) || repeat('.', 16 - CAST(floor(p * 16) AS INTEGER)) || '] ' || CAST(floor(p * 100) AS BIGINT) || '%', '') AS bar FROM P)
SELECT event_id, CASE s WHEN 'done' THEN CAST(floor(value * 1000 / 1000) AS BIGINT) || 's' WHEN 'running' THEN bar || CASE WHEN obs IS NOT NULL THEN '  ~' || obs || 's left' WHEN value <= 0 THEN '' WHEN d > 0 THEN '  ~' || CAST(greatest(0, floor(value * (1 - d))) AS BIGINT) || 's left*' ELSE '  ~' || CAST(floor(value) AS BIGINT) || 's ETA*' END
WHEN 'pending' THEN '~' || CAST(floor(value) AS BIGINT) || 's ETA' ELSE '' END AS side FROM B""")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "view", "running").when(kind == "click", "pending").otherwise("failed")
    side = signal.progress_side(status, kind, F.lit("view"), F.when(i % 4 != 0, (i % 50) / F.lit(50.0)), v * 1000, v, F.when(i % 5 == 0, i % 90))
    return table(spark, sf_dir, "events").select("event_id", side.alias("side"))


@query("""WITH R AS (SELECT o_custkey, o_orderkey % 8 AS pos, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS s FROM orders),
A AS (SELECT o_custkey, bool_and(s = 'done') AS ok FROM R GROUP BY o_custkey), F AS (SELECT o_custkey, first(o_orderkey ORDER BY pos, o_orderkey) AS running FROM R WHERE s = 'running' GROUP BY o_custkey)
SELECT o_custkey, ok, running FROM A LEFT JOIN F USING (o_custkey)""")
def running_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey") % 8, "o_orderkey").alias("pos"), F.col("o_orderkey").alias("running"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("s"))
    ok = jobs.all_ok(rows, ("o_custkey",), F.col("s") == "done")
    return ok.join(jobs.running_stage(rows, ("o_custkey",), "pos", "running", "s"), "o_custkey", "left")


@query("""WITH Q AS (SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM Q ORDER BY o_orderdate, o_orderkey LIMIT 4""")
def admitted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderdate")
    taken = jobs.admitted(queue, "o_orderkey", "o_orderdate", 4)
    return jobs.ranked(taken.withColumn("all", F.lit(1)), ("all",), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey", "place").select("o_orderkey", "place")


@query(r"""WITH T AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations), L AS (SELECT * FROM T WHERE length(t) >= 3)
SELECT conv_id, count(*) AS said, count(*) FILTER (turn % 2 = 0) AS both_times, count(*) FILTER (turn % 2 = 0) >= 3 AS enough, md5(string_agg(t, ' ' ORDER BY turn) FILTER (turn < 3)) AS preview FROM L GROUP BY conv_id""")
def segment_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip(F.coalesce("text", F.lit(""))).alias("t")).filter(F.length("t") >= 3)
    start, end = F.col("turn"), F.when(F.col("turn") % 2 == 0, F.col("turn") + 1)
    timed = F.count_if(start.isNotNull() & end.isNotNull())
    first = jobs.cap_per_key(rows.filter("turn < 3"), ("conv_id",), [F.col("turn")], 3)
    preview = first.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " ")).alias("preview"))
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("said"), timed.alias("both_times"), (timed >= 3).alias("enough"))
    return counts.join(preview, "conv_id", "left")


@query("""WITH E AS (SELECT event_id AS i, value AS v, 1 + event_id % 400 AS n FROM events)
SELECT i AS event_id, round(pow(10, (least(v, 90) - 60) * 0.05), 6) AS amp, round(least(0.9, v / 50)::DOUBLE * 0.3 + v * 0.7, 6) AS blended, round(2 + 1.5 * (v - 2), 6) AS guided, round(CASE WHEN v / 50 > 1 THEN 0.5 / (v / 50) * 0.95 ELSE 0.5 END::DOUBLE, 6) AS scaled,
CAST(least(31, greatest(3, CAST(floor(0.04 * n) AS BIGINT) + 1 - CAST(floor(0.04 * n) AS BIGINT) % 2)) AS BIGINT) AS kernel, round(0.3 * ((n - 1) * 0.5 - 1) + 0.8::DOUBLE, 6) AS sigma, CAST(floor(floor(sqrt(n * 100)) / 20) AS BIGINT) AS edge,
round(greatest(-1, least(1, (v / 50 - sqrt(0.36::DOUBLE) * 0.5) / sqrt(0.64::DOUBLE)))::DOUBLE, 6) AS origin, round(n / 25.0::DOUBLE, 6) AS seconds, CAST(n * 250 AS BIGINT) AS took,
CAST(n * 12 / 4 AS BIGINT) AS ratio, CAST(round(greatest(0, least(1, (v + 1) / 2)) * 255) AS INTEGER) AS byte, CASE WHEN n % 16 = 0 THEN NULL WHEN n % 8 <> 0 THEN 'not divisible by 8' ELSE 'steps not positive' END AS shape,
CAST((n * 16 + 1200 - 800) // 200 + CASE WHEN n * 16 % 200 = 0 THEN 1 ELSE 2 END AS BIGINT) AS frames, CAST(greatest(0, 40 - floor(n * 0.1)) AS BIGINT) AS x1, CAST(least(400, 40 + n + floor(n * 0.1)) AS BIGINT) AS x2, CAST((n * 16 // 200 + 1) * 200 - n * 16 AS BIGINT) AS filled FROM E""")
def media_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    n = (1 + i % 400).cast("long")
    half = lambda c: F.round(c, 6)
    grown = signal.expanded_box(F.lit(40), F.lit(40), 40 + n, 40 + n, 0.1, F.lit(400), F.lit(400))
    return table(spark, sf_dir, "events").select(
        "event_id", half(signal.amplitude(F.least(v, F.lit(90.0)) - 60)).alias("amp"), half(signal.blend(F.least(F.lit(0.9), v / 50), v, F.lit(0.3))).alias("blended"), half(signal.guided(F.lit(2.0), v, 1.5)).alias("guided"),
        half(signal.peak_scaled(F.lit(0.5), v / 50)).alias("scaled"), signal.odd_kernel(F.lit(0.04), n).alias("kernel"), half(signal.gaussian_sigma(n)).alias("sigma"), signal.edge_width(n * 100).alias("edge"),
        half(signal.unnoised(v / 50, F.lit(0.5), F.lit(0.64))).alias("origin"), half(signal.clip_seconds(n, F.lit(25.0))).alias("seconds"), signal.elapsed_ms(n / 8, n * 3 / 8).alias("took"), signal.whole_ratio(n * 12, F.lit(4)).alias("ratio"),
        signal.byte_range(signal.unit_range(v, -1.0, 1.0)).alias("byte"), signal.shape_error(n, n, F.when(n % 16 == 0, 1).otherwise(0)).alias("shape"), (signal.frame_count(n * 16, 800, 200)).alias("frames"), signal.last_padding(n * 16, 200).alias("filled"), grown["x1"].cast("long").alias("x1"), grown["x2"].cast("long").alias("x2"),
    )


@query(f"""WITH {Fr}, P AS (SELECT user_id, idx AS pos FROM Fr), C AS (SELECT unnest(range(0, 8)) AS i)
SELECT user_id, pos, 'halves' AS form, i AS channel, round(sin(pos * exp(-ln(10000.0::DOUBLE) / 7 * i)), 6) + 0.0 AS s, round(cos(pos * exp(-ln(10000.0::DOUBLE) / 7 * i)), 6) + 0.0 AS c FROM P, C
UNION ALL SELECT user_id, pos, 'turns', i, round(sin(pos * exp(2 * i * (-ln(10000.0::DOUBLE) / 16))), 6) + 0.0, round(cos(pos * exp(2 * i * (-ln(10000.0::DOUBLE) / 16))), 6) + 0.0 FROM P, C""")
def position_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of table row, of 16 channels, for the position of every frame."""
    rows = frames(spark, sf_dir).select("user_id", F.col("idx").alias("pos"))
    at = F.sequence(F.lit(0), F.lit(7))
    halves, turns = signal.sinusoids(F.col("pos"), 16, True), signal.sinusoids(F.col("pos"), 16, False)
    pair = lambda t, s, c: F.transform(at, lambda i: F.struct(F.element_at(t, s(i)).alias("s"), F.element_at(t, c(i)).alias("c")))
    both = rows.withColumns({"h": halves, "t": turns}).select("user_id", "pos", F.explode(F.array(
        F.struct(F.lit("halves").alias("form"), pair("h", lambda i: i + 1, lambda i: i + 9).alias("rows")), F.struct(F.lit("turns").alias("form"), pair("t", lambda i: 2 * i + 1, lambda i: 2 * i + 2).alias("rows"))
    )).alias("of"))
    out = both.select("user_id", "pos", "of.form", F.posexplode("of.rows").alias("channel", "v"))
    return out.select("user_id", "pos", "form", F.col("channel").cast("long").alias("channel"), six(F.col("v.s")).alias("s"), six(F.col("v.c")).alias("c"))


_FLAGS = ["1", "True", " off", "", None, "maybe"]


@query("""WITH E AS (SELECT event_id AS i, event_type AS t, value AS v, event_id % 6 AS f, event_id % 5 AS m FROM events)
SELECT i AS event_id, CASE WHEN m = 4 THEN NULL ELSE concat_ws(',', CASE WHEN m <> 0 THEN 'feather=' || t END, CASE WHEN m IN (0, 1) THEN 'mode=jaw' END) END AS known, CASE WHEN m IN (0, 1) THEN 'mode=jaw' ELSE '' END AS sent,
'blend=' || CASE WHEN m = 3 THEN 'new' ELSE 'old' END || ',restore=none' AS merged, CASE f WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS flag,
CASE WHEN t IN ('view', 'click') THEN t ELSE 'jaw' END AS mode, round(CASE WHEN f = 4 THEN 0.04 ELSE greatest(0.02, least(0.3, v / 200)) END::DOUBLE, 6) AS feather, q.face_restore AS restore, q.fidelity AS fidelity
FROM E JOIN (VALUES (1, 'none', NULL), (2, 'none', NULL), (3, 'codeformer', 0.7::DOUBLE)) q(quality, face_restore, fidelity) ON q.quality = i % 3 + 1""")
def knob_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, f, m = F.col("event_id"), F.col("event_id") % 6, F.col("event_id") % 5
    knobs = F.create_map(F.lit("mode"), F.when(m.isin(0, 1), "jaw"), F.lit("feather"), F.when(m.isin(1, 2, 3), F.col("event_type")))
    shown = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    merged = routing.merged(F.create_map(F.lit("mix"), F.lit("old"), F.lit("restore"), F.lit("none")), F.create_map(F.lit("mix"), F.when(m == 3, "new")), {"mix": "blend"})
    rows = table(spark, sf_dir, "events").withColumn("quality", (i % 3 + 1).cast("int")).join(F.broadcast(jobs.quality_levels(spark)), "quality")
    feather = F.when(f != 4, (F.col("value") / 200).cast("string")).otherwise("none given")
    return rows.select(
        "event_id", shown(routing.known_knobs(knobs)).alias("known"), shown(routing.forwarded(knobs, ["mode", "scale"])).alias("sent"), shown(merged).alias("merged"), routing.to_boolean(_pick(_FLAGS, f)).alias("flag"),
        routing.one_of(F.col("event_type"), ["view", "click"], "jaw").alias("mode"), F.round(routing.held_number(feather, 0.02, 0.3, 0.04), 6).alias("feather"), F.col("face_restore").alias("restore"), "fidelity",
    )


@query("""WITH B AS (SELECT l_orderkey, l_linenumber AS pos, CAST(l_quantity AS BIGINT) % 7 AS x2, l_partkey % 4 AS y2 FROM lineitem)
SELECT l_orderkey, first(pos ORDER BY x2 * y2 DESC, pos) AS pos, bool_or(x2 > 0 AND y2 > 0) AS active FROM B GROUP BY l_orderkey""")
def largest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), (F.col("l_quantity").cast("long") % 7).alias("x2"), (F.col("l_partkey") % 4).alias("y2"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), box.alias("box"))
    some = rows.groupBy("l_orderkey").agg(F.bool_or(faces.active(F.col("box"))).alias("active"))
    return faces.largest(rows, ("l_orderkey",), "pos", F.col("box")).join(some, "l_orderkey").select("l_orderkey", "pos", "active")


@query("""WITH P AS (SELECT vec_id, CAST(label AS BIGINT) AS frame, CAST(list_position(embedding[1:15], list_max(embedding[1:15])) - 1 AS BIGINT) AS k, vec_id % 2 = 0 AS near FROM embeddings)
SELECT frame, count(*) AS total, count(*) FILTER (k IN (1, 11, 12, 13, 14)) AS neck, count(*) FILTER (k IN (11, 12, 13)) AS mouth, count(*) FILTER ((near AND k <> 10) OR k IN (11, 12, 13)) AS jaw, count(*) FILTER (k NOT IN (1, 11, 12, 13)) AS outside FROM P GROUP BY frame""")
def face_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, near = faces.best_class(F.slice("embedding", 1, 15)), F.col("vec_id") % 2 == 0
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame"), label.alias("k"), near.alias("near"))
    k = F.col("k")
    masks = {"neck": faces.mode_mask(k, "neck"), "mouth": faces.mode_mask(k, "mouth"), "jaw": faces.jaw_mask(k, F.col("near")), "outside": ~faces.mode_mask(k, "raw")}
    return rows.groupBy("frame").agg(F.count("*").alias("total"), *[F.count_if(m).alias(n) for n, m in masks.items()])


@query("""WITH A(anchor, l_linenumber) AS (VALUES ('left', 1), ('left', 2), ('right', 3), ('nose', 2), ('nose', 4))
SELECT l_orderkey, anchor, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y FROM lineitem JOIN A USING (l_linenumber) GROUP BY ALL""")
def anchor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("landmark"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    found = faces.anchors(points, ("l_orderkey",), "landmark", {"left": [1, 2], "right": [3], "nose": [2, 4]})
    return found.select("l_orderkey", "anchor", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH E AS (SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN 5 END AS beam, CASE WHEN event_id % 3 = 0 THEN 5 END AS best, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 0.2 END AS t, CASE WHEN event_id % 7 = 0 THEN 1.0 END AS patience, CASE WHEN event_id % 4 = 1 THEN value / 50 END AS pen FROM events),
R AS (SELECT *, CASE WHEN beam IS NOT NULL AND best IS NOT NULL THEN 'beam_size and best_of' WHEN t = 0 AND best IS NOT NULL THEN 'best_of at temperature 0' WHEN patience IS NOT NULL AND beam IS NULL THEN 'patience without beam_size' WHEN pen > 1 THEN 'length_penalty outside 0..1' END AS error FROM E)
SELECT event_id, error, CAST(row_number() OVER (PARTITION BY event_type, event_id % 20 ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM R""")
def decoding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    error = jobs.decoding_error(F.when(i % 2 == 0, 5), F.when(i % 3 == 0, 5), F.when(i % 5 == 0, 0.0).otherwise(0.2), F.when(i % 7 == 0, 1.0), F.when(i % 4 == 1, v / 50))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (i % 20).alias("part"), error.alias("error"))
    return jobs.ranked(rows, ("event_type", "part"), v, "event_id").select("event_id", "error", "rank")


@query(r"""WITH D AS (SELECT doc_id, 'job-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 20) AS job, lang, text, CASE doc_id % 5 WHEN 0 THEN 501 WHEN 1 THEN 503 WHEN 2 THEN 422 WHEN 3 THEN 400 ELSE 500 END AS code, CASE doc_id % 3 WHEN 0 THEN 'Cannot access gated repo' WHEN 1 THEN 'HTTP 404' ELSE 'Access to it is RESTRICTED' END AS err FROM documents)
SELECT doc_id, substr(job, 1, 8) AS short, 'http://h/jobs/' || job || '/artifacts/final.mp4' AS url, md5('You are a professional translator. Translate the following text from ' || coalesce(lang, '?') || ' to Spanish. Preserve the speaker''s tone and register. Match the approximate length of the original so the translated speech fits in roughly the same time. Output only the translation, no commentary.' || chr(10) || chr(10) || 'Text: ' || coalesce(text, '')) AS prompt,
doc_id % 3 <> 1 AS gated, CASE code WHEN 501 THEN 'not implemented (scaffold): soon later' WHEN 503 THEN 'weights missing: {"error":"no face","message":"soon","next_step":"later","fix":"get them"} Fix: get them' WHEN 422 THEN 'could not process the clip: no face' WHEN 400 THEN 'rejected request: {"error":"no face","message":"soon","next_step":"later","fix":"get them"}' ELSE 'crashed: no face' END AS message,
CASE code WHEN 501 THEN 'not implemented' WHEN 503 THEN 'not ready' WHEN 422 THEN 'invalid input' WHEN 400 THEN 'bad request' ELSE 'failed' END AS outcome, CAST(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 100 END AS INTEGER) AS whole, CASE WHEN doc_id % 4 <> 1 THEN doc_id / 8 END AS part FROM D""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    job = F.concat(F.lit("job-"), F.substring(F.md5(i.cast("string")), 1, 20))
    code = _pick([501, 503, 422, 400, 500], i % 5)
    error = _pick(["Cannot access gated repo", "HTTP 404", "Access to it is RESTRICTED"], i % 3)
    body = F.lit('{"detail": {"error":"no face","message":"soon","next_step":"later","fix":"get them"}}')
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.short_id(job).alias("short"), text.artifact_url("http://h/", job, F.lit("final.mp4")).alias("url"), F.md5(text.translation_prompt(F.coalesce("lang", F.lit("?")), F.lit("Spanish"), F.coalesce("text", F.lit("")))).alias("prompt"),
        text.access_refused(error).alias("gated"), text.http_message(code, body).alias("message"), text.http_outcome(code).alias("outcome"), text.optional_int(F.when(i % 4 == 0, "None").otherwise((i % 100).cast("string"))).alias("whole"),
        text.optional_float(F.when(i % 4 == 1, "None").otherwise((i / 8).cast("string"))).alias("part"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'start' WHEN event_id % 3 = 1 THEN 'end' END AS kind, CASE WHEN event_id % 3 < 2 THEN CAST(round(value * 1000000) AS BIGINT) END AS at_us,
strftime(make_timestamp(event_id * 1000003), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(event_id * 1000003 % 1000000 AS VARCHAR), 6, '0') || '+00:00' AS iso, CASE WHEN event_id % 2 = 0 THEN props END AS json, CASE WHEN event_id % 2 = 1 THEN 'x' || props END AS raw FROM events WHERE event_id * 1000003 % 1000000 > 0""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    line = F.concat(_pick(["[silencedetect] silence_start: ", "[silencedetect] silence_end: ", "frame= "], i % 3), F.col("value").cast("decimal(20,6)").cast("string"), F.lit(" | silence"))
    at = i * 1_000_003
    mark, data = text.silence_marks(line), text.event_payload(F.when(i % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("x"), "props")))
    return table(spark, sf_dir, "events").filter(at % 1_000_000 > 0).select("event_id", mark["kind"].alias("kind"), mark["at_us"].alias("at_us"), text.utc_iso(at).alias("iso"), data["json"].alias("json"), data["raw"].alias("raw"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ordered.framed(points(spark, sf_dir), SEGMENTS, fill=("x", "y", "c"), n="n").select("user_id", "idx", "c", "n")
    return rows, rows.drop("n")


@query(f"""WITH {FILLED}, A AS (SELECT user_id, n, unnest([-1, 0, 5, -n - 1, n]) AS asked FROM N), P AS (SELECT *, CASE WHEN asked < 0 THEN asked + n ELSE asked END AS idx FROM A)
SELECT P.user_id, asked, P.idx >= 0 AND P.idx < n AS ok, c FROM P LEFT JOIN Fi ON Fi.user_id = P.user_id AND Fi.idx = P.idx""")
def frame_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled_frames(spark, sf_dir).select("user_id", "idx", "c")
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    asked = n.withColumn("idx", F.explode(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit(5).cast("long"), -F.col("n") - 1, F.col("n"))))
    return gather.at_index(asked, rows, KEYS, "idx").select("user_id", "asked", "ok", "c")


@query(f"""WITH {FILLED}, R AS (SELECT user_id, idx, c, n FROM Fi JOIN N USING (user_id))
SELECT user_id, 'tail' AS slice, count(*) AS n, CAST(sum(c * idx) AS BIGINT) AS s FROM R WHERE idx >= greatest(0, n - 7) GROUP BY user_id
UNION ALL SELECT user_id, 'every third', count(*), CAST(sum(c * idx) AS BIGINT) FROM R WHERE idx >= 2 AND idx < greatest(0, n - 2) AND (idx - 2) % 3 = 0 GROUP BY user_id
UNION ALL SELECT user_id, 'backwards', count(*), CAST(sum(c * idx) AS BIGINT) FROM R WHERE idx <= least(20, n - 1) AND idx > least(4, n - 1) AND (least(20, n - 1) - idx) % 2 = 0 GROUP BY user_id""")
def frame_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled_frames(spark, sf_dir).select("user_id", "idx", "c")
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    cut = {"tail": (-7, None, 1), "every third": (2, -2, 3), "backwards": (20, 4, -2)}
    asked = [gather.slice_indexes(n.withColumn("slice", F.lit(k)), *[F.lit(x).cast("long") for x in s], "idx") for k, s in cut.items()]
    every = asked[0].unionByName(asked[1]).unionByName(asked[2])
    return every.join(rows, ["user_id", "idx"]).groupBy("user_id", "slice").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("idx")).alias("s"))


@query(f"WITH {FILLED} SELECT user_id, idx, lag(x) OVER w AS before, x, lead(x) OVER w AS after FROM Fi WINDOW w AS (PARTITION BY user_id ORDER BY idx)")
def frame_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.triples(filled_frames(spark, sf_dir).select("user_id", "idx", "x"), FRAMES, "x")


@query(f"""WITH {FILLED}, L AS (SELECT user_id, list(x ORDER BY idx) AS xs, n FROM Fi JOIN N USING (user_id) GROUP BY user_id, n), K AS (SELECT *, unnest(range(1, n + 1)) AS k FROM L)
SELECT user_id, k - 1 AS idx, round(list_reduce(xs[1:k], lambda p, b: p * 0.2 + b * 0.8), 6) + 0.0 AS bias FROM K""")
def bias_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.recurrence(filled_frames(spark, sf_dir), KEYS, "idx", "x", "bias", 0.2, 0.8)
    return rows.select("user_id", "idx", six(F.col("bias")).alias("bias"))


@query(f"WITH {FILLED} SELECT user_id, idx, round(x, 5) + 0.0 AS x FROM Fi")
def emphasis_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = emphasised(spark, sf_dir)
    return scans.recurrence(there, KEYS, "idx", "z", "x", 0.97).select("user_id", "idx", (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(f"""WITH {Fr}, C AS (SELECT user_id, 9 - (idx % 10) AS chunk, idx // 10 AS pos, event_id FROM Fr) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY chunk, pos) - 1 AS BIGINT) AS at FROM C""")
def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("user_id", "event_id", (9 - F.col("idx") % 10).alias("chunk"), F.expr("idx div 10").alias("pos"))
    return series.joined_chunks(rows, KEYS, "chunk", "pos").select("user_id", "event_id", "at")


@query("""WITH X AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), S AS (SELECT d, avg(x) FILTER (label % 2 = 0) AS m0, sqrt(var_samp(x) FILTER (label % 2 = 0) + 0.00001) AS s0, avg(x) FILTER (label % 2 = 1) AS m1, sqrt(var_samp(x) FILTER (label % 2 = 1) + 0.00001) AS s1 FROM X GROUP BY d)
SELECT vec_id, round(sum((x - m0) / s0 * s1 + m1), 4) + 0.0 AS total FROM X JOIN S USING (d) WHERE label % 2 = 0 GROUP BY vec_id""")
def restyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    styled = series.restyled(rows.filter("label % 2 = 0"), rows.filter("label % 2 = 1"), "d", "x")
    return styled.groupBy("vec_id").agg((F.round(F.sum("x"), 4) + F.lit(0.0)).alias("total"))


@query("""WITH E AS (SELECT event_id, value / 10 AS a, (event_id % 13 - 6) / 4.0::DOUBLE AS b, value AS tx, value - 30 AS ty FROM events WHERE value > 0)
SELECT event_id, round(a / (a * a + b * b), 6) + 0.0 AS ia, round(-b / (a * a + b * b), 6) + 0.0 AS ib, 7.0::DOUBLE AS x, -3.0::DOUBLE AS y FROM E""")
def similarity_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse, and the point (7, -3) sent there and back."""
    rows = table(spark, sf_dir, "events").filter("value > 0").select("event_id", (F.col("value") / 10).alias("a"), ((F.col("event_id") % 13 - 6) / F.lit(4.0)).alias("b"), F.col("value").alias("tx"), (F.col("value") - 30).alias("ty"))
    c = F.col
    back = rows.withColumn("i", series.inverse_similarity(c("a"), c("b"), c("tx"), c("ty"))).withColumns({"px": c("a") * 7 + c("b") * 3 + c("tx"), "py": c("b") * 7 - c("a") * 3 + c("ty")})
    x, y = c("i.a") * c("px") - c("i.b") * c("py") + c("i.tx"), c("i.b") * c("px") + c("i.a") * c("py") + c("i.ty")
    return back.select("event_id", six(c("i.a")).alias("ia"), six(c("i.b")).alias("ib"), six(x).alias("x"), six(y).alias("y"))


@query("""WITH K AS (SELECT doc_id, substr(sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|0.04'), 1, 16) AS key FROM documents), C AS (SELECT key, min(doc_id) AS held FROM K WHERE doc_id % 3 = 0 GROUP BY key)
SELECT K.doc_id, K.key, CASE WHEN doc_id % 10 = 7 THEN 'disabled' WHEN held IS NULL THEN 'miss' ELSE 'hit' END AS outcome, CASE WHEN doc_id % 10 <> 7 THEN held END AS held FROM K LEFT JOIN C USING (key)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = jobs.content_key([F.col("text"), F.col("lang"), F.lit(0.04)])
    rows = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    cache = rows.filter("doc_id % 3 = 0").groupBy("key").agg(F.min("doc_id").alias("held"))
    return jobs.cached(rows, cache, "key", "held", F.col("doc_id") % 10 != 7).select("doc_id", "key", "outcome", "held")


@query(f"""WITH {FILLED}, G AS (SELECT user_id, unnest(range(0, 80)) AS idx FROM N) SELECT G.user_id, G.idx, coalesce(x, 0) AS x FROM G LEFT JOIN Fi ON Fi.user_id = G.user_id AND Fi.idx = G.idx""")
def pad_or_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.padded(filled_frames(spark, sf_dir), KEYS, "idx", "x", 80)


@query(r"""SELECT page_id, CASE WHEN page_id % 5 NOT IN (0, 1, 2) THEN 'extension' WHEN strlen(html) > 2000 THEN 'size' END AS reject_reason, page_id % 7 NOT IN (1, 2, 3) AS safe, strlen(html) AS bytes, CASE WHEN strlen(html) >= 1000 THEN 'skip' ELSE 'fetch' END AS action FROM pages""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    name = F.concat(i.cast("string"), _pick([".mp4", ".MOV", ".webm", ".txt", ""], i % 5))
    rows = files.uploads(table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.octet_length("html").cast("long").alias("length")), 2_000)
    safe = files.safe_name(_pick(["a.mp4", "../a", "a/b.mp4", ".hidden", "final.mp4", "x", "y.srt"], i % 7))
    return rows.select("page_id", "reject_reason", safe.alias("safe"), F.col("length").alias("bytes"), jobs.download_action(F.col("length"), F.lit(1_000)).alias("action"))


@query("SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'changed' END AS category, count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 2 == 0, "kept").otherwise("changed").alias("category"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return rows.groupBy("source", "category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("""WITH C(code) AS (VALUES ('en'), ('es'), ('fr'), ('de')), A(alias, code) AS (VALUES ('view', 'en'), ('click', 'es')), E AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['en', 'xx', 'de'][event_id % 9 // 3 + 1] ELSE event_type END AS name FROM events)
SELECT event_id, coalesce(C.code, A.code) AS code FROM E LEFT JOIN C ON C.code = name LEFT JOIN A ON A.alias = name""")
def alias_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(c,) for c in ("en", "es", "fr", "de")], "code string")
    aliases = spark.createDataFrame([("view", "en"), ("click", "es")], "alias string, code string")
    i = F.col("event_id")
    named = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, _pick(["en", "xx", "de"], F.floor(i % 9 / 3))).otherwise(F.col("event_type")).alias("name"))
    return routing.resolve_alias(named, codes, aliases, "name").select("event_id", "code")


@query("""SELECT vec_id, round(list_sum(list_reverse(embedding)[1:5])::DOUBLE, 4) + 0.0 AS flipped, CAST(len(embedding) * 2 AS INTEGER) AS doubled, round((embedding[1] + embedding[33])::DOUBLE, 4) + 0.0 AS paired, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings""")
def array_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed and cut, set end to end, halves stacked and turned into pairs, and the place of the largest."""
    e = F.col("embedding")
    pairs = F.arrays_zip(F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))
    first = F.aggregate(F.slice(F.reverse(e), 1, 5), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.round(first, 4) + F.lit(0.0)).alias("flipped"), F.size(F.flatten(F.array_repeat(e, 2))).alias("doubled"),
        (F.round((pairs[0]["a"] + pairs[0]["b"]).cast("double"), 4) + F.lit(0.0)).alias("paired"), faces.best_class(e).alias("best"),
    )


@query("""SELECT lang, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT source), ['books', 'web']))), ',') AS vocabulary, round(avg(n_chars), 6) AS mean_loss FROM documents WHERE source IS NOT NULL GROUP BY lang""")
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a language, of which there are few, and a fixed list; and a mean from partial sums."""
    per = table(spark, sf_dir, "documents").filter("source is not null").groupBy("lang", "source").agg(F.sum("n_chars").alias("s"), F.count("n_chars").alias("n"))
    words = F.array_union(F.collect_set("source"), F.array(F.lit("books"), F.lit("web")))
    return per.groupBy("lang").agg(F.array_join(F.array_sort(words), ",").alias("vocabulary"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_loss"))


@query("""WITH S AS (SELECT DISTINCT conv_id, 'en' AS language, 0.5::DOUBLE AS language_probability, coalesce(text, '') AS text, CAST(turn + 1 AS INTEGER) AS segment_count, 'transcript.json' AS path FROM conversations WHERE turn = 0)
SELECT conv_id, language || '|' || segment_count || '|' || path AS handed_on, md5(text) AS said FROM S""")
def stage_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.lit("en").alias("language"), F.lit(0.5).alias("language_probability"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.col("turn")).alias("segments"), F.lit("transcript.json").alias("path")).distinct()
    out = rows.select("conv_id", jobs.stage_output("transcribe").alias("o"))
    return out.select("conv_id", F.concat_ws("|", "o.language", F.col("o.segment_count").cast("string"), "o.path").alias("handed_on"), F.md5("o.text").alias("said"))


@query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN -1 END AS INTEGER) AS device, epoch_us(ts) // 1000000 AS whole_second, value > 60 AS too_long FROM events""")
def preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = _pick(["cuda", "cuda:3", "cpu", "tpu", "cuda:x"], F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", signal.device_index(device).alias("device"), F.floor(micros("ts") / 1_000_000).alias("whole_second"), (F.col("value") > 60).alias("too_long"))

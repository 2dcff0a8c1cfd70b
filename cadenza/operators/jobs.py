"""Job records: listing, stages, state machine, progress and remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Timeline, framed, last_known, previous
from .routing import small

# The stages in order, and wall seconds per source second of a lip-sync backend.
STAGES = ["audio", "stabilize", "transcribe", "translate", "tts", "lipsync", "poststabilize", "mux"]
COST = {"none": 0.0, "wav2lip": 15.0, "musetalk": 200.0, "latentsync": 1080.0}
# The share of a job's progress at which a phase starts and ends.
PHASES = {"detect": (0.0, 0.25), "denoise": (0.25, 0.90), "restore": (0.90, 0.98), "mux": (0.98, 1.0)}
TERMINAL = ["completed", "failed", "cancelled"]


def newest(df: DataFrame, created: str, key: str, limit: int) -> DataFrame:
    """The `limit` (held to 1..200) newest rows, ties to the smaller key."""
    return df.orderBy(F.col(created).desc(), F.col(key)).limit(min(200, max(1, limit)))


def stage_rows(df: DataFrame) -> DataFrame:
    """`df` once per stage, with pos and stage."""
    return df.select("*", F.posexplode(F.array(*map(F.lit, STAGES))).alias("pos", "stage"))


def with_stage_status(keys: DataFrame, records: DataFrame, on: tuple[str, ...], default: str = "pending") -> DataFrame:
    """Every stage of every key with its recorded status, `default` where there is none."""
    return stage_rows(keys).join(records.select(*on, "pos", "status"), [*on, "pos"], "left").withColumn("status", F.coalesce("status", F.lit(default)))


def prefix_outcome(prefixes: DataFrame, ids: DataFrame, prefix: str, id_: str, length: int) -> DataFrame:
    """prefix, outcome: none, one or many distinct ids that start with a prefix of `length` characters.

    A prefix of known length makes it an equi-join on that part of the id.
    """
    counts = ids.select(id_).distinct().groupBy(F.substring(id_, 1, length).alias(prefix)).agg(F.count("*").alias("_n"))
    outcome = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("many")
    return prefixes.join(counts, prefix, "left").select(prefix, outcome.alias("outcome"))


def missing_items(manifest: DataFrame, present: DataFrame, key: str, size: str, least: str) -> DataFrame:
    """key, status of every manifest row: missing, too small or ok. `present` is (key, size), the largest counts."""
    held = present.groupBy(key).agg(F.max(size).alias("_size"))
    status = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") < F.col(least), "small").otherwise("ok")
    return manifest.join(held, key, "left").select(key, status.alias("status"))


def static_eta(stage: Column, source: Column, backend: Column) -> Column:
    """Estimated seconds of a stage from the source's length; null where that is unknown."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in COST.items() for x in pair]), backend), F.lit(0.0))
    known = F.when(source != 0, source)
    at_least = lambda low, x: F.when(known.isNotNull(), F.greatest(F.lit(low), x))
    return (
        F.when(stage == "audio", 1.0)
        .when(source.isNull(), F.lit(None).cast("double"))
        .when(stage.isin("stabilize", "poststabilize"), at_least(3.0, source * 2.0))
        .when(stage == "transcribe", at_least(2.0, source / 6.0))
        .when(stage == "translate", at_least(3.0, source / 2.0))
        .when(stage == "tts", at_least(5.0, source * 2.0))
        .when(stage == "lipsync", source * factor)
        .when(stage == "mux", 2.0)
    )


def observed_remaining(progress: Column, elapsed: Column) -> Column:
    """Remaining seconds at the rate so far; null before 3 s or up to 2 % of progress."""
    return F.when((elapsed >= 3) & (progress > 0.02), F.bround((1 - progress) * elapsed / progress, 0))


def stage_elapsed(df: DataFrame, t: Timeline, stage: str, at: str, idx: str = "_pos") -> DataFrame:
    """`df` plus elapsed, the time since the running stage last changed, and each row's number in its key where `idx` is named."""
    told = framed(df, t, idx, before={"_stage": stage})
    began = F.when((F.col(idx) == 0) | ~F.col("_stage").eqNullSafe(F.col(stage)), F.col(at))
    rows = last_known(told, t, {"_start": began})
    return rows.withColumn("elapsed", F.col(at) - F.col("_start")).drop("_stage", "_start", "_pos")


def weighted_progress(phase: Column, share: Column) -> Column:
    """Progress of a job from its phase and the share of it that is done, held to 0..1."""
    held = F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    low, high = (F.element_at(F.create_map(*[F.lit(x) for p, v in PHASES.items() for x in (p, v[k])]), phase) for k in (0, 1))
    return low + (high - low) * held


def illegal_transitions(df: DataFrame, t: Timeline, status: str, allowed: DataFrame) -> DataFrame:
    """The rows of `df` whose status may not follow the row before it; `allowed` is (from, to). First rows are not judged."""
    steps = previous(df, t, {"from": status}).filter(F.col("from").isNotNull()).withColumn("to", F.col(status))
    return steps.join(small(allowed.select("from", "to")), ["from", "to"], "left_anti")


def latest(log: DataFrame, keys: tuple[str, ...], *version: str) -> DataFrame:
    """The last written row of each key of an append-only log; give enough columns to settle ties."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(*version)).alias("_row")).select("_row.*")


def admitted(queue: DataFrame, key: str, queued: str, most: int) -> DataFrame:
    """The `most` jobs that wait longest."""
    return queue.orderBy(queued, key).limit(most)


def cap_per_key(df: DataFrame, keys: tuple[str, ...], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most).drop("_nth")


def ticked(stages: DataFrame, reports: DataFrame, keys: tuple[str, ...], start: str, end: str, eta: str, at: str, percent: str, every: int, cap: float = 0.99) -> DataFrame:
    """keys, tick, percent: what a ticker says every `every` units while a stage runs, as of each tick.

    `stages` holds one row per key: start, end and eta as whole numbers; `reports` the reported shares by time. The last
    share reported since the start counts; before the first, the share of the eta that has passed; without either the
    tick is left out. Nothing over `cap`.
    """
    own, t = [F.col(k) for k in keys], F.col("_at")
    spans = stages.select(*own, F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(eta).alias("_eta"))
    asked = spans.filter(F.col("_end") > F.col("_start") + every).withColumn("_at", F.explode(F.sequence(F.col("_start") + every, F.col("_end") - 1, F.lit(every).cast("long"))))
    told = reports.select(*own, F.col(at).alias("_at"), F.col(percent).alias("_real")).filter("_real is not null").join(spans, list(keys)).filter((t >= F.col("_start")) & (t < F.col("_end")))
    kind = lambda k: F.lit(k).alias("_kind")  # noqa: E731  a report at the time of a tick comes before it
    cols = [*own, "_at", "_start", "_eta"]
    rows = told.select(*cols, kind(0), F.col("_real").cast("double")).unionByName(asked.select(*cols, kind(1), F.lit(None).cast("double").alias("_real")))
    line = Timeline(keys, ("_at", "_kind"), 4_096 * every)
    since = last_known(rows, line, {"_last": F.col("_real")}).filter("_kind = 1")
    passed = F.when(F.col("_eta") > 0, (t - F.col("_start")) / F.col("_eta"))
    share = F.least(F.lit(cap), F.coalesce("_last", passed))
    return since.select(*own, t.alias("tick"), F.when(F.coalesce("_last", passed).isNotNull(), share).alias("percent")).filter("percent is not null")


def exit_code(status: Column) -> Column:
    """How a wait for a job ends: 0 completed, 1 failed, 3 cancelled, 2 given up while it still runs."""
    return F.when(status == "completed", 0).when(status == "failed", 1).when(status == "cancelled", 3).otherwise(2)


def cancel_outcome(known: Column, status: Column, live: Column) -> Column:
    """What a request to cancel is answered with: 404 for an unknown job or one that does not run here, 409 once it is over, else 200."""
    over = status.isin(TERMINAL)
    return F.when(~F.coalesce(known, F.lit(False)), 404).when(F.coalesce(over, F.lit(False)), 409).when(~F.coalesce(live, F.lit(False)), 404).otherwise(200)


def cancelled(status: Column, outcome: Column) -> Column:
    return F.when(outcome == 200, "cancelled").otherwise(status)


def result_path(status: Column, mux_status: Column, path: Column) -> Column:
    """The path of a result that can be shown: of a completed job whose last stage is done and left one; else null."""
    return F.when((status == "completed") & (mux_status == "done") & (path != ""), path)


def skips_output_stabilising(asked: Column, default: bool, produced: Column) -> Column:
    """True where the stage is off, by request or else by default, or there is no lip-synced file to work on."""
    return ~F.coalesce(asked, F.lit(default)) | ~F.coalesce(produced, F.lit(False))


def running_stage(stages: DataFrame, keys: tuple[str, ...], pos: str, name: str, status: str) -> DataFrame:
    """keys, name: the first running stage of each job; jobs without one are left out."""
    return stages.filter(F.col(status) == "running").groupBy(*keys).agg(F.min_by(name, pos).alias(name))


# What a stage hands on of its result, and under which name.
OUTPUTS = {
    "transcribe": {"language": "language", "language_probability": "language_probability", "text": "text", "segment_count": "segments", "path": "path"},
    "translate": {"source_language": "source_language", "target_language": "target_language", "backend": "backend", "text": "text", "segment_count": "segments", "path": "path"},
    "mux": {"path": "path", "watermark": "watermark", "source_video": "video"},
}


def stage_output(stage: str, counted: tuple[str, ...] = ("segments",)) -> Column:
    """The struct that a stage hands on, of columns of its result; lists are handed on as their length."""
    return F.struct(*[(F.size(c) if c in counted else F.col(c)).alias(n) for n, c in OUTPUTS[stage].items()])


def all_ok(df: DataFrame, keys: tuple[str, ...], ok: Column) -> DataFrame:
    """keys, ok: whether a condition holds in all rows; unknown counts as no."""
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))


def cached(asked: DataFrame, cache: DataFrame, key: str, value: str, enabled: Column) -> DataFrame:
    """`asked` plus value and outcome: hit, miss, or disabled, where the cache is not looked at. `cache` has one row per key."""
    held = cache.select(F.col(key), F.col(value), F.lit(True).alias("cadenza__hit"))
    found = asked.join(held, key, "left")
    hit = F.coalesce(F.col("cadenza__hit"), F.lit(False))
    outcome = F.when(~enabled, "disabled").when(hit, "hit").otherwise("miss")
    return found.withColumns({"outcome": outcome, value: F.when(enabled, F.col(value))}).drop("cadenza__hit")


def content_key(parts: list[Column], length: int = 16) -> Column:
    """A short key of bytes and of the settings they are worked on with; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def download_action(size: Column, least: Column) -> Column:
    """skip a file that is there and large enough, fetch it otherwise."""
    return F.when(F.coalesce(size, F.lit(-1)) >= least, "skip").otherwise("fetch")


# Settings of the three quality levels.
QUALITY = [(1, "raw", 0.06, "none", None, None), (2, "jaw", 0.04, "none", None, None), (3, "jaw", 0.04, "codeformer", 0.7, 0.6)]


def quality_levels(spark) -> DataFrame:
    return spark.createDataFrame(QUALITY, "quality int, blend_mode string, blend_feather double, face_restore string, fidelity double, blend double")


def decoding_error(beam: Column, best_of: Column, temperature: Column, patience: Column, penalty: Column) -> Column:
    """Which options of a decoder do not go together, null if all do."""
    return (
        F.when(beam.isNotNull() & best_of.isNotNull(), "beam_size and best_of")
        .when((temperature == 0) & best_of.isNotNull(), "best_of at temperature 0")
        .when(patience.isNotNull() & beam.isNull(), "patience without beam_size")
        .when(penalty.isNotNull() & ~penalty.between(0, 1), "length_penalty outside 0..1")
    )


def ranked(df: DataFrame, keys: tuple[str, ...], score: Column, tie: str, name: str = "rank") -> DataFrame:
    """`df` plus each row's rank in its group by score, the best first."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), F.col(tie))))

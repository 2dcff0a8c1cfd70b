"""Interval, series and gather queries: `events` stands in for segments and for per-frame signals of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gather, intervals, jobs, ordered, scans, series, spectra, vectors
from ..operators.ordered import Timeline
from .registry import micros, query, six, table

KEYS = ("user_id",)
SEGMENTS = Timeline(KEYS, ("s_us", "event_id"))
FRAMES = Timeline(KEYS, ("idx",), 4_096)
MINUTE, HOUR = 60_000_000, 3_600_000_000
ISLAND_GAP, MERGE_GAP, HEADROOM, LONGEST, SILENCE = 15 * MINUTE, 30 * MINUTE, 5 * MINUTE, 12 * HOUR, 50_000

S = """S AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS s_us, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 6000000 AS e_us FROM events)"""
Fr = """Fr AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS s_us, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
  CASE WHEN event_id % 7 <> 0 THEN value END AS x, CASE WHEN event_id % 7 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS c,
  CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) END AS y FROM events),
N AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"""
_fill = lambda c: f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING),
  first_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""  # noqa: E731
FILLED = f"{Fr}, Fi AS (SELECT user_id, event_type, idx, {_fill('x')} AS x, {_fill('y')} AS y, {_fill('c')} AS c FROM Fr)"


def _islands(gap: int) -> str:
    return f"""{S}, L AS (SELECT *, CASE WHEN s_us - lag(e_us) OVER w > {gap} THEN 1 ELSE 0 END AS brk FROM S WINDOW w AS (PARTITION BY user_id ORDER BY s_us, event_id)),
I AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY s_us, event_id) AS BIGINT) AS island FROM L),
P AS (SELECT user_id, island, first(s_us ORDER BY s_us, event_id) AS s, last(e_us ORDER BY s_us, event_id) AS e, count(*) AS n FROM I GROUP BY user_id, island)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = micros("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", start.alias("s_us"), (start + F.round(F.col("value") * 100).cast("long") * 6_000_000).alias("e_us"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, event_id, s_us, x, y, c (x in hundredths); the point is null in every seventh event."""
    seen = F.col("event_id") % 7 != 0
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", micros("ts").alias("s_us"), F.when(seen, F.col("value")).alias("x"),
        F.when(seen, F.get_json_object("props", "$.k").cast("double")).alias("y"), F.when(seen, F.round(F.col("value") * 100).cast("long")).alias("c"),
    )
    return rows


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`points` with each one's number idx in its clip, from 0."""
    return ordered.numbered(points(spark, sf_dir), SEGMENTS)


def emphasised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`filled_frames` plus z, x less what its factor leaves of the frame before."""
    rows = ordered.framed(points(spark, sf_dir), SEGMENTS, fill=("x", "y", "c"), before={"px": "x"})
    return rows.withColumn("z", F.col("x") - F.lit(0.97) * F.coalesce("px", F.lit(0.0))).drop("px")


def filled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.framed(points(spark, sf_dir), SEGMENTS, fill=("x", "y", "c"))


@query(f"WITH {_islands(ISLAND_GAP)} SELECT user_id, island, s AS first_s, e AS last_e, n FROM P")
def islands_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals.island_spans(segments(spark, sf_dir), SEGMENTS, "s_us", "e_us", ISLAND_GAP)
    return spans.withColumnsRenamed({"start": "first_s", "end": "last_e"})


@query(f"""WITH {_islands(ISLAND_GAP)}, R AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e - s DESC, s) AS r FROM P)
SELECT user_id, s AS start_us, least(e, s + {LONGEST}) AS end_us FROM R WHERE r = 1""")
def longest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = intervals.longest(intervals.island_spans(segments(spark, sf_dir), SEGMENTS, "s_us", "e_us", ISLAND_GAP), KEYS)
    return best.select("user_id", F.col("start").alias("start_us"), F.least("end", F.col("start") + LONGEST).alias("end_us"))


@query(f"WITH {_islands(MERGE_GAP - 1)} SELECT user_id, island AS pos, s AS s_us, e AS e_us FROM P")
def silence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(segments(spark, sf_dir), SEGMENTS, "s_us", "e_us", MERGE_GAP)
    return merged.select("user_id", F.col("island").alias("pos"), F.col("start").alias("s_us"), F.col("end").alias("e_us"))


_SPEECH = f"""{_islands(MERGE_GAP - 1)}, B AS (SELECT user_id, min(s_us) - {HOUR} AS lo, max(e_us) + {HOUR} AS hi FROM S GROUP BY user_id),
G AS (SELECT user_id, lo, hi, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY island), lo) AS a, s AS b FROM P JOIN B USING (user_id)
  UNION ALL SELECT user_id, max(lo), max(hi), arg_max(e, island), max(hi) FROM P JOIN B USING (user_id) GROUP BY user_id),
K AS (SELECT * FROM G WHERE b - a >= {HOUR})"""


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, lo, hi, start, end of what lies between merged silences, an hour long at least."""
    rows = segments(spark, sf_dir)
    bounds = rows.groupBy("user_id").agg((F.min("s_us") - HOUR).alias("lo"), (F.max("e_us") + HOUR).alias("hi"))
    silences = intervals.merge(rows, SEGMENTS, "s_us", "e_us", MERGE_GAP).join(bounds, "user_id")
    spans = intervals.complement(silences, Timeline((*KEYS, "lo", "hi"), ("start", "island")), "start", "end", "lo", "hi")  # lo and hi go with the key
    return spans.filter(F.col("end") - F.col("start") >= HOUR)


@query(f"WITH {_SPEECH} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS pos, a AS s_us, b AS e_us FROM K")
def speech_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ordered.numbered(_speech(spark, sf_dir), Timeline(KEYS, ("start",)), "pos")
    return numbered.select("user_id", "pos", F.col("start").alias("s_us"), F.col("end").alias("e_us"))


@query(f"""WITH {_SPEECH}, R AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b - a DESC, a) AS r FROM K)
SELECT user_id, greatest(lo, a - {HEADROOM}) AS s_us, least(hi, b + {HEADROOM}) AS e_us FROM R WHERE r = 1""")
def trim_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _speech(spark, sf_dir)
    best = intervals.longest(spans, ("user_id", "lo", "hi"))
    return best.select("user_id", F.greatest("lo", F.col("start") - HEADROOM).alias("s_us"), F.least("hi", F.col("end") + HEADROOM).alias("e_us"))


_ASSEMBLE = f"""{S}, O AS (SELECT *, event_id % 5 = 0 AS gone, lag(e_us) OVER w AS pe, row_number() OVER w AS rn FROM S WINDOW w AS (PARTITION BY user_id ORDER BY s_us, event_id)),
A AS (SELECT user_id, min(rn) AS fr FROM O WHERE NOT gone GROUP BY user_id),
Q AS (SELECT user_id, rn, 0 AS sub, 'silence' AS kind, s_us - pe AS len FROM O JOIN A USING (user_id) WHERE NOT gone AND rn <> fr AND s_us - pe > {SILENCE}
  UNION ALL SELECT user_id, rn, 1, CASE WHEN gone THEN 'silence' ELSE 'segment' END, e_us - s_us FROM O JOIN A USING (user_id) WHERE NOT gone OR e_us - s_us > {SILENCE}),
Z AS (SELECT user_id, row_number() OVER w - 1 AS pos, kind, CAST(sum(len) OVER w - len AS BIGINT) AS offset_us, len AS len_us FROM Q WINDOW w AS (PARTITION BY user_id ORDER BY rn, sub))"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.assemble(segments(spark, sf_dir).withColumn("gone", F.col("event_id") % 5 == 0), SEGMENTS, "s_us", "e_us", "gone", SILENCE)


@query(f"WITH {_ASSEMBLE} SELECT * FROM Z")
def timeline_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).withColumnsRenamed({"offset": "offset_us", "length": "len_us"})


@query(f"""WITH {_ASSEMBLE} SELECT user_id, pos + 1 AS pos, kind, offset_us + {HOUR} AS offset_us, len_us FROM Z
UNION ALL SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'silence', CAST(0 AS BIGINT), CAST({HOUR} AS BIGINT) FROM Z""")
def prepend_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.prepend(_timeline(spark, sf_dir), KEYS, HOUR).withColumnsRenamed({"offset": "offset_us", "length": "len_us"})


@query(f"WITH {FILLED} SELECT user_id, idx, x FROM Fi")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_frames(spark, sf_dir).select("user_id", "idx", "x")


@query(f"""WITH {FILLED} SELECT user_id, idx, CAST(round_even(avg(c) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS BIGINT) AS xm FROM Fi""")
def smooth_ma5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(filled_frames(spark, sf_dir), KEYS, "idx", {"xm": "c"}).select("user_id", "idx", "xm")


#: Second-order weights over five points, in thirty-fifths, by row of the window.
_SG5 = [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]
_SAVGOL = f"""H AS (SELECT * FROM (VALUES {', '.join(f'({r}, {o}, {w}.0::DOUBLE / 35)' for r, row in enumerate(_SG5) for o, w in enumerate(row))}) v(r, o, w)),
J AS (SELECT user_id, idx, CASE WHEN idx < 2 THEN idx WHEN idx > n - 3 THEN 5 - n + idx ELSE 2 END AS r, CASE WHEN idx < 2 THEN 0 WHEN idx > n - 3 THEN n - 5 ELSE idx - 2 END AS base FROM Fi JOIN N USING (user_id) WHERE n >= 5)"""


@query(f"""WITH {FILLED}, {_SAVGOL} SELECT J.user_id, J.idx, round(sum(w * x), 6) + 0.0 AS xs, round(sum(w * y), 6) + 0.0 AS ys
FROM J JOIN H USING (r) JOIN Fi ON Fi.user_id = J.user_id AND Fi.idx = base + o GROUP BY ALL
UNION ALL SELECT user_id, idx, round(x, 6) + 0.0, round(y, 6) + 0.0 FROM Fi JOIN N USING (user_id) WHERE n < 5""")
def smooth_sg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.savgol(filled_frames(spark, sf_dir), FRAMES, "idx", ["x", "y"]).select("user_id", "idx", six(F.col("x")).alias("xs"), six(F.col("y")).alias("ys"))


@query(f"""WITH {FILLED}, {_SAVGOL}, D AS (SELECT user_id, idx, x AS tx, y AS ty, cos(x % 3) AS co, sin(x % 3) AS si, ln(greatest(1 + y / 100, 0.000001)) AS lg FROM Fi),
M AS (SELECT J.user_id, J.idx, sum(w * tx) AS tx, sum(w * ty) AS ty, sum(w * co) AS co, sum(w * si) AS si, sum(w * lg) AS lg
  FROM J JOIN H USING (r) JOIN D ON D.user_id = J.user_id AND D.idx = base + o GROUP BY ALL
  UNION ALL SELECT D.user_id, idx, tx, ty, co, si, lg FROM D JOIN N USING (user_id) WHERE n < 5)
SELECT user_id, idx, round(exp(lg) * cos(atan2(si, co)), 6) + 0.0 AS a, round(exp(lg) * sin(atan2(si, co)), 6) + 0.0 AS b, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty FROM M""")
def affine_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled_frames(spark, sf_dir).select("user_id", "idx", (F.col("x") % 3).alias("theta"), (1 + F.col("y") / 100).alias("scale"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    smooth = series.smooth_similarity(rows, FRAMES, "idx")
    return smooth.select("user_id", "idx", *[six(F.col(c)).alias(c) for c in ("a", "b", "tx", "ty")])


_MOVED = f"""{Fr}, Lx AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM Fr WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
D AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM Lx)"""


@query(f"""WITH {_MOVED}, E AS (SELECT CAST(round(d * 1000000) AS BIGINT) AS u FROM D WHERE d IS NOT NULL)
SELECT count(u) AS count, round(avg(u) / 1000000, 6) AS mean, max(u) / 1000000 AS max, round(quantile_cont(u, 0.5) / 1000000, 6) AS p50, round(quantile_cont(u, 0.95) / 1000000, 6) AS p95,
  round(quantile_cont(u, 0.99) / 1000000, 6) AS p99, round(stddev_pop(u) / 1000000, 6) AS std_pop FROM E""")
def displacement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = series.displacement(points(spark, sf_dir), SEGMENTS).select(F.round(F.col("moved") * 1_000_000).cast("long").alias("u"))
    whole = moved.agg(*series.spread(F.col("u"))).withColumn("_one", F.lit(1))
    shares = ordered.exact_percentiles(moved, "u", [0.5, 0.95, 0.99], 1_000_000).withColumn("_one", F.lit(1))
    micro = lambda c: F.round(F.col(c) / 1_000_000, 6).alias(c)
    return whole.join(shares, "_one").select("count", *[micro(c) for c in ("mean", "max", "p50", "p95", "p99", "std_pop")])


@query(f"""WITH {_MOVED} SELECT event_type, count(d) AS count, round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(stddev_pop(d), 6) AS std_pop FROM D GROUP BY GROUPING SETS ((event_type), ())""")
def displacement_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = series.displacement(points(spark, sf_dir), SEGMENTS)
    stats = moved.rollup("event_type").agg(*series.spread(F.col("moved")))
    return stats.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "max", "std_pop")])


@query(f"""WITH {Fr}, A AS (SELECT user_id, idx, abs(x - first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d FROM Fr)
SELECT user_id, round(max(d), 6) AS mx, round(avg(d), 6) AS mn, bool_and(d = 0) AS same, first(idx ORDER BY d DESC, idx) AS worst_idx FROM A WHERE d IS NOT NULL GROUP BY user_id""")
def frame0_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.against_first(frames(spark, sf_dir), FRAMES, "idx", "x").withColumns({c: F.round(c, 6) for c in ("mx", "mn")})


@query(f"""WITH {Fr}, A AS (SELECT user_id, count(*) FILTER (x IS NULL) AS missing, count(*) AS total, list(idx ORDER BY idx) FILTER (x IS NULL) AS gone FROM Fr GROUP BY user_id)
SELECT user_id, missing, total, round(missing / total, 6) AS ratio, coalesce(array_to_string(gone[1:10], ','), '') AS first10, missing / total > 0.15 OR missing = total AS fail FROM A""")
def missing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.missing(frames(spark, sf_dir), KEYS, "idx", "x", 0.15).withColumn("ratio", F.round("ratio", 6))


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(user_id, frame, n) of every frame, and the features (user_id, idx, c)."""
    rows = ordered.framed(points(spark, sf_dir), SEGMENTS, fill=("x", "y", "c"), n="n")
    return rows.select("user_id", F.col("idx").alias("frame"), "n"), rows.select("user_id", "idx", "c")


@query(f"""WITH {FILLED}, W AS (SELECT user_id, idx AS frame, n, unnest(range(idx * 2 - 4, idx * 2 + 6)) AS a FROM Fi JOIN N USING (user_id))
SELECT W.user_id, frame, count(*) AS n, CAST(sum(c) AS BIGINT) AS sx FROM W JOIN Fi ON Fi.user_id = W.user_id AND Fi.idx = least(greatest(0, a), W.n - 1) GROUP BY W.user_id, frame""")
def gather_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, features = _counted(spark, sf_dir)
    return gather.clamped(asked, features, KEYS, "frame", "idx", (2, 1), 4, 6).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.sum("c").alias("sx"))


@query(f"""WITH {FILLED}, W AS (SELECT user_id, idx AS frame, n, unnest(range(-2, 3)) AS step FROM Fi JOIN N USING (user_id)),
V AS (SELECT user_id, frame, n, (frame + step) * 2 AS i FROM W), U AS (SELECT user_id, frame, unnest(CASE WHEN i < 1 OR i > n - 1 THEN [least(greatest(0, i), n - 1), least(greatest(0, i), n - 1)] ELSE [i - 1, i] END) AS a FROM V)
SELECT U.user_id, frame, count(*) AS n, CAST(sum(c) AS BIGINT) AS sx FROM U JOIN Fi ON Fi.user_id = U.user_id AND Fi.idx = a GROUP BY U.user_id, frame""")
def gather_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, features = _counted(spark, sf_dir)
    return gather.sparse(asked, features, KEYS, "frame", "idx", (2, 1), 2, 2).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.sum("c").alias("sx"))


@query(f"""WITH {FILLED}, W AS (SELECT user_id, idx AS frame, unnest(range(idx * 2 - 4, idx * 2 + 6)) AS a FROM Fi)
SELECT W.user_id, frame, count(*) AS n, CAST(sum(coalesce(c, 0)) AS BIGINT) AS sx FROM W LEFT JOIN Fi ON Fi.user_id = W.user_id AND Fi.idx = a GROUP BY W.user_id, frame""")
def gather_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, features = _counted(spark, sf_dir)
    return gather.zero_padded(asked, features, KEYS, "frame", "idx", (2, 1), 4, 6).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.sum(F.coalesce("c", F.lit(0))).alias("sx"))


@query(f"""WITH {FILLED}, W AS (SELECT user_id, idx AS i, n, least((idx * 80) // 25, greatest(0, n - 16)) AS start FROM Fi JOIN N USING (user_id))
SELECT W.user_id, i, start, CAST(sum(c) AS BIGINT) AS sx FROM W JOIN Fi ON Fi.user_id = W.user_id AND Fi.idx >= start AND Fi.idx < start + 16 GROUP BY W.user_id, i, start""")
def mel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, features = _counted(spark, sf_dir)
    windows = gather.last_clamped_windows(asked, features, KEYS, "frame", "idx", (80, 25), 16)
    return windows.groupBy("user_id", F.col("frame").alias("i"), "start").agg(F.sum("c").alias("sx"))


@query(f"WITH {Fr} SELECT user_id, s_us // 30000000 AS bucket, count(*) AS n, CAST(sum(c) AS BIGINT) AS sv FROM Fr GROUP BY ALL")
def tumbling_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("user_id", F.expr("s_us div 30000000").alias("bucket")).agg(F.count("*").alias("n"), F.sum("c").alias("sv"))


@query(f"""WITH {FILLED}, W AS (SELECT user_id, unnest(range(0, greatest(0, n - 55), 3)) AS i FROM N)
SELECT W.user_id, i, CAST(sum(c) AS BIGINT) AS sx FROM W JOIN Fi ON Fi.user_id = W.user_id AND Fi.idx >= i AND Fi.idx < i + 52 GROUP BY W.user_id, i""")
def sliding_52_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled_frames(spark, sf_dir).select("user_id", "idx", "c")
    windows = gather.sliding(rows.groupBy("user_id").agg(F.count("*").alias("n")), 52, 3, 3)
    return gather.window_rows(windows, rows, KEYS, "idx", 52).groupBy("user_id", "i").agg(F.sum("c").alias("sx"))


@query(f"""WITH {FILLED}, W AS (SELECT user_id, unnest(range(0, 20)) AS j FROM N), V AS (SELECT *, CASE WHEN (j // 7) % 2 = 0 THEN j % 7 ELSE 6 - j % 7 END AS idx FROM W)
SELECT V.user_id, j, V.idx, x FROM V JOIN Fi ON Fi.user_id = V.user_id AND Fi.idx = V.idx""")
def pingpong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled_frames(spark, sf_dir).select("user_id", "idx", "x")
    return gather.pingpong(rows.select("user_id").distinct(), rows, KEYS, "idx", 7, 20).select("user_id", "j", "idx", "x")


@query(f"""WITH {Fr}
SELECT user_id, idx, CAST(floor(idx / 25.0::DOUBLE * 16000) AS BIGINT) AS first, CAST(floor((idx + 1) / 25.0::DOUBLE * 16000) AS BIGINT) AS last FROM Fr WHERE event_type <> 'error'""")
def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).filter("event_type <> 'error'").select("user_id", "idx")
    return gather.sample_ranges(rows, FRAMES, "idx", 25, 16_000).select("user_id", "idx", "first", "last")


@query(f"WITH {FILLED} SELECT user_id, idx, round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY idx), 0), 6) + 0.0 AS z FROM Fi")
def preemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emphasised(spark, sf_dir).select("user_id", "idx", six(F.col("z")).alias("z"))


@query(f"""WITH {Fr}, T AS (SELECT user_id, idx // 3 AS g, x AS x1, y AS y1, CASE idx % 3 WHEN 1 THEN 10 ELSE 0 END AS x2, CASE idx % 3 WHEN 2 THEN 10 ELSE 0 END AS y2 FROM Fr WHERE x IS NOT NULL),
G AS (SELECT user_id, g, count(*) AS n, sum(x1) a1, sum(y1) b1, sum(x2) a2, sum(y2) b2, sum(x1*x2+y1*y2) dp, sum(x1*y2-y1*x2) cp, sum(x1*x1+y1*y1) q1, sum(x2*x2+y2*y2) q2 FROM T GROUP BY ALL),
K AS (SELECT *, atan2(cp - (a1*b2-b1*a2)/n, dp - (a1*a2+b1*b2)/n) AS th, q1 - (a1*a1+b1*b1)/n AS v1, q2 - (a2*a2+b2*b2)/n AS v2 FROM G WHERE n = 3)
SELECT user_id, g, round(th, 4) + 0.0 AS theta, round(sqrt(v2 / v1), 4) + 0.0 AS scale FROM K WHERE v1 > 0.000000001""")
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.col("idx") % 3
    points = frames(spark, sf_dir).filter("x is not null").select("user_id", F.expr("idx div 3").alias("g"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.when(nth == 1, 10.0).otherwise(0.0).alias("x2"), F.when(nth == 2, 10.0).otherwise(0.0).alias("y2"))
    whole = points.groupBy("user_id", "g").agg(F.count("*").alias("_n")).filter("_n = 3").drop("_n")
    fit = vectors.similarity_fit(points.join(whole, ["user_id", "g"], "left_semi"), ["user_id", "g"]).filter("scale is not null")
    return fit.select("user_id", "g", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("theta", "scale")])


@query(f"""WITH {Fr}, L AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS brk FROM Fr WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
R AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM L), E AS (SELECT *, (s_us - min(s_us) OVER (PARTITION BY user_id, run)) // 1000000 AS e, (idx % 50) / 50.0::DOUBLE AS p FROM R)
SELECT user_id, idx, CASE WHEN e >= 3 AND p > 0.02 THEN round_even((1 - p) * e / p, 0) + 0.0 END AS remaining FROM E""")
def eta_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.stage_elapsed(points(spark, sf_dir), SEGMENTS, "event_type", "s_us", "idx")
    return rows.select("user_id", "idx", (jobs.observed_remaining((F.col("idx") % 50) / F.lit(50.0), F.expr("elapsed div 1000000")) + F.lit(0.0)).alias("remaining"))


#: Pairs of event types of which the second may follow the first.
ALLOWED = [("view", "view"), ("view", "click"), ("view", "error"), ("click", "signup"), ("click", "view"), ("click", "error"), ("signup", "purchase"), ("signup", "view"), ("signup", "error"), ("error", "view")]


@query(f"""WITH {Fr}, L AS (SELECT user_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) AS a FROM Fr)
SELECT user_id, count(*) AS illegal FROM L WHERE a IS NOT NULL AND (a, b) NOT IN (VALUES {', '.join(map(str, ALLOWED))}) GROUP BY user_id""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame(ALLOWED, "`from` string, `to` string")
    return jobs.illegal_transitions(frames(spark, sf_dir), FRAMES, "event_type", allowed).groupBy("user_id").agg(F.count("*").alias("illegal"))


@query("""WITH RECURSIVE E AS (SELECT user_id, event_id AS seq, greatest(0, least(1, value / 100)) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
R AS (SELECT user_id, rn, seq, p, p AS seen, CASE WHEN p >= 0.02 THEN p ELSE 0 END AS last, p >= 0.02 AS ok FROM E WHERE rn = 1
  UNION ALL SELECT E.user_id, E.rn, E.seq, E.p, greatest(seen, E.p), CASE WHEN E.p >= seen AND (E.p - last >= 0.02 OR E.p >= 1) THEN E.p ELSE last END, E.p >= seen AND (E.p - last >= 0.02 OR E.p >= 1)
  FROM R JOIN E ON E.user_id = R.user_id AND E.rn = R.rn + 1)
SELECT user_id, seq, p AS emitted FROM R WHERE ok""")
def progress_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), (F.col("value") / 100).alias("p"))
    return scans.throttled(rows, KEYS, "seq", "p")


N_FFT, HOP = 16, 4


@query(f"""WITH {FILLED}, A AS (SELECT user_id, idx, x, unnest(range(greatest(0, (idx - {N_FFT // 2 - 1 - (HOP - 1)}) // {HOP}), least(n // {HOP}, (idx + {N_FFT // 2}) // {HOP}) + 1)) AS frame FROM Fi JOIN N USING (user_id)),
W AS (SELECT user_id, frame, x * (0.5 - 0.5 * cos(2 * pi() * p / {N_FFT})) AS v, p FROM (SELECT *, idx - (frame * {HOP} - {N_FFT // 2}) AS p FROM A) WHERE p >= 0 AND p < {N_FFT}),
B AS (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS bin)
SELECT user_id, frame, bin, round(sqrt(pow(sum(v * cos(2 * pi() * bin * p / {N_FFT})), 2) + pow(sum(v * sin(2 * pi() * bin * p / {N_FFT})), 2)), 4) + 0.0 AS magnitude FROM W, B GROUP BY ALL""")
def stft_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = spectra.stft(filled_frames(spark, sf_dir), KEYS, "idx", "x", N_FFT, HOP)
    return frames.select("user_id", "frame", F.posexplode("magnitude").alias("bin", "m")).select("user_id", "frame", F.col("bin").cast("long").alias("bin"), (F.round("m", 4) + F.lit(0.0)).alias("magnitude"))


def _basis(low: float = 0.0, high: float | None = None) -> str:
    """The bands' weights as SQL rows (band, bin, w); `spectra.mel_basis` is tested by itself."""
    rows = [(b, k, float(w)) for b, row in enumerate(spectra.mel_basis(64, N_FFT, 4, low, high)) for k, w in enumerate(row)]
    return "(VALUES " + ", ".join(f"({b}, {k}, {w!r}::DOUBLE)" for b, k, w in rows) + ") M(band, bin, w)"


_HANN, _DFT = f"(0.5 - 0.5 * cos(2 * pi() * p / {N_FFT}))", f"pow(sum(v * cos(2 * pi() * bin * p / {N_FFT})), 2) + pow(sum(v * sin(2 * pi() * bin * p / {N_FFT})), 2)"


@query(f"""WITH {FILLED}, X AS (SELECT Fi.user_id, n, idx, unnest(list_distinct([idx, CASE WHEN idx BETWEEN 1 AND {N_FFT // 2} THEN -idx END, CASE WHEN 2 * (n - 1) - idx BETWEEN n AND n + {N_FFT // 2 - 1} THEN 2 * (n - 1) - idx END])) AS place, x FROM Fi JOIN N USING (user_id) WHERE n > {N_FFT // 2}),
A AS (SELECT *, unnest(range(0, n // {HOP})) AS frame FROM X WHERE place IS NOT NULL), W AS (SELECT user_id, frame, p, x * {_HANN} AS v FROM (SELECT *, place - (frame * {HOP} - {N_FFT // 2}) AS p FROM A) WHERE p >= 0 AND p < {N_FFT}),
B AS (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS bin), P AS (SELECT user_id, frame, bin, {_DFT} AS power FROM W, B GROUP BY ALL),
L AS (SELECT user_id, frame, band, log10(greatest(1e-10::DOUBLE, sum(power * w))) AS level FROM P JOIN {_basis()} USING (bin) GROUP BY ALL)
SELECT user_id, frame, CAST(band AS BIGINT) AS band, round((greatest(level, max(level) OVER (PARTITION BY user_id) - 8) + 4) / 4, 5) + 0.0 AS mel FROM L""")
def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    mel = spectra.log_mel_spectrogram(filled_frames(spark, sf_dir), KEYS, "idx", "x", rate=64, n_fft=N_FFT, hop=HOP, bands=4)
    return _by_band(mel)


def _by_band(mel: DataFrame) -> DataFrame:
    rows = mel.select("user_id", "frame", F.posexplode("mel").alias("band", "m"))
    return rows.select("user_id", "frame", F.col("band").cast("long").alias("band"), (F.round("m", 5) + F.lit(0.0)).alias("mel"))


@query(f"""WITH {FILLED}, Z AS (SELECT user_id, idx, n, x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY idx), 0) AS z FROM Fi JOIN N USING (user_id)),
A AS (SELECT *, unnest(range(0, n // {HOP} + 1)) AS frame FROM Z), W AS (SELECT user_id, frame, p, z * {_HANN} AS v FROM (SELECT *, idx - (frame * {HOP} - {N_FFT // 2}) AS p FROM A) WHERE p >= 0 AND p < {N_FFT}),
B AS (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS bin), P AS (SELECT user_id, frame, bin, sqrt({_DFT}) AS magnitude FROM W, B GROUP BY ALL),
L AS (SELECT user_id, frame, band, sum(magnitude * w) AS m FROM P JOIN {_basis(1.0, 30.0)} USING (bin) GROUP BY ALL)
SELECT user_id, frame, CAST(band AS BIGINT) AS band, round(least(1, greatest(0, (20 * log10(greatest(1e-5::DOUBLE, m)) - 20 + 100) / 100)), 5) + 0.0 AS mel FROM L""")
def mel_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = emphasised(spark, sf_dir)
    return _by_band(spectra.mel_spectrogram(signal, KEYS, "idx", "z", rate=64, n_fft=N_FFT, hop=HOP, bands=4, low=1.0, high=30.0))


#: Where the five points of a face lie in its picture of 512 by 512 pixels. Fixed values.
FACE_POINTS = [[192.98138, 239.94708], [318.90277, 240.19360], [256.63416, 314.01935], [201.26117, 371.41043], [313.08905, 371.15118]]


@query()
def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five frames of a clip as the points of a face, fitted to the picture; null where one has no point."""
    point = F.struct("idx", F.when(F.col("x").isNotNull(), F.array("x", "y")).alias("p"))
    groups = frames(spark, sf_dir).groupBy("user_id", F.expr("idx div 5").alias("g")).agg(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("points"))
    whole = F.when((F.size("points") == 5) & ~F.exists("points", lambda p: p.isNull()), F.col("points"))
    target = F.lit(str(FACE_POINTS))
    fit = vectors.robust_similarity(whole, F.from_json(target, "array<array<double>>"))
    return groups.select("user_id", "g", fit.alias("f")).select("user_id", "g", "f.*")


TICK, TICK_ETA = 6 * HOUR, 480 * HOUR


@query(f"""WITH {S}, J AS (SELECT user_id, min(s_us) AS s, max(s_us) AS e FROM S GROUP BY user_id), T AS (SELECT user_id, s, unnest(range(s + {TICK}, e, {TICK})) AS tick FROM J),
R AS (SELECT user_id, s_us, (event_id % 100) / 100.0::DOUBLE AS p FROM S JOIN J USING (user_id) WHERE event_type = 'purchase' AND s_us < e)
SELECT T.user_id, tick, round(least(0.99::DOUBLE, coalesce(R.p, (tick - s) / {TICK_ETA}.0::DOUBLE)), 6) + 0.0 AS percent FROM T ASOF LEFT JOIN R ON T.user_id = R.user_id AND T.tick >= R.s_us""")
def ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    stages = rows.groupBy("user_id").agg(F.min("s_us").alias("s"), F.max("s_us").alias("e"), F.lit(TICK_ETA).cast("long").alias("eta"))
    reports = rows.filter("event_type = 'purchase'").select("user_id", "s_us", (F.col("event_id") % 100 / F.lit(100.0)).alias("p"))
    return jobs.ticked(stages, reports, KEYS, "s", "e", "eta", "s_us", "p", TICK).select("user_id", "tick", six(F.col("percent")).alias("percent"))

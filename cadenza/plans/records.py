"""Lookup, validation, job, text, vector and scoring queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import english, signal, text
from ..operators import align, jobs, routing, vectors
from .registry import micros, query, six, table
from .timeline import S, segments

# Language codes, the translation model's names for them, and their English names.
LANGUAGES = [
    ("en", "eng_Latn", "English"), ("es", "spa_Latn", "Spanish"), ("fr", "fra_Latn", "French"), ("de", "deu_Latn", "German"), ("it", "ita_Latn", "Italian"),
    ("pt", "por_Latn", "Portuguese"), ("nl", "nld_Latn", "Dutch"), ("ru", "rus_Cyrl", "Russian"), ("ja", "jpn_Jpan", "Japanese"), ("zh", "zho_Hans", "Chinese"),
    ("hi", "hin_Deva", "Hindi"), ("ar", "arb_Arab", "Arabic"), ("ko", "kor_Hang", "Korean"), ("tr", "tur_Latn", "Turkish"), ("pl", "pol_Latn", "Polish"),
    ("vi", "vie_Latn", "Vietnamese"), ("bn", "ben_Beng", "Bengali"), ("ta", "tam_Taml", "Tamil"), ("te", "tel_Telu", "Telugu"), ("mr", "mar_Deva", "Marathi"),
    ("gu", "guj_Gujr", "Gujarati"), ("kn", "kan_Knda", "Kannada"), ("ml", "mal_Mlym", "Malayalam"), ("pa", "pan_Guru", "Punjabi"), ("or", "ory_Orya", "Odia"), ("as", "asm_Beng", "Assamese"),
]
# Speech backends by language, best first, and those that are there.
INDIC = ["hi", "bn", "ta", "te", "mr", "gu", "kn", "ml", "pa", "or", "as"]
PREFERENCES = {
    **dict.fromkeys(INDIC, ["indicf5", "xtts"]), "zh": ["f5tts", "xtts"], "zh-cn": ["f5tts", "xtts"], "en": ["f5tts", "xtts"], "ja": ["styletts2-jp", "melotts", "xtts"], "ko": ["melotts", "styletts2-ko", "xtts"],
    **dict.fromkeys(["es", "pt", "it", "de", "nl", "pl", "cs", "ru", "tr", "ar", "hu"], ["xtts"]), "fr": ["xtts", "f5tts"],
}
READY, DEFAULT = ["xtts", "f5tts", "indicf5"], "xtts"
PREFS = [(lang, b, i) for lang, prefs in PREFERENCES.items() for i, b in enumerate(prefs)]
_values = lambda rows: ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)
_LANG = f"M AS (SELECT * FROM (VALUES {_values(LANGUAGES)}) v(lang, mapped, name))"


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "lang string, mapped string, name string")


@query(f"WITH {_LANG} SELECT doc_id, d.lang AS code, coalesce(mapped, 'und_Zyyy') AS mapped, coalesce(name, d.lang) AS name FROM documents d LEFT JOIN M USING (lang)")
def lang_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = languages(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = routing.lookup(routing.lookup(docs, names, "lang", "mapped", F.lit("und_Zyyy")), names, "lang", "name", F.col("lang"))
    return found.select("doc_id", F.col("lang").alias("code"), "mapped", "name")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'es', 'fr') OR lang IS NULL GROUP BY lang")
def unsupported_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.unsupported(table(spark, sf_dir, "documents"), languages(spark).filter(F.col("lang").isin("en", "es", "fr")), "lang")


@query(f"""WITH P AS (SELECT * FROM (VALUES {_values(PREFS)}) v(lang, backend, rank)), C AS (SELECT lang, arg_min(backend, rank) AS ideal, arg_min(backend, rank) FILTER (backend IN ('xtts', 'f5tts', 'indicf5')) AS chosen FROM P GROUP BY lang)
SELECT doc_id, d.lang, coalesce(chosen, 'xtts') AS backend, CASE WHEN chosen IS NULL THEN 'xtts' ELSE ideal END AS ideal, chosen IS NOT NULL AND chosen <> ideal AS suboptimal FROM documents d LEFT JOIN C USING (lang)""")
def backend_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefs = spark.createDataFrame(PREFS, "lang string, backend string, rank int")
    ready = spark.createDataFrame([(b,) for b in READY], "backend string")
    return routing.choose_backend(table(spark, sf_dir, "documents").select("doc_id", "lang"), prefs, ready, "lang", DEFAULT)


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'backend' WHEN value / 100 < 0.02 OR value / 100 > 0.3 THEN 'feather'
WHEN event_id % 6 = 4 THEN 'toggle' END AS reject_reason FROM events""")
def knob_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    toggle = F.element_at(F.array(*map(F.lit, ["1", "false", "YES", " off ", "maybe", None])), (F.col("event_id") % 6 + 1).cast("int"))
    rules = [
        ("backend", routing.not_in(F.upper("event_type"), ["view", "click", "signup"])),
        ("feather", routing.outside(F.col("value") / 100, 0.02, 0.3)),
        ("toggle", toggle.isNotNull() & routing.to_boolean(toggle).isNull()),
    ]
    return table(spark, sf_dir, "events").select("event_id", routing.first_failure(rules).alias("reject_reason"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'final' WHEN event_id % 3 = 0 THEN 'lipsynced' WHEN event_id % 5 = 0 THEN 'input' END AS chosen FROM events")
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", routing.first_available([("final", i % 2 == 0), ("lipsynced", i % 3 == 0), ("input", i % 5 == 0)]).alias("chosen"))


@query("SELECT o_orderkey, o_orderstatus AS status, epoch_us(o_orderdate) AS created_us FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), micros("o_orderdate").alias("created_us"))
    return jobs.newest(rows, "created_us", "o_orderkey", 1_000)


@query("""WITH P AS (SELECT DISTINCT substr(p_name, 1, 6) AS prefix FROM part UNION SELECT 'zzzzzz')
SELECT prefix, CASE count(DISTINCT p_name) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS outcome FROM P LEFT JOIN part ON starts_with(p_name, prefix) AND length(prefix) = 6 GROUP BY prefix""")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name").filter(F.length("p_name") >= 6)
    prefixes = parts.select(F.substring("p_name", 1, 6).alias("prefix")).unionByName(spark.createDataFrame([("zzzzzz",)], "prefix string")).distinct()
    return jobs.prefix_outcome(prefixes, parts, "prefix", "p_name", 6)


@query("""WITH U AS (SELECT DISTINCT user_id FROM events), T AS (SELECT user_id, unnest(range(0, 8)) AS pos FROM U),
R AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT T.user_id, CAST(T.pos AS INTEGER) AS pos, CASE WHEN event_type IS NULL THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status FROM T LEFT JOIN R ON R.user_id = T.user_id AND R.pos = T.pos""")
def stage_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = jobs.cap_per_key(segments(spark, sf_dir), ("user_id",), [F.col("s_us"), F.col("event_id")], 8)
    numbered = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s_us", "event_id", "event_type"))).alias("e")).select("user_id", F.posexplode("e").alias("pos", "e"))
    records = numbered.select("user_id", "pos", F.when(F.col("e.event_type") == "error", "failed").otherwise("done").alias("status"))
    return jobs.with_stage_status(records.select("user_id").distinct(), records, ("user_id",)).select("user_id", "pos", "status")


@query("""SELECT p_partkey, CASE WHEN q IS NULL THEN 'missing' WHEN q < 45 THEN 'small' ELSE 'ok' END AS status FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "part").select("p_partkey", F.lit(45.0).alias("least"))
    present = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return jobs.missing_items(manifest, present, "p_partkey", "l_quantity", "least")


@query("""WITH T AS (SELECT o_orderkey, o_totalprice / 1000 AS src, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 15.0 WHEN 2 THEN 200.0 ELSE 1080.0 END::DOUBLE AS factor, unnest(['audio','stabilize','transcribe','translate','tts','lipsync','poststabilize','mux']) AS stage FROM orders)
SELECT o_orderkey, stage, round(CASE stage WHEN 'audio' THEN 1.0 WHEN 'mux' THEN 2.0 WHEN 'transcribe' THEN greatest(2.0, src / 6) WHEN 'translate' THEN greatest(3.0, src / 2) WHEN 'tts' THEN greatest(5.0, src * 2) WHEN 'lipsync' THEN src * factor ELSE greatest(3.0, src * 2) END::DOUBLE, 6) AS eta FROM T""")
def eta_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = F.element_at(F.array(*map(F.lit, jobs.COST)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = jobs.stage_rows(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("src"), backend.alias("backend")))
    return rows.select("o_orderkey", "stage", F.round(jobs.static_eta(F.col("stage"), F.col("src"), F.col("backend")), 6).alias("eta"))


@query("""SELECT event_id, round(CASE event_type WHEN 'click' THEN 0.25 * s WHEN 'signup' THEN 0.25 + 0.65 * s WHEN 'view' THEN 0.9 + 0.08 * s WHEN 'purchase' THEN 0.98 + 0.02 * s END::DOUBLE, 6) AS pct FROM (SELECT *, least(1.0, value / 50)::DOUBLE AS s FROM events)""")
def progress_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.element_at(F.create_map(*[F.lit(x) for pair in zip(("click", "signup", "view", "purchase"), jobs.PHASES) for x in pair]), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.round(jobs.weighted_progress(phase, F.col("value") / 50), 6).alias("pct"))


@query("SELECT user_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(table(spark, sf_dir, "events"), ("user_id",), "ts", "event_id").select("user_id", "event_id", F.col("event_type").alias("status"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cap_per_key(table(spark, sf_dir, "events"), ("user_id",), [F.col("value").desc(), F.col("event_id")], 3).select("user_id", "event_id")


_TOKENS = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> '')"


@query(rf"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS hash FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)")
def norm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", align.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("hash"))


@query(rf"SELECT lang, count(w) AS total, count(DISTINCT w) AS distinct_n FROM (SELECT lang, unnest({_TOKENS}) AS w FROM documents) GROUP BY lang")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(align.tokens(F.col("text"))).alias("w"))
    return words.groupBy("lang", "w").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_n"))


@query(r"""SELECT conv_id, md5(string_agg(t, ' ' ORDER BY turn)) AS text_hash FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""")
def text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip(F.col("text")).alias("t")).filter("t <> ''")
    return text.joined_digest(rows, ("conv_id",), "turn", "t", " ", "text_hash")


@query("SELECT conv_id, coalesce(min(turn) FILTER (role = 'assistant'), min(turn)) AS turn FROM conversations GROUP BY conv_id")
def first_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("role") == "assistant", F.col("turn"))), F.min("turn")).alias("turn"))


@query("""WITH C AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN u = a AND u > 1 THEN 'segments' ELSE 'whole' END AS mode, least(u, a) AS pairs FROM C""")
def segment_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda role: F.count_if(F.col("role") == role)
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"))
    return counts.select("conv_id", F.when((F.col("u") == F.col("a")) & (F.col("u") > 1), "segments").otherwise("whole").alias("mode"), F.least("u", "a").alias("pairs"))


_PAIRS = """T AS (SELECT conv_id, role, turn, md5(text) AS h, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations WHERE role IN ('user', 'assistant'))"""


@query(f"WITH {_PAIRS} SELECT a.conv_id, CAST(a.pos AS BIGINT) AS pos, a.turn AS asked, b.turn AS answered FROM T a JOIN T b ON a.conv_id = b.conv_id AND a.pos = b.pos AND a.role = 'user' AND b.role = 'assistant'")
def segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import Timeline, numbered

    rows = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant")).select("conv_id", "role", F.col("turn").cast("long").alias("turn"))
    placed = numbered(rows, Timeline(("conv_id", "role"), ("turn",), 4_096), "pos")
    side = lambda role, name: placed.filter(F.col("role") == role).select("conv_id", "pos", F.col("turn").alias(name))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "pos"])


_CLOCK = lambda ms: f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@query(f"""WITH {S}, T AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY s_us, event_id) AS n, CAST(round_even((s_us - min(s_us) OVER (PARTITION BY user_id)) / 1000, 0) AS BIGINT) AS a,
CAST(round_even((e_us - min(s_us) OVER (PARTITION BY user_id)) / 1000, 0) AS BIGINT) AS b FROM S) SELECT user_id, event_id, n || chr(10) || {_CLOCK('a')} || ' --> ' || {_CLOCK('b')} || chr(10) || event_type || chr(10) AS line FROM T""")
def srt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import first_known, numbered
    from .timeline import SEGMENTS

    rows = first_known(numbered(segments(spark, sf_dir), SEGMENTS, "n"), SEGMENTS, {"zero": F.col("s_us")})
    ms = lambda c: text.whole_ms(F.col(c) - F.col("zero"))
    return rows.select("user_id", "event_id", text.srt_block_ms(F.col("n") + 1, ms("s_us"), ms("e_us"), F.col("event_type")).alias("line"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as expected ones, documents of the same number as what was heard; word i ends at (i + 1) * 0.25 s."""
    expected = table(spark, sf_dir, "benchmark").select("item_id", align.tokens(F.col("text")).alias("expected"))
    heard = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), align.tokens(F.col("text")).alias("w"))
    words = F.transform("w", lambda w, i: F.struct(w.alias("word"), ((i + 1) * 250_000).cast("long").alias("end")))
    both = expected.join(heard, "item_id").withColumn("words", words)
    return both.select("item_id", F.size("w").cast("long").alias("heard"), align.align(F.col("words"), F.col("expected")).alias("a")).select("item_id", "heard", "a.*")


_TOKENS = lambda c: rf"""list_filter(list_transform(regexp_split_to_array({c}, '\s+'), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> '')"""
_ALIGNED = f"""B AS (SELECT item_id, {_TOKENS('b.text')} AS x, {_TOKENS('d.text')} AS w FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
A AS (SELECT item_id, x, w, 0 AS i, 0 AS pos, 0 AS misses, CAST(NULL AS BIGINT) AS last_end, false AS done FROM B
  UNION ALL SELECT item_id, x, w, i + 1, CASE WHEN hit THEN pos + 1 ELSE pos END, CASE WHEN hit THEN 0 ELSE misses + 1 END, CASE WHEN hit THEN (i + 1) * 250000 ELSE last_end END, NOT hit AND misses + 1 >= 3 AND last_end IS NOT NULL
  FROM (SELECT *, coalesce(w[i + 1] = x[pos + 1] OR (length(w[i + 1]) >= 3 AND starts_with(x[pos + 1], w[i + 1])) OR (length(x[pos + 1]) >= 3 AND starts_with(w[i + 1], x[pos + 1])), false) AS hit FROM A) WHERE i < len(w) AND pos < len(x) AND NOT done),
R AS (SELECT item_id, len(w) AS heard, CAST(pos AS BIGINT) AS matched, len(x) AS expected_n, last_end FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i DESC) AS r FROM A) WHERE r = 1)"""


@query(f"WITH RECURSIVE {_ALIGNED} SELECT * FROM R")
def align_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)


@query(f"""WITH RECURSIVE {_ALIGNED}, T AS (SELECT *, CASE WHEN matched / greatest(1, expected_n) >= 0.5 THEN last_end END AS tier1, CASE WHEN heard % 3 <> 0 THEN heard * 200000 END AS seg, heard * 300000 AS current, expected_n * 250000 AS source FROM R),
C AS (SELECT *, CASE WHEN tier1 IS NULL THEN seg WHEN seg IS NULL THEN tier1 ELSE greatest(tier1, seg) END AS chosen FROM T), X AS (SELECT *, CASE WHEN chosen IS NOT NULL THEN least(current, chosen + 80000) END AS trim_to FROM C)
SELECT item_id, CASE WHEN chosen IS NULL THEN 'none' WHEN coalesce(chosen = tier1, false) THEN 'word-align' ELSE 'vad-segment' END AS tier, CAST(trim_to AS BIGINT) AS trim_to,
  CASE WHEN chosen IS NULL THEN 'no-endpoint' WHEN source > 0 AND trim_to < source * 0.5 THEN 'below-floor' WHEN current - trim_to < 100000 THEN 'little-gain' ELSE 'trim' END AS action FROM X""")
def tail_trim_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir)
    current = F.col("heard") * 300_000
    said = align.tail_trim(F.col("matched"), F.col("expected_n"), F.col("last_end"), F.when(F.col("heard") % 3 != 0, F.col("heard") * 200_000), current, F.col("expected_n") * 250_000)
    return rows.select("item_id", *[c.alias(n) for n, c in said.items()])


_CODES = """C AS (SELECT label AS code, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings GROUP BY label), V AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def _codebook(rows: DataFrame) -> DataFrame:
    """One vector per label, that of the smallest id."""
    return rows.groupBy(F.col("label").alias("code")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query(f"WITH {_CODES} SELECT vec_id, first(code ORDER BY list_distance(v, c), code) AS code FROM V, C GROUP BY vec_id")
def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest_code(rows, _codebook(rows), "vec_id", "code", "embedding")


@query(f"""WITH {_CODES}, R AS (SELECT vec_id, code, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, code) AS INTEGER) AS rank FROM V, C) SELECT * FROM R WHERE rank <= 3""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.cosine_top(rows, _codebook(rows), "vec_id", "code", "embedding", 3)


@query("""SELECT event_type, first(event_id ORDER BY round(value / pow((5.0::DOUBLE + event_id % 17 + 1) / 6, 0.6), 6) DESC, event_id) AS best_id FROM events GROUP BY event_type""")
def length_norm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(signal.length_normalised(F.col("value"), F.col("event_id") % 17 + 1, 0.6), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct(score, -F.col("event_id"))).alias("best_id"))


@query("SELECT substr(sha256(coalesce(text, '') || '|' || coalesce(lang, '')), 1, 16) AS key, count(*) AS n FROM documents GROUP BY key")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring(F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit(""))), 256), 1, 16)
    return table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(sum(p * -ln(p)), 4) AS entropy FROM (SELECT event_type, exp((value - max(value) OVER w) / 50) / sum(exp((value - m) / 50)) OVER w AS p FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events)
WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type""")
def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-sum(p ln p) = ln(Z) - sum(w x) / Z with w = exp(x - max): sums only, so a hot key is combined before the shuffle."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 50).alias("x"))
    peaks = rows.groupBy("event_type").agg(F.max("x").alias("m"))
    w = F.exp(F.col("x") - F.col("m"))
    sums = rows.join(routing.small(peaks), "event_type").groupBy("event_type").agg(F.sum(w).alias("z"), F.sum(w * (F.col("x") - F.col("m"))).alias("wx"))
    return sums.select("event_type", F.round(F.log("z") - F.col("wx") / F.col("z"), 4).alias("entropy"))


@query("""WITH L AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id), R AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT coalesce(L.user_id, R.user_id) AS user_id, CASE WHEN L.n IS NULL THEN 'added' WHEN R.n IS NULL THEN 'removed' WHEN L.n <> R.n THEN 'changed' ELSE 'same' END AS change FROM L FULL OUTER JOIN R ON L.user_id = R.user_id""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    side = lambda kind, name: rows.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return side("view", "old").join(side("click", "new"), "user_id", "full").select("user_id", change.alias("change"))


@query(r"""SELECT event_id, round(20 * log10(greatest(0.00001, value / 500)), 6) + 0.0 AS db, round(greatest(0.2, least(0.8, value / 100))::DOUBLE, 6) AS held,
CASE WHEN value > 40.05 AND 40 / value >= 0.85 THEN round(40 / value, 6) END AS stretch, CASE WHEN ceil(value) >= 60 THEN CAST(ceil(value) AS BIGINT) // 60 || 'm ' || CAST(ceil(value) AS BIGINT) % 60 || 's' ELSE CAST(ceil(value) AS BIGINT) || 's' END AS said,
round(greatest(0, value - 30)::DOUBLE, 6) AS pad_seconds, value > 30 OR event_id % 2 = 0 AS reencode, value >= 50 AND value * 1.5 >= 80 AND event_id % 10 >= 5 AS face FROM events""")
def signal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    plan = signal.mux_plan(F.lit(30.0), v, i % 2 == 0)
    return table(spark, sf_dir, "events").select(
        "event_id", six(signal.decibels(v / 500)).alias("db"), F.round(signal.clamp(v / 100, 0.2, 0.8), 6).alias("held"), F.round(signal.stretch(v, F.lit(40.0)), 6).alias("stretch"),
        signal.human_duration(v).alias("said"), F.round(plan["pad_seconds"], 6).alias("pad_seconds"), plan["reencode"].alias("reencode"), signal.face_ok(v, v * 1.5, (i % 10) / 10).alias("face"),
    )


@query(r"""SELECT page_id, lower(regexp_extract(url, '[^./\\](\.[^./\\]*)$', 1)) AS ext, replace(replace(replace(url, '\', '\\'), ':', '\:'), '''', '\''') AS drawn, CAST(len(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS parts FROM pages""")
def text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.size(text.listed(F.replace("url", F.lit("/"), F.lit(","))))
    return table(spark, sf_dir, "pages").select("page_id", text.extension(F.col("url")).alias("ext"), text.drawtext_escape(F.col("url")).alias("drawn"), parts.alias("parts"))


@query()
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.basic_normal(t)).alias("kept"), F.md5(text.basic_normal(t, False)).alias("plain"), F.round(text.compression_ratio(t), 6).alias("ratio"))


@query("""SELECT label, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label""")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rows.groupBy("label").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_samp("x"), 5).alias("std"), F.count("*").alias("n"))


@query()
def english_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(english.english_normal(F.coalesce("text", F.lit("")))).alias("form"))

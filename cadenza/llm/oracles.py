"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force or exact round trips."""

ORACLES: dict[str, str] = {}

ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# A turn is <|turn ROLE|>BODY<|end|> and a line end; \\, < and | are escaped by a backslash in ROLE and BODY.
ORACLES["op6_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(length(regexp_replace(role, '[\\<|]', '__', 'g')) + length(regexp_replace(text, '[\\<|]', '__', 'g')) + 17) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

ORACLES["op7_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || CAST(row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1 AS VARCHAR) AS own
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM per
), filled AS (
  SELECT source, source_size, weight, cap,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         round(CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE (SELECT max(level) FROM filled WHERE level * weight < cap) * weight END, 6) AS target
  FROM filled
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || own), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""

# CRC-32 over the bytes of a text: a table of 256 entries by the bitwise rule, then one step for each byte.
ORACLES["op5_sharding"] = r"""
WITH RECURSIVE R(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM R WHERE k < 8
), T AS (SELECT list(c ORDER BY i) AS t FROM R WHERE k = 8),
B AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
C AS (
  SELECT doc_id, CAST(len(b) + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM B, T
), S AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS every_byte FROM C
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), P AS (SELECT *, CAST(least(23, (2 * upto - size) * 24 // (2 * every_byte)) AS INTEGER) AS shard FROM S)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM P
"""

ORACLES["op11_filter_audit"] = r"""
WITH D AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), F AS (
  SELECT D.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(D.doc_id > min(D.doc_id) OVER (PARTITION BY text), false)] AS f
  FROM D
), L AS (SELECT doc_id, max(quality) FILTER (quality = 1) AS good, max(toxic) FILTER (toxic = 1) AS toxic FROM labels GROUP BY doc_id),
N AS (SELECT part, f, count(*) AS n, count(good) AS good, count(toxic) AS toxic FROM F LEFT JOIN L USING (doc_id) GROUP BY ALL),
C AS (SELECT unnest(range(1, 6)) AS c),
O AS (SELECT [a.c, b.c, x.c, y.c, z.c] AS o FROM C a, C b, C x, C y, C z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
S AS (SELECT o, s, o[s] AS own, o[:s - 1] AS earlier FROM O, (SELECT unnest(range(1, 6)) AS s)),
R AS (
  SELECT part, o, s, own,
         sum(n) FILTER (NOT f[own] AND NOT gone) AS kept, sum(n) FILTER (f[own] AND NOT gone) AS removed, sum(n) FILTER (f[own] AND gone) AS redundant,
         sum(n) FILTER (f[own] AND len(list_filter(f, lambda x: x)) = 1) AS alone, sum(good) FILTER (f[own] AND NOT gone) AS good, sum(toxic) FILTER (f[own] AND NOT gone) AS toxic
  FROM (SELECT N.*, S.*, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone FROM N, S) GROUP BY part, o, s, own
)
SELECT part, array_to_string(list_transform(o, lambda i: chr(CAST(64 + i AS INTEGER))), '') AS filter_order, CAST(s AS INTEGER) AS step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM R
"""

# Features are counted by text before their CRC is taken, byte by byte as in op5's SQL.
ORACLES["op12_resampling"] = r"""
WITH RECURSIVE R(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM R WHERE k < 8
), T AS (SELECT list(c ORDER BY i) AS t FROM R WHERE k = 8),
A AS (
  SELECT doc_id AS id, true AS own, row_number() OVER () AS nth, text FROM documents
  UNION ALL SELECT item_id, false, row_number() OVER (), text FROM benchmark
), W AS (
  SELECT id, own, nth, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM A
), G AS (
  SELECT own, nth, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM W
), K AS (SELECT own, nth, g, count(*) AS n FROM G GROUP BY ALL),
H AS (
  SELECT g, CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
         lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS BIGINT) % 10000 AS b
  FROM (SELECT DISTINCT g FROM K), T
), N AS (SELECT own, nth, b, sum(n) AS n FROM K JOIN H USING (g) GROUP BY ALL),
B AS (SELECT b, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM N GROUP BY b),
V AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM B
), P AS (SELECT nth, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM N JOIN V USING (b) WHERE own GROUP BY nth),
S AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS gumbel
  FROM W LEFT JOIN P USING (nth) WHERE own
), Q AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + gumbel DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (words >= 20) OVER () AS able FROM S
)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN words >= 20 AND r <= 25 * able // 100 THEN r END AS rank FROM Q
"""

ORACLES["op13_url_filter"] = r"""
WITH U AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
P AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM U
), L AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
H AS (
  SELECT host, regexp_replace(host, '\.?(:[0-9]*)?$', '') AS bare, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM P LEFT JOIN L ON page_id = doc_id GROUP BY host
), S AS (
  SELECT host, n, bad, regexp_matches(bare, '^[0-9]+(\.[0-9]+){3}$') OR bare LIKE '[%' AS number, bare, string_split(bare, '.') AS l FROM H
), D AS (
  SELECT host, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad,
         CASE WHEN number THEN bare WHEN long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN number THEN '' WHEN long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM (SELECT *, array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'co.jp', 'ne.jp', 'co.nz', 'co.za', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'co.in', 'co.kr') AS long FROM S)
), D3 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM D GROUP BY suffix),
M3 AS (SELECT *, CASE WHEN sum(n) OVER () > 0 THEN (sum(bad) OVER () + 0.5) / (sum(n) OVER () + 1) ELSE 0.5 END AS m FROM D3),
K3 AS (SELECT round(1 / least(0.5, greatest(0.001, coalesce(sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1, 6) AS k FROM M3),
P3 AS (SELECT suffix, (m * k + bad) / (n + k) AS m FROM M3, K3),
M2 AS (SELECT domain, suffix, n, bad, m FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM D GROUP BY domain, suffix) JOIN P3 USING (suffix)),
K2 AS (SELECT round(1 / least(0.5, greatest(0.001, coalesce(sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1, 6) AS k FROM M2),
P2 AS (SELECT domain, (m * k + bad) / (n + k) AS m FROM M2, K2),
M1 AS (SELECT host, n, bad, m FROM D JOIN P2 USING (domain)),
K1 AS (SELECT round(1 / least(0.5, greatest(0.001, coalesce(sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1, 6) AS k FROM M1),
P1 AS (SELECT host, n + k AS size, (m * k + bad) / (n + k) AS m FROM M1, K1),
V AS (SELECT page_id, host, path, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS method FROM P JOIN P1 USING (host)),
R AS (
  SELECT *, '.' || host AS h, '.' || host LIKE '%.example.org' AS eo, '.' || host LIKE '%.org' AS o, '.' || host LIKE '%.com' AS c FROM V
), F AS (
  SELECT *, CASE WHEN eo AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN eo AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN c AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN c AND starts_with(path, '/de/') THEN 'com/de/' WHEN o AND starts_with(path, '/') THEN 'org/' END AS rule FROM R
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE method END AS verdict FROM F
"""

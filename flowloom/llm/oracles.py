"""DuckDB texts of the text operators that SQL can state."""

from __future__ import annotations

from .urlgraph import DAMPING, LINK, LONGEST_HOST, ROUNDS, THRESHOLD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS gram FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS gram FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
h AS (SELECT doc_id, k, p.n, item FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM h, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

_PATTERN = LINK.replace("'", "''")
_HEAD = f"""WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT page_id, html, host, path, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM c),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
sh AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0 END) AS b FROM v WHERE host <> '' GROUP BY host),
lk AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_PATTERN}', 1)), '{UPPER}', '{LOWER}') AS dst FROM v) WHERE src <> '' AND src <> dst GROUP BY ALL),
nm AS (SELECT host FROM v UNION SELECT dst FROM lk),
ls AS (SELECT string_split(host, '.') AS l FROM nm WHERE length(host) <= {LONGEST_HOST} AND len(string_split(host, '.')) > 2),
kin AS (SELECT DISTINCT array_to_string(l[k:], '.') AS x, array_to_string(l[k + 1:], '.') AS y FROM ls, unnest(range(1, len(l) - 1)) AS t(k)),
e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1 + ln(n) AS w FROM lk UNION ALL SELECT x, y, 1 FROM kin UNION ALL SELECT y, x, 1 FROM kin) GROUP BY ALL),
wy AS (SELECT src AS giver, dst AS taker, 0 AS kind, w FROM e UNION ALL SELECT dst, src, 1, w FROM e),
ws AS (SELECT giver, taker, kind, w / sum(w) OVER (PARTITION BY giver, kind) AS share FROM wy),
sd AS (SELECT host, 0 AS kind, a / sum(a) OVER () AS seed FROM sh WHERE a > 0 UNION ALL SELECT host, 1, b / sum(b) OVER () FROM sh WHERE b > 0),
s0 AS (SELECT host, kind, seed AS score FROM sd)"""
_STEP = f", s{{j}} AS (SELECT host, kind, sum(score) AS score FROM (SELECT taker AS host, ws.kind, {DAMPING} * share * score AS score FROM ws JOIN s{{i}} s ON s.host = ws.giver AND s.kind = ws.kind UNION ALL SELECT host, kind, {1 - DAMPING} * seed FROM sd) GROUP BY ALL)"
OP10 = _HEAD + "".join(_STEP.format(i=i, j=i + 1) for i in range(ROUNDS)) + f""",
sc AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 0), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 1), 0) AS distrust FROM s{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > 0 AND distrust >= {THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN sc USING (host)"""

#: The bit pattern of the CRC-32 polynomial, and one step of the checksum for each of a byte's eight bits.
_BIT = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
_TABLE = "WITH RECURSIVE bits AS (SELECT i, 0 AS step, i AS c FROM range(256) AS t(i) UNION ALL SELECT i, step + 1, " + _BIT.format(c="c") + " FROM bits WHERE step < 8), crc AS (SELECT list(c ORDER BY i) AS byte FROM bits WHERE step = 8)"
OP12 = f"""{_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT unnest(w) AS word FROM d), g AS (SELECT unnest(w) AS word FROM (SELECT {_WORDS} AS w FROM benchmark)),
n AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, count(*) AS s, 0 AS t FROM f GROUP BY word UNION ALL SELECT word, 0, count(*) FROM g GROUP BY word) GROUP BY word),
x AS (SELECT word, s, t, lower(hex(encode(word))) AS h FROM n),
y AS (SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, [(instr('0123456789abcdef', h[2 * k + 1]) - 1) * 16 + instr('0123456789abcdef', h[2 * k + 2]) - 1 FOR k IN range(length(h) // 2)]), lambda c, b: xor(c >> 8, crc.byte[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, crc),
z AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM y GROUP BY bucket),
a AS (SELECT bucket, CAST(floor(1000 * ln((t::DOUBLE + 1) * ((SELECT sum(s) FROM z)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT sum(t) FROM z)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM z),
e AS (SELECT doc_id, len(w) AS n_features, w FROM d),
o AS (SELECT doc_id, sum(gain) AS gain FROM (SELECT doc_id, unnest(w) AS word FROM e) JOIN y USING (word) JOIN a USING (bucket) GROUP BY doc_id),
p AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CASE WHEN n_features = 0 THEN 0 ELSE (gain - ((gain % n_features) + n_features) % n_features) // n_features END AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM e LEFT JOIN o USING (doc_id)),
q AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM p),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS draw FROM q WHERE n_features >= 20)
SELECT q.doc_id, n_features, weight, score, r.rank FROM q LEFT JOIN r ON r.doc_id = q.doc_id AND r.rank <= r.draw"""

_SPACED = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP13 = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
d AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY part, fails),
u AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d, e.k AS e FROM u a, u b, u c, u d, u e WHERE b.k <> a.k AND c.k NOT IN (a.k, b.k) AND d.k NOT IN (a.k, b.k, c.k) AND e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT [a, b, c, d, e] AS way, array_to_string(['ABCDE'[x] FOR x IN [a, b, c, d, e]], '') AS filter_order, u.k AS step FROM o, u),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, way[step] AS f, n, good, toxic, fails[way[step]] AS hit, len([x FOR x IN way[1:step - 1] IF fails[x]]) > 0 AS gone, len([x FOR x IN fails IF x]) AS n_fails FROM m, s),
t AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE hit AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM t"""

ORACLE_SQL = {"op6_decontamination": OP6, "op10_url_graph": OP10, "op12_resampling": OP12, "op13_interaction": OP13}

"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER b, 0) AS held_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight,
        sum(source_size) OVER () AS total
      FROM w WINDOW b AS (ORDER BY source_size * 1.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - held_before)::BIGINT::DOUBLE / open_weight::BIGINT) AS level FROM c
      WHERE 3 * source_size > (total - held_before)::BIGINT::DOUBLE / open_weight::BIGINT * weight),
t AS (SELECT w.source, w.source_size, least((3 * source_size)::DOUBLE, coalesce(level, 1e300) * weight) AS target FROM w, l),
g AS (SELECT t.*, (weight - 2) * 0.8::DOUBLE AS tilt FROM (SELECT w.source, w.weight, t.source_size, t.target FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source) t),
ab AS (SELECT sum(target * tilt) AS a, sum(target * (1 - tilt)) AS b FROM g),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.tilt, a, b, floor(g.target)::BIGINT AS aim,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, ab),
k AS (SELECT *, CASE WHEN source_size > 0 THEN aim // source_size ELSE 0 END AS whole FROM p),
r AS (SELECT *, greatest(0, least(size, aim - whole * source_size - pos)) AS rest FROM k),
n AS (SELECT *, CASE WHEN size > 0 THEN whole + (rest > 0)::BIGINT ELSE 0 END AS passes FROM r),
x AS (SELECT *, pos / target AS s1, ((passes - 1) * source_size + pos) / target AS s2 FROM n),
y AS (SELECT *, 2 * s1 / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * s1)) AS t1, 2 * s2 / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * s2)) AS t2 FROM x)
SELECT doc_id, size, source_size, target, (whole * size + rest)::BIGINT AS taken, passes::BIGINT AS passes,
  CASE WHEN passes > 0 THEN round(a * t1 * t1 + b * t1, 2) END AS position, CASE WHEN passes > 0 THEN round(a * t2 * t2 + b * t2, 2) END AS last_position
FROM y
"""

_TOKENS = r"""
u AS (SELECT url, url LIKE '%://%' AS ok,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query,
  translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
t AS (SELECT DISTINCT url, unnest(list_concat(['s:' || scheme],
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'h:' || array_to_string(string_split(host, '.')[len(string_split(host, '.')) - i + 1 :], '.')),
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: 'p:' || regexp_replace(s, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(query, '&'), lambda s: s <> ''), lambda s: 'q:' || string_split(s, '=')[1]),
    CASE WHEN url LIKE '%#%' THEN ['f:'] ELSE [] END)) AS token FROM u WHERE ok)"""

URL_FILTER = rf"""
WITH {_TOKENS},
b AS (SELECT doc_id AS page_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad FROM labels GROUP BY 1),
r AS (SELECT row_number() OVER () AS id, url, bad FROM pages JOIN b USING (page_id)),
n AS (SELECT count(*) AS n FROM r),
f AS (SELECT token, count(*) AS c FROM r JOIN t USING (url) GROUP BY 1 HAVING count(*) >= (SELECT greatest(n * 0.005, 5) FROM n)),
k AS (SELECT id, bad, token FROM r JOIN t USING (url) JOIN f USING (token)),
i AS (SELECT [token] AS tokens, bad FROM k UNION ALL
      SELECT [a.token, b.token], a.bad FROM k a JOIN k b ON a.id = b.id AND a.token < b.token UNION ALL
      SELECT [a.token, b.token, c.token], a.bad FROM k a JOIN k b ON a.id = b.id AND a.token < b.token JOIN k c ON b.id = c.id AND b.token < c.token),
g AS (SELECT tokens, count(*) AS freq, sum(bad) AS hits, sum(bad) / count(*) AS confidence FROM i GROUP BY 1
      HAVING sum(bad) >= (SELECT greatest(ceil(n * 0.005), 5) FROM n) AND sum(bad) / count(*) >= 0.6),
m AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE len(h.tokens) < len(g.tokens) AND list_has_all(g.tokens, h.tokens) AND h.confidence >= g.confidence)),
l AS (SELECT url, list(token) AS have FROM t GROUP BY 1),
x AS (SELECT url, max({{'c': confidence, 'r': array_to_string(tokens, ' ')}}) AS b FROM l, m WHERE list_has_all(have, tokens) GROUP BY 1),
o AS (SELECT page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, x.b.r AS mined_rule, x.b.c AS confidence
      FROM pages LEFT JOIN u USING (url) LEFT JOIN x USING (url)),
v AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM o)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined_rule, confidence FROM v
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS lead FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lead IS NOT NULL AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


def cluster(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds one after the other, over all vectors."""
    near = """
  SELECT vec_id, q, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, cluster) AS n FROM (
    SELECT v.rid, v.vec_id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c} c)) WHERE n = 1"""
    steps = ""
    for i in range(rounds):
        steps += f"""
a{i} AS MATERIALIZED ({near.format(c=f"c{i}")}),
s{i} AS (SELECT cluster, coord, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS coord, unnest(q) AS x FROM a{i}) GROUP BY 1, 2),
m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY coord) AS c FROM s{i} GROUP BY 1),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster)),"""
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), q) - 1)::INT AS cluster, q AS c FROM v ORDER BY 1 LIMIT {k}),{steps}
f AS MATERIALIZED ({near.format(c=f"c{rounds}")})
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c{rounds} USING (cluster)
"""


RESAMPLE = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
x AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS MATERIALIZED (SELECT side, rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS MATERIALIZED (SELECT side, rid, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2]))) AS feature FROM w),
k AS MATERIALIZED (SELECT side, rid, feature, count(*) AS n FROM f GROUP BY 1, 2, 3),
b AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::BIGINT)),
      lambda a, c: xor(a // 256, t[xor(a % 256, c) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT feature FROM k), crc),
g AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM k JOIN b USING (feature) GROUP BY 1),
o AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM g) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM g) + 10000)::DOUBLE)))::BIGINT AS gain FROM g),
m AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM k JOIN b USING (feature) JOIN o USING (bucket) WHERE side = 0 GROUP BY 1),
d AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (rid) WHERE side = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS able FROM e WHERE n_words >= 20)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END::BIGINT AS rank FROM e LEFT JOIN r USING (rid)
"""

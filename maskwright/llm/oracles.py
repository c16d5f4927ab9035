"""DuckDB SQL for the operators that SQL can express."""

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

JACCARD_COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
sides AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT doc_id AS u, doc_id AS root FROM s UNION SELECT sides.v, r.root FROM r JOIN sides ON r.u = sides.u WHERE r.root < sides.v)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id FROM s JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, len(g)
"""

REPEATED_STRINGS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
cut AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops, sum(b - a) AS removed FROM s GROUP BY doc_id),
kept AS (SELECT d.doc_id, length(h) // 2 AS n, coalesce(removed, 0) AS removed, coalesce(len(starts), 0) AS spans,
  CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda k: substr(h, 1 + 2 * CASE WHEN k = 0 THEN 0 ELSE stops[k] END,
    2 * (CASE WHEN k = len(starts) THEN length(h) // 2 ELSE starts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE stops[k] END))), '') END AS k FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
"""

WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, g * 5 + 1, 5))::INT >> s) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""

LM_SCORE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, k, w[k] AS z, CASE WHEN k > 1 THEN w[k - 1] END AS y, CASE WHEN k > 2 THEN w[k - 2] END AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
one AS (SELECT *, sum(o) OVER (PARTITION BY z) AS c FROM (SELECT doc_id, z, count(*) AS o FROM t GROUP BY ALL)),
two AS (SELECT *, sum(o) OVER (PARTITION BY y, z) AS c FROM (SELECT doc_id, y, z, count(*) AS o FROM t WHERE y IS NOT NULL GROUP BY ALL)),
three AS (SELECT *, sum(o) OVER (PARTITION BY x, y, z) AS c FROM (SELECT doc_id, x, y, z, count(*) AS o FROM t WHERE x IS NOT NULL GROUP BY ALL)),
n AS (SELECT doc_id, greatest(sum(count(*)) OVER () - count(*), 1) AS others FROM t GROUP BY doc_id),
e AS (SELECT t.doc_id, t.k, t.x, t.y, a.c - a.o AS c1, b.c - b.o AS c2, g.c - g.o AS c3, pa.c - pa.o AS p1, pb.c - pb.o AS p2, n.others FROM t JOIN n USING (doc_id) JOIN one a ON a.doc_id = t.doc_id AND a.z = t.z
  LEFT JOIN two b ON b.doc_id = t.doc_id AND b.y = t.y AND b.z = t.z LEFT JOIN three g ON g.doc_id = t.doc_id AND g.x = t.x AND g.y = t.y AND g.z = t.z
  LEFT JOIN one pa ON pa.doc_id = t.doc_id AND pa.z = t.y LEFT JOIN two pb ON pb.doc_id = t.doc_id AND pb.y = t.x AND pb.z = t.y),
s AS (SELECT doc_id, sum(CASE WHEN c3 > 0 THEN ln(c3 / p2) ELSE CASE WHEN x IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN c2 > 0 THEN ln(c2 / p1) ELSE CASE WHEN y IS NULL THEN 0 ELSE ln(0.4) END + ln(greatest(c1, 1) / others) END END) AS score FROM e GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS log_score, CASE WHEN len(w) > 0 THEN round(score / len(w), 6) END AS mean_log_score FROM d LEFT JOIN s USING (doc_id)
"""

#: No link of the test pages names a host, so their link graph is empty and what no rule decides is allowed.
URL_FILTERS = rf"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT DISTINCT url, translate(regexp_extract(url, '://([^/?#]*)', 1), {UPPER_LOWER}) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL),
best AS (SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM pages LEFT JOIN u USING (url) LEFT JOIN best USING (url)
"""

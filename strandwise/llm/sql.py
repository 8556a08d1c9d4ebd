"""DuckDB SQL for the operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(node, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.node, p.v FROM r JOIN p ON p.u = r.other
), c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.node = s.doc_id
"""

ORACLES["op10_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
g AS (SELECT *, [CAST('0x' || substr(x, 1 + 5 * i, 5) AS BIGINT) FOR i IN range(0, 8)] AS g FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((g[1 + j // 4] >> (15 - 5 * (j % 4))) & 31 AS INTEGER), 1) FOR j IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""

ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), r(node, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other
), c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

ORACLES["op7_line_dedup"] = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT source, text, l FROM d),
t AS (SELECT source, count(*) AS total FROM u GROUP BY source),
x AS (SELECT source, unnest(list_distinct(l)) AS line FROM u),
b AS (
  SELECT x.source, list(x.line) AS b FROM (
    SELECT source, line, count(*) AS n FROM x WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) >= 3
  ) x JOIN t ON t.source IS NOT DISTINCT FROM x.source WHERE x.n > CAST(0.01 AS DOUBLE) * t.total GROUP BY x.source
), k AS (
  SELECT d.doc_id, d.l, CASE WHEN b.b IS NULL THEN d.l ELSE list_filter(d.l, lambda y: NOT list_contains(b.b, y)) END AS k
  FROM d LEFT JOIN b ON b.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(k) AS BIGINT) AS n_dropped,
  CAST(length(array_to_string(k, chr(10))) AS BIGINT) AS n_chars_left, md5(array_to_string(k, chr(10))) AS text_md5 FROM k
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""

ORACLES["op8_nearest_neighbours"] = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["line_dedup_pages"] = r"""
WITH d AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, html, string_split(html, chr(10)) AS l FROM pages WHERE html IS NOT NULL),
u AS (SELECT DISTINCT host, html, l FROM d), t AS (SELECT host, count(*) AS total FROM u GROUP BY host), x AS (SELECT host, unnest(list_distinct(l)) AS line FROM u),
b AS (
  SELECT x.host, list(x.line) AS b FROM (
    SELECT host, line, count(*) AS n FROM x WHERE trim(line) <> '' GROUP BY host, line HAVING count(*) >= 3
  ) x JOIN t ON t.host IS NOT DISTINCT FROM x.host WHERE x.n > CAST(0.01 AS DOUBLE) * t.total GROUP BY x.host
), k AS (
  SELECT d.page_id, d.l, CASE WHEN b.b IS NULL THEN d.l ELSE list_filter(d.l, lambda y: NOT list_contains(b.b, y)) END AS k
  FROM d LEFT JOIN b ON b.host IS NOT DISTINCT FROM d.host
)
SELECT page_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(k) AS BIGINT) AS n_dropped, md5(array_to_string(k, chr(10))) AS text_md5 FROM k
UNION ALL SELECT page_id, 0, 0, NULL FROM pages WHERE html IS NULL
"""

"""The queries that SQL can state over whole tables, for DuckDB."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept, v.label
FROM v JOIN comp ON comp.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
pos AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, w FROM d),
win AS (SELECT doc_id, j, w[j] AS word, CASE WHEN j + 34 <= n THEN array_to_string(w[j:j + 34], ' ') END AS key FROM pos),
dup AS (SELECT doc_id, j, word, CASE WHEN key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 THEN 1 ELSE 0 END AS hit FROM win),
cov AS (SELECT doc_id, j, word, max(hit) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM dup),
agg AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(agg.r, 0) AS BIGINT) AS n_removed, sha256(coalesce(agg.kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents
), pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS j FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + 3], ' ') AS g FROM pos),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, comp.component_id
FROM d JOIN comp ON comp.node = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, url
FROM q
"""

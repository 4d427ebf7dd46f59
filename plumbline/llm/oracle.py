"""DuckDB SQL for those pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

P3_FOUND = r"""
WITH t AS (SELECT id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS s FROM chunks WHERE text IS NOT NULL)
SELECT id AS chunk_id, CASE WHEN list_max(list_transform(string_split_regex(s, '\s+'), lambda w: length(w))) > 1200 THEN 'forced' ELSE 'natural' END AS boundary
FROM t WHERE length(s) > 1200
"""

P4_FOUND = """
WITH r AS (SELECT chunk_id, dim, vec, row_number() OVER (PARTITION BY chunk_id ORDER BY written_at DESC) AS n FROM chunk_vectors),
u AS (SELECT chunk_id, vec::DOUBLE[] AS v FROM r WHERE n = 1 AND vec IS NOT NULL AND len(vec) = dim AND list_max(list_transform(vec, lambda x: abs(x))) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM u a JOIN u b ON a.chunk_id < b.chunk_id
WHERE list_cosine_similarity(a.v, b.v) >= 0.95
"""

P5_FOUND = r"""
WITH lines AS (
  SELECT id, doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM chunks WHERE text IS NOT NULL),
keyed AS (SELECT id, doc, line_no, regexp_replace(lower(line), '[^a-z]', '', 'g') AS k FROM lines),
docs AS (SELECT doc, count(*) AS n FROM chunks GROUP BY doc),
cases AS (SELECT k.doc, k.k FROM keyed k JOIN docs d ON k.doc = d.doc WHERE length(k.k) >= 12 GROUP BY k.doc, k.k, d.n HAVING count(DISTINCT k.id) >= 6 AND count(DISTINCT k.id) >= 0.03 * d.n)
SELECT k.id AS chunk_id, k.line_no::INTEGER AS line_no FROM keyed k JOIN cases c ON k.doc = c.doc AND k.k = c.k
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND}

"""SQL (DuckDB's) for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m
      FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 199 AS BIGINT))) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, span),
n AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM s GROUP BY doc_id),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM s
      UNION ALL SELECT d.doc_id, max(s.b), max(len(h) // 2) FROM s JOIN d USING (doc_id) GROUP BY d.doc_id),
q AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id)"""

_REACH = """
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a)"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
ok AS (SELECT * FROM g WHERE norm > 0 AND isfinite(norm) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
{_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3])))) END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS m FROM t),
first AS (SELECT m, n, min(doc_id) AS rep FROM k WHERE n > 0 GROUP BY m, n),
e AS (SELECT rep, n, unnest(s) AS x FROM first JOIN t ON t.doc_id = rep),
links AS MATERIALIZED (SELECT p.rep AS a, q.rep AS b FROM e p JOIN e q ON p.x = q.x AND p.rep <> q.rep GROUP BY p.rep, q.rep
          HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
{_REACH}
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(component, rep, k.doc_id) AS component_id, coalesce(component, rep, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN first f ON f.m = k.m AND f.n = k.n AND k.n > 0 LEFT JOIN low ON low.a = rep"""


def oracle_sql() -> dict[str, str]:
    return {"op3_repeats": OP3, "op4_multi_index": OP4, "op6_minhash": OP6}

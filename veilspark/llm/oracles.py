"""SQL (DuckDB) for the queries that it can express."""

from __future__ import annotations

from . import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT uid, doc_id, h, length(h) // 2 AS n_bytes FROM d),
b AS (SELECT uid, n_bytes, pos, substr(h, 2 * pos + 1, 798) AS part FROM (SELECT uid, n_bytes, h, unnest(range(0, n_bytes - 199, 200)) AS pos FROM n WHERE n_bytes >= 200)),
s AS (SELECT uid, pos + o AS i, md5(substr(part, 2 * o + 1, 400)) AS k FROM (SELECT uid, n_bytes, pos, part, unnest(range(200)) AS o FROM b) WHERE pos + o <= n_bytes - 200),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT uid, i, i - lag(i) OVER (PARTITION BY uid ORDER BY i) AS gap FROM s SEMI JOIN r USING (k)),
run AS (SELECT uid, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY i) AS g FROM hit),
span AS (SELECT uid, g, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY uid, g),
gone AS (SELECT uid, list([a, z] ORDER BY a) AS l, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last FROM span GROUP BY uid),
kept AS (SELECT uid, CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(l) + 1), lambda j: substr(h, 2 * CASE WHEN j = 1 THEN 0 ELSE l[j - 1][2] END + 1, 2 * (l[j][1] - CASE WHEN j = 1 THEN 0 ELSE l[j - 1][2] END))), '') || substr(h, 2 * last + 1) END AS k FROM n LEFT JOIN gone USING (uid))
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM n LEFT JOIN gone USING (uid) JOIN kept USING (uid)"""

_WORDS2 = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER}, {_WORDS2}) AS w FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, {_WORDS2}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT uid, n, i, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT uid, w, n, unnest(range(len(w) - n + 1)) AS i FROM d JOIN sizes ON len(w) >= n)),
hit AS (SELECT uid, n, i, item FROM dw JOIN bw USING (n, k)),
words AS (SELECT uid, count(DISTINCT x) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT uid, n, i FROM hit)) GROUP BY uid),
items AS (SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP9 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES = {"op1_repeats": OP1, "op2_decontaminate": OP2, "op6_topk": OP6, "op8_license": licenses.oracle(), "op9_neardup": OP9}

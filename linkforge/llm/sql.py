"""DuckDB SQL for the queries that SQL expresses and that it answers on whole tables in reasonable time."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents
), starts AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 48))) AS s FROM w WHERE len(ws) >= 50)
), hits AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS least FROM starts) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM hits) GROUP BY doc_id
), places AS (
  SELECT doc_id, word, p FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w)
), kept AS (
  SELECT q.doc_id, string_agg(q.word, ' ' ORDER BY q.p) AS t, count(*) AS n
  FROM places q LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON q.doc_id = g.doc_id AND q.p = g.p
  WHERE g.p IS NULL GROUP BY q.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
, degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(l.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(l.m, v.vec_id)) AS kept
FROM v LEFT JOIN degree d ON v.vec_id = d.a LEFT JOIN least l ON v.vec_id = l.a
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), pairs AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least l ON l.a = w.doc_id
"""

ORACLES = {"op2_ngram_join": OP2, "op6_substring": OP6, "op9_embeddings": OP9}

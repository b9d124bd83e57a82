"""SQL of cleaned texts and their chunks, for comparison on another engine."""

SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean_sql(c: str) -> str:
    c = f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
    c = f"regexp_replace({c}, '[ \\t\\x{{00A0}}]+', ' ', 'g')"
    c = f"regexp_replace({c}, ' +\\n', chr(10), 'g')"
    return trim_sql(f"regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def fold_sql(c: str) -> str:
    return f"lower(translate(strip_accents({c}), 'đĐ', 'dD'))"


def _end(pos: str) -> str:
    w = f"reverse(substring(t, {pos} + 501, 500))"
    arms = "".join(f" WHEN instr({w}, {s}) > 0 THEN {pos} + 1001 - instr({w}, {s})" for s in ("chr(10) || chr(10)", "chr(10)", "' .'", "' !'", "' ?'", "' '"))
    return f"CASE WHEN {pos} + 1000 >= length(t) THEN length(t){arms} ELSE {pos} + 1000 END"


#: WITH part: chunks(chunk_id, doc_id, ordinal, char_start, char_end, text).
CHUNKS = f"""WITH RECURSIVE src AS (SELECT doc_id, {clean_sql('text')} AS t FROM documents),
r(doc_id, t, ordinal, s, e) AS (
  SELECT doc_id, t, 0, 0, {_end('0')} FROM src WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, ordinal + 1, greatest(e - 150, s + 1), {_end('greatest(e - 150, s + 1)')} FROM r WHERE e < length(t)),
chunks AS (SELECT doc_id::VARCHAR || '-' || ordinal::VARCHAR AS chunk_id, doc_id, ordinal, s::INT AS char_start, e::INT AS char_end, substring(t, s + 1, e - s) AS text FROM r)"""

"""Registered queries of answers, citations, transcripts and provider JSON; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import config as C
from marginalia.functions import answers as A
from marginalia.plans import chunk_sql as S
from marginalia.plans.queries import _t, query
from marginalia.sources import files

_ANSWER = "text || '  [1] and [9] , then [' || (turn % 5) || '] !'"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_ANSWER}, '\\[([04-9]|[0-9]{{2,}})\\]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g')"
_LABELS = "['[1] T1 · trang 1', '[2] T2 · trang 2', '[3] Nguồn']"


def _answer():
    return F.concat("text", F.lit("  [1] and [9] , then ["), (F.col("turn") % 5).cast("string"), F.lit("] !"))


def _context():
    """Three units of context; the last has neither title nor page."""
    unit = lambda n: F.struct(F.lit(n).alias("n"), F.lit(f"c{n}").alias("chunk_id"), F.lit(f"s{n}").alias("source_id"), F.lit(f"T{n}" if n < 3 else None).cast("string").alias("title"), F.lit(n if n < 3 else None).cast("int").alias("page"))
    return F.array(*map(unit, (1, 2, 3)))


_NUMBERS = "list_sort(list_distinct([1] || CASE WHEN turn % 5 BETWEEN 1 AND 3 THEN [(turn % 5)::INT] ELSE [] END))"


@query(f"SELECT conv_id, turn, role, {_CLEAN} AS answer, array_to_string({_NUMBERS}, ',') AS numbers FROM conversations")
def postprocess_citations(spark, d):
    done = _t(spark, d, "conversations").select("conv_id", "turn", "role", A.postprocessed(_answer(), _context()).alias("p"))
    return done.select("conv_id", "turn", "role", "p.answer", F.array_join(F.transform("p.citations", lambda c: c["n"].cast("string")), ",").alias("numbers"))


_SAID = f"CASE WHEN turn % 6 = 0 THEN ' ' WHEN turn % 6 = 1 THEN 'Tôi KHÔNG TÌM THẤY gì' WHEN turn % 6 = 2 THEN text ELSE {_ANSWER} END"


@query(f"""SELECT conv_id, turn, role, CASE WHEN conv_id % 13 = 0 THEN 'reindexing' WHEN role = 'user' THEN 'open' WHEN conv_id % 7 = 0 OR turn % 6 < 2 THEN 'not-found' ELSE 'grounded' END AS decision,
CASE WHEN conv_id % 13 = 0 THEN '{C.REINDEXING}' WHEN role <> 'user' AND (conv_id % 7 = 0 OR turn % 6 < 2) THEN '{C.NOT_FOUND}' WHEN turn % 6 > 2 THEN CASE WHEN conv_id % 7 = 0 THEN regexp_replace(regexp_replace(regexp_replace({_ANSWER}, '\\[[0-9]+\\]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g') ELSE {_CLEAN} END ELSE regexp_replace(regexp_replace({_SAID}, '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g') END AS answer,
CASE WHEN conv_id % 13 = 0 OR conv_id % 7 = 0 OR (role <> 'user' AND turn % 6 < 2) THEN '' WHEN turn % 6 > 2 THEN array_to_string({_NUMBERS}, ',') WHEN role = 'user' THEN '' ELSE '1,2,3' END AS numbers FROM conversations""")
def answer_decisions(spark, d):
    t, conv = F.col("turn"), F.col("conv_id")
    said = F.when(t % 6 == 0, " ").when(t % 6 == 1, "Tôi KHÔNG TÌM THẤY gì").when(t % 6 == 2, F.col("text")).otherwise(_answer())
    context = F.when(conv % 7 == 0, F.expr(A._NONE)).otherwise(_context())
    mode = F.when(F.col("role") == "user", "open").otherwise("grounded")
    done = _t(spark, d, "conversations").select("conv_id", "turn", "role", A.decided(said, mode, context, conv % 13 == 0).alias("p"))
    return done.select("conv_id", "turn", "role", "p.decision", "p.answer", F.array_join(F.transform("p.citations", lambda c: c["n"].cast("string")), ",").alias("numbers"))


@query(f"SELECT conv_id, turn, role, regexp_replace(text, '{S.SPACE}+$', '') || chr(10) || CASE WHEN turn % 4 = 0 THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) || 'Nguồn:' || chr(10) || array_to_string({_LABELS}[1:(turn % 4)::INT], chr(10)) || chr(10) END AS markdown FROM conversations")
def answer_markdown(spark, d):
    some = F.slice(_context(), F.lit(1), (F.col("turn") % 4).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", A.answer_markdown(F.concat("text", F.lit(" \n")), some).alias("markdown"))


@query("SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'c1,c2,c3' ELSE '' END AS chunks FROM conversations")
def citations_round_trip(spark, d):
    """Citations as JSON and back; text that is cut or is no array gives none."""
    json = A.citations_json(_context())
    told = F.when(F.col("turn") % 3 == 0, json).when(F.col("turn") % 3 == 1, F.concat(F.lit("{"), F.col("text"))).otherwise('{"n":1}')
    read = _t(spark, d, "conversations").select("conv_id", "turn", "role", A.citations_of(told).alias("c"))
    return read.select("conv_id", "turn", "role", F.array_join(F.transform("c", lambda c: c["chunk_id"]), ",").alias("chunks"))


@query("SELECT conv_id, turn, role, len(list_filter([text || ' ', '[1]', '[' || turn || ']', ' [1234567]'], lambda x: x <> ''))::INT AS n, '[' || turn || ']' AS third FROM conversations")
def citation_parts(spark, d):
    parts = A.display_parts(F.concat("text", F.lit(" [1]["), F.col("turn").cast("string"), F.lit("] [1234567]")))
    cut = _t(spark, d, "conversations").select("conv_id", "turn", "role", parts.alias("p"))
    return cut.select("conv_id", "turn", "role", F.size("p").alias("n"), F.get("p", F.lit(2)).alias("third"))


@query("SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'Câu ' || conv_id WHEN 1 THEN text WHEN 2 THEN text ELSE CASE WHEN length(text) > 0 THEN text END END AS question FROM conversations")
def rewrites(spark, d):
    """A good rewrite in quotes, one that is far too long, a blank one, and none."""
    t = F.col("turn") % 4
    said = F.when(t == 0, F.concat(F.lit(' "“Câu '), F.col("conv_id").cast("string"), F.lit("”' \n"))).when(t == 1, F.concat(F.repeat("text", 2), F.repeat(F.lit("x"), 201))).when(t == 2, ' "" ')
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", A.rewritten(F.col("text"), said).alias("question"))


_RULE = {m: "\n".join([*r, "", "--- CÁC ĐOẠN NGUỒN ---", ""]).replace("'", "''") for m, r in A._RULES.items()}


@query(f"""WITH h AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn, role, text) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(CASE WHEN conv_id % 2 = 0 THEN '{_RULE['grounded']}' ELSE '{_RULE['open']}' END || h[1].content || chr(10) || '--- HẾT ĐOẠN NGUỒN ---') AS system,
'Hội thoại trước:' || chr(10) || array_to_string(list_transform(h[-6:], lambda t: CASE WHEN t.role = 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || t.content), chr(10)) || chr(10) || chr(10) || 'Câu hỏi cần viết lại:' || chr(10) || 'q' || chr(10) || chr(10) || 'Truy vấn viết lại:' AS rewrite FROM h""")
def prompts(spark, d):
    told = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    h = told.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("h"))
    system = A.system_prompt(F.when(F.col("conv_id") % 2 == 0, "grounded").otherwise("open"), F.col("h")[0]["content"])
    return h.select("conv_id", F.sha2(system.cast("binary"), 256).alias("system"), A.rewrite_prompt(F.lit("q"), F.col("h")).alias("rewrite"))


_SEGMENTS = f"""WITH s AS (SELECT conv_id, turn, role, {S.trim_sql(f"regexp_replace(CASE WHEN turn % 3 = 2 THEN '  ' ELSE text END, '{S.SPACE}+', ' ', 'g')")} AS t FROM conversations), k AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, t) - length(t) - 1 AS s FROM s WHERE t <> ''),
a AS (SELECT conv_id, string_agg(t, ' ' ORDER BY s) AS text FROM k GROUP BY conv_id)"""
_TOUCHED = "k.s < 700 AND k.s + length(k.t) > 100"


@query(_SEGMENTS + f" SELECT c.conv_id, coalesce(a.text, '') AS text, min(turn * 2.5) FILTER (WHERE {_TOUCHED}) AS t_start, max(turn * 2.5 + 2) FILTER (WHERE {_TOUCHED}) AS t_end, round(min(turn / 10) FILTER (WHERE {_TOUCHED}), 9) AS x, round(max(turn / 10 + least(0.05 * (turn + 1), 1.0)) FILTER (WHERE {_TOUCHED}) - min(turn / 10) FILTER (WHERE {_TOUCHED}), 9) AS w FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id) LEFT JOIN k USING (conv_id) GROUP BY c.conv_id, a.text")
def transcripts(spark, d):
    """Turns as segments with times and boxes; those of the characters from 100 to 700."""
    t = F.col("turn")
    box = A.unit_box(t * 20.0, F.lit(0), t * 20.0 + 10.0 * (t + 1), F.lit(40), F.lit(200.0), F.lit(0))
    seg = F.struct(t.alias("at"), F.col("role"), F.when(t % 3 == 2, "  ").otherwise(F.col("text")).alias("text"), (t * 2.5).alias("t_start"), (t * 2.5 + 2).alias("t_end"), box.alias("box"))
    told = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("s")).select("conv_id", A.transcript(F.col("s")).alias("t"))
    time, found = A.time_of(F.col("t.map"), F.lit(100), F.lit(700)), A.box_of(F.col("t.map"), F.lit(100), F.lit(700))
    return told.select("conv_id", "t.text", time["t_start"].alias("t_start"), time["t_end"].alias("t_end"), F.round(found["x"], 9).alias("x"), F.round(found["w"], 9).alias("w"))


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn, role, text) FILTER (WHERE trim(text) <> '' AND turn % 2 = 0) AS lines FROM conversations GROUP BY conv_id")
def flat_lines(spark, d):
    """Each turn a block: even ones with a line of text in the second paragraph, odd ones with a blank line."""
    line = lambda c: F.struct(c.alias("text"))
    paragraphs = F.array(F.struct(F.expr("cast(array() as array<struct<text:string>>)").alias("lines")), F.struct(F.array(line(F.lit(" ")), line(F.when(F.col("turn") % 2 == 0, F.col("text")))).alias("lines")))
    blocks = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", paragraphs.alias("paragraphs")))).alias("b"))
    flat = blocks.select("conv_id", F.transform(A.flat_lines(F.col("b")), lambda x: x["text"]).alias("l"))
    return flat.select("conv_id", F.when(F.size("l") > 0, F.array_join("l", "|")).alias("lines"))


_RATE = "([8000, 16000, 44100, 0]::INT[])[vec_id % 4 + 1]"
_POS = "((i - 1) * {r} / 16000.0)"


@query(f"""SELECT vec_id, len(o)::INT AS n, round(list_sum(o), 5) + 0.0 AS total, round(o[2], 5) + 0.0 AS second FROM (SELECT vec_id, CASE WHEN r = 16000 THEN embedding::DOUBLE[] WHEN r <= 0 THEN []::DOUBLE[] ELSE
list_transform(range(1, greatest(1, floor(len(embedding) * (16000.0 / r) + 0.5)::INT) + 1), lambda i: embedding[floor((i - 1) * r / 16000.0::DOUBLE)::INT + 1]::DOUBLE * (1 - ((i - 1) * r / 16000.0::DOUBLE - floor((i - 1) * r / 16000.0::DOUBLE))) + embedding[least(floor((i - 1) * r / 16000.0::DOUBLE)::INT + 2, len(embedding))]::DOUBLE * ((i - 1) * r / 16000.0::DOUBLE - floor((i - 1) * r / 16000.0::DOUBLE))) END AS o FROM (SELECT vec_id, embedding, {_RATE} AS r FROM embeddings))""")
def resample(spark, d):
    rate = F.element_at(F.array(*map(F.lit, (8000, 16000, 44100, 0))), (F.col("vec_id") % 4 + 1).cast("int"))
    out = _t(spark, d, "embeddings").select("vec_id", A.resampled(F.col("embedding"), rate).alias("o"))
    total = F.when(F.size("o") > 0, F.aggregate("o", F.lit(0.0), lambda a, x: a + x))
    return out.select("vec_id", F.size("o").alias("n"), (F.round(total, 5) + 0.0).alias("total"), (F.round(F.get("o", F.lit(1)), 5) + 0.0).alias("second"))


@query("""WITH m AS (SELECT conv_id, list({'role': CASE WHEN turn = 0 THEN 'system' ELSE role END, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, list_filter(m, lambda x: x.role = 'system') AS s, list_filter(m, lambda x: x.role <> 'system') AS t, m FROM m)
SELECT conv_id, array_to_string(list_transform(s, lambda x: x.content), chr(10) || chr(10)) AS system, len(t)::INT AS n_turns, CASE WHEN t[1].role = 'assistant' THEN CASE conv_id % 2 WHEN 0 THEN 'assistant' ELSE 'model' END ELSE t[1].role END AS first_role, len(m)::INT AS n_messages FROM k""")
def request_bodies(spark, d):
    """Conversations as two providers take them, whose first turn is the system's."""
    role = F.when(F.col("turn") == 0, "system").otherwise(F.col("role"))
    told = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("r"), "text", role.alias("role")))).alias("all"))
    m = told.select("conv_id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    even = F.col("conv_id") % 2 == 0
    body = m.select("conv_id", F.when(even, A.request_body(F.col("m"), "blocks", F.lit("x"))).otherwise(A.request_body(F.col("m"), "parts", F.lit("x"))).alias("b"), A.request_body(F.col("m"), "choices", F.lit("x")).alias("c"))
    at = lambda a, b: F.when(even, F.get_json_object("b", a)).otherwise(F.get_json_object("b", b))
    return body.select("conv_id", at("$.system", "$.systemInstruction.parts[0].text").alias("system"), F.coalesce(F.json_array_length(at("$.messages", "$.contents")), F.lit(0)).alias("n_turns"), at("$.messages[0].role", "$.contents[0].role").alias("first_role"), F.json_array_length(F.get_json_object("c", "$.messages")).alias("n_messages"))


@query("SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN text || '!' WHEN 1 THEN text WHEN 2 THEN text || '?' ELSE '' END AS said FROM conversations")
def responses(spark, d):
    """Whole answers of three providers; one with a block that is no text, and one that is no JSON."""
    t, text = F.col("turn") % 4, F.col("text")
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    blocks = F.to_json(F.struct(F.array(block("thinking", F.lit("no")), block("text", text), block("text", F.lit("!"))).alias("content")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text")), F.struct(F.lit("?").alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    said = F.when(t == 0, A.response_text(blocks, "blocks")).when(t == 1, A.response_text(choices, "choices")).when(t == 2, A.response_text(parts, "parts")).otherwise(A.response_text(F.concat(F.lit("{"), text), "blocks"))
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", said.alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_type || ',Embed-' || user_id END AS names, CASE WHEN event_id % 4 = 3 THEN '' ELSE 'chat,embedding' END AS kinds, CASE event_id % 4 WHEN 0 THEN 'gemini' END AS active, CASE WHEN event_id % 4 < 2 THEN event_type END AS model FROM events")
def provider_settings(spark, d):
    e, name = F.col("event_id") % 4, F.concat(F.lit("Embed-"), F.col("user_id").cast("string"))
    listed = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("name"), F.lit(5).alias("size")), F.struct(name.alias("name"), F.lit(None).cast("long").alias("size"))).alias("models")))
    stored = F.to_json(F.struct(F.when(e == 0, "gemini").otherwise("other").alias("activeOnlineId"), F.create_map(F.lit("gemini"), F.col("event_type"), F.lit("openai"), F.lit("a b")).alias("models")))
    models = A.model_list(F.when(e == 3, "[1").otherwise(listed))
    config = A.online_config(F.when(e < 2, stored).otherwise("[]"))
    found = _t(spark, d, "events").select("event_id", models.alias("m"), config.alias("c"))
    return found.select("event_id", F.array_join(F.transform("m", lambda m: m["name"]), ",").alias("names"), F.array_join(F.transform("m", lambda m: m["kind"]), ",").alias("kinds"), F.col("c.active").alias("active"), F.col("c.models.gemini").alias("model"))


@query()
def page_markdown(spark, d):
    """Every stored page as a source: title, Markdown text, error label."""
    return files.web_sources(_t(spark, d, "pages"))

"""Registered queries of checks, lookups and labels; importing this registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia import config as C
from marginalia.functions import answers as A
from marginalia.functions import checks as K
from marginalia.plans import chunk_sql as S
from marginalia.plans.queries import _t, query


def case_sql(c: str, table: dict, other: str = "NULL") -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _pick(values: tuple, at):
    """Value number ``at`` of a small list."""
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


_EXT = ("pdf", "DOCX", "txt", "md", "markdown", "mp3", "mkv", "png", "exe", "tar.gz", "gif", "Ogg")
_PATH = f"'C:\\up/dir.v2/page ' || page_id || '.' || {list(_EXT)}[page_id % {len(_EXT)} + 1]"
_LAST = "lower(split_part(p, '.', -1))"


@query(f"SELECT page_id, {case_sql(_LAST, C.KINDS)} AS kind, split_part(replace(p, '\\', '/'), '/', -1) AS title, {_LAST} AS ext, {case_sql(_LAST, C.MEDIA_TYPES, chr(39) + 'audio/mpeg' + chr(39))} AS media_type FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def file_kinds(spark, d):
    path = F.concat(F.lit("C:\\up/dir.v2/page "), F.col("page_id").cast("string"), F.lit("."), _pick(_EXT, F.col("page_id") % len(_EXT)))
    ext = K.extension(path)
    return _t(spark, d, "pages").select("page_id", K.kind_of(path).alias("kind"), K.title_of(path).alias("title"), ext.alias("ext"), K.media_type(ext).alias("media_type"))


_KINDS = ("pdf", "docx", "txt", "url", "audio", "video", "image")
_KIND_SQL = f"{list(_KINDS)}[doc_id % 7 + 1]"


@query(f"""SELECT doc_id, n_chars * 40000 <= {case_sql(_KIND_SQL, C.SIZE_LIMITS)} AS fits,
CASE WHEN doc_id % 11 = 0 THEN '{C.SOURCE_ERRORS["notebook"]}' WHEN doc_id % 13 = 0 THEN '{C.SOURCE_ERRORS["origin"]}' WHEN {_KIND_SQL} <> 'url' AND doc_id % 3 = 0 THEN '{C.SOURCE_ERRORS["scheme"]}' END AS error,
CASE WHEN doc_id % 5 = 0 AND {_KIND_SQL} NOT IN ('video', 'image') THEN CASE WHEN {_KIND_SQL} = 'url' THEN '{C.PAGE_ERROR}' ELSE 'Lỗi trích xuất' END END AS empty_error FROM documents""")
def source_checks(spark, d):
    k, i = _pick(_KINDS, F.col("doc_id") % 7), F.col("doc_id")
    origin = F.when(i % 13 == 0, " ").when(i % 3 == 0, F.concat(F.lit(" Https://host/"), i.cast("string"))).otherwise("C:/a.pdf")
    pages = F.when(i % 5 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.lit("x")))
    return _t(spark, d, "documents").select("doc_id", K.within_limit(k, F.col("n_chars") * 40_000).alias("fits"), K.source_error(F.when(i % 11 != 0, "n"), k, origin).alias("error"), K.empty_error(k, pages).alias("empty_error"))


_QUESTION = f"CASE WHEN turn % 5 = 4 THEN ' \t ' WHEN turn % 7 = 6 THEN NULL ELSE repeat(text, 1 + (turn % 3)::INT) END"


@query(f"""SELECT conv_id, turn, role, CASE WHEN q IS NULL THEN '{C.QUESTION_ERRORS["type"]}' WHEN length({S.trim_sql('q')}) = 0 THEN '{C.QUESTION_ERRORS["empty"]}' WHEN length({S.trim_sql('q')}) > 2000 THEN '{C.QUESTION_ERRORS["long"]}' END AS question_error,
CASE WHEN m IN ('grounded', 'open') THEN NULL ELSE '{C.QUESTION_ERRORS["mode"]}' END AS mode_error FROM (SELECT conv_id, turn, role, {_QUESTION} AS q, CASE turn % 4 WHEN 0 THEN 'grounded' WHEN 1 THEN 'open' WHEN 2 THEN 'Open' END AS m FROM conversations)""")
def question_checks(spark, d):
    t = F.col("turn")
    q = F.when(t % 5 == 4, " \t ").when(t % 7 == 6, None).otherwise(F.repeat("text", 1 + (t % 3).cast("int")))
    m = F.when(t % 4 == 0, "grounded").when(t % 4 == 1, "open").when(t % 4 == 2, "Open")
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", K.question_error(q).alias("question_error"), K.mode_error(m).alias("mode_error"))


@query(f"SELECT conv_id, CASE WHEN count(*) > 50 THEN '{C.QUESTION_ERRORS['history-long']}' WHEN NOT bool_and(CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN false ELSE role IN ('user', 'assistant') AND length(text) <= 20000 END) THEN '{C.QUESTION_ERRORS['history']}' END AS error FROM conversations GROUP BY conv_id")
def history_checks(spark, d):
    role = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "system").otherwise(F.col("role"))
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(role.alias("role"), F.col("text").alias("content"))).alias("h"))
    return rows.select("conv_id", K.history_error(F.col("h")).alias("error"))


_NAME = "substring(text, 1, (60 + turn * 25)::INT)"


@query(f"""SELECT conv_id, turn, role, CASE WHEN length({S.trim_sql(_NAME)}) = 0 THEN '{C.NAME_ERRORS['empty']}' WHEN length({S.trim_sql(_NAME)}) > 100 THEN '{C.NAME_ERRORS['long']}' END AS name_error,
CASE WHEN conv_id % 9 = 8 THEN '{C.NAME_ERRORS['color']}' END AS color_error, CASE WHEN turn = 0 THEN '{C.NAME_ERRORS['id']}' END AS id_error FROM conversations""")
def name_checks(spark, d):
    name = F.col("text").substr(F.lit(1), (60 + F.col("turn") * 25).cast("int"))
    color, id_ = _pick((*C.PALETTE, "#000000"), F.col("conv_id") % 9), F.when(F.col("turn") == 0, "").otherwise("n")
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", K.name_error(name).alias("name_error"), K.color_error(color).alias("color_error"), K.id_error(id_).alias("id_error"))


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name), lower(left(r_name, 1)))")
def name_filter(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = F.concat(F.lit("  "), F.substring("r_name", 1, 1), F.lit(" "))
    return both.where(K.name_matches(F.col("n_name"), wanted)).select("n_nationkey", "n_name")


_MODEL = "CASE event_id % 4 WHEN 0 THEN event_type || ':' || user_id || 'b' WHEN 1 THEN 'nomic-Embed/' || user_id WHEN 2 THEN '-' || event_type ELSE event_type || ' ' || user_id END"


@query(f"SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN {_MODEL} END AS model, CASE WHEN contains(lower({_MODEL}), 'embed') THEN 'embedding' ELSE 'chat' END AS kind, CASE event_id % 3 WHEN 0 THEN 'http://localhost:' || event_id % 9000 WHEN 1 THEN 'https://127.0.0.1' ELSE 'http://localhost:11434' END AS url FROM events")
def model_settings(spark, d):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    name = F.when(e % 4 == 0, F.concat("event_type", F.lit(":"), user, F.lit("b"))).when(e % 4 == 1, F.concat(F.lit("nomic-Embed/"), user)).when(e % 4 == 2, F.concat(F.lit("-"), "event_type")).otherwise(F.concat("event_type", F.lit(" "), user))
    url = F.when(e % 3 == 0, F.concat(F.lit("http://localhost:"), (e % 9000).cast("string"), F.lit("/"))).when(e % 3 == 1, "https://127.0.0.1").otherwise(F.concat(F.lit("http://localhost.evil.org/"), user))
    return _t(spark, d, "events").select("event_id", K.model_name(name).alias("model"), K.model_kind(name).alias("kind"), K.base_url(url).alias("url"))


_STATUS = f"{list(C.STATES)}[doc_id % 5 + 1]"
_STEPS = tuple(C.STEP_LABELS)
_STEP = f"{list(_STEPS)}[doc_id % 6 + 1]"


@query(f"""SELECT doc_id, CASE {_STATUS} WHEN 'ready' THEN 'ready' WHEN 'error' THEN 'err' ELSE 'proc' END AS class, CASE WHEN {_STATUS} = 'error' AND doc_id % 2 = 0 THEN 'x' ELSE {case_sql(_STATUS, C.STATUS_LABELS)} END AS status, {case_sql(_STEP, C.STEP_LABELS)} AS step,
CASE WHEN {_STEP} = 'parse' AND {_KIND_SQL} = 'url' THEN '{C.PAGE_ERROR}' ELSE {case_sql(_STEP, C.STEP_ERRORS)} END AS error, CASE WHEN {_KIND_SQL} = 'pdf' AND doc_id % 3 > 0 THEN 'PDF · ' || doc_id % 3 || ' trang' ELSE coalesce({case_sql(_KIND_SQL, C.KIND_NAMES)}, {case_sql(_KIND_SQL, C.KIND_ICONS)}) END AS kind FROM documents""")
def source_labels(spark, d):
    i = F.col("doc_id")
    status, step, kind = _pick(C.STATES, i % 5), _pick(_STEPS, i % 6), _pick(_KINDS, i % 7)
    return _t(spark, d, "documents").select("doc_id", K.status_class(status).alias("class"), K.status_label(status, F.when(i % 2 == 0, "x")).alias("status"), K.step_label(step).alias("step"), K.error_label(step, kind).alias("error"), K.kind_label(kind, i % 3).alias("kind"))


_HTTP = "CASE WHEN event_id % 10 = 0 THEN NULL ELSE 395 + event_id % 150 END"


@query(f"""SELECT event_id, k AS kind, CASE WHEN event_id % 2 = 0 THEN 'P: ' ELSE '' END || {case_sql('k', C.ONLINE_ERRORS)} AS message FROM (SELECT event_id, CASE WHEN s IS NULL THEN CASE WHEN event_id % 20 = 0 THEN 'timeout' ELSE 'network' END WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'rate-limit' WHEN s >= 500 THEN 'server' ELSE 'unknown' END AS k FROM (SELECT event_id, {_HTTP} AS s FROM events))""")
def error_messages(spark, d):
    e = F.col("event_id")
    kind = K.error_class(F.when(e % 10 != 0, 395 + e % 150), e % 20 == 0)
    return _t(spark, d, "events").select("event_id", kind.alias("kind"), K.error_message(kind, F.when(e % 2 == 0, "P")).alias("message"))


_CHAT, _EMB = "CASE event_id % 5 WHEN 0 THEN '' ELSE 'm' || event_id % 5 END", "'e' || event_id % 3"
_MISSING = f"array_to_string(list_filter([{_CHAT}, {_EMB}], lambda x: x NOT IN ('m1', 'm2', 'e0', 'e1')), ', ')"


@query(f"""SELECT event_id, CASE WHEN b < 8589934592 THEN 'small' WHEN b <= 17179869184 THEN 'medium' ELSE 'large' END AS tier, round(b / 1073741824, 1) AS gb,
r IS NULL AS ready, r AS reason FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN '{C.RUNTIME_REASONS['down']}' WHEN {_CHAT} = '' THEN '{C.RUNTIME_REASONS['unset']}' WHEN {_MISSING} <> '' THEN '{C.RUNTIME_REASONS['missing']}' || {_MISSING} || '.' END AS r, (event_id % 40 * 536870912)::BIGINT AS b FROM events)""")
def machine_status(spark, d):
    e = F.col("event_id")
    chat, emb = F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("m"), (e % 5).cast("string"))), F.concat(F.lit("e"), (e % 3).cast("string"))
    tier, status = K.memory_tier(e % 40 * 536_870_912), K.runtime_status(e % 7 != 0, chat, emb, F.array(*map(F.lit, ("m1", "m2", "e0", "e1"))))
    return _t(spark, d, "events").select("event_id", tier["tier"].alias("tier"), tier["gb"].alias("gb"), status["ready"].alias("ready"), status["reason"].alias("reason"))


@query(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'resume' ELSE 'fresh' END AS phase, round(0.1 + least(greatest(value / 50 - 0.5, 0.0), 1.0) * 0.15, 9) AS progress FROM events")
def reindex_phases(spark, d):
    stored = F.when(F.col("event_id") % 3 == 0, C.MODEL_VERSION).when(F.col("event_id") % 3 == 1, C.MODEL_REINDEXING)
    return _t(spark, d, "events").select("event_id", K.reindex_phase(stored).alias("phase"), F.round(K.parse_progress(F.col("value") / 50 - 0.5), 9).alias("progress"))


@query("""WITH s AS (SELECT user_id, event_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, (arg_max(n, event_id) - least(0, min(n)))::BIGINT AS depth FROM s GROUP BY user_id""")
def online_depth(spark, d):
    """Open uses of each user after all of its events: even ones open, odd ones close."""
    steps = F.transform(F.array_sort(F.collect_list("event_id")), lambda e: F.when(e % 2 == 0, 1).otherwise(-1))
    found = _t(spark, d, "events").groupBy("user_id").agg(steps.alias("steps"))
    return found.select("user_id", K.online_depth(F.col("steps")).cast("long").alias("depth"))


@query("SELECT user_id, event_type, CASE WHEN n = 0 THEN '' WHEN pending = 0 THEN n || ' nguồn · đã lập chỉ mục' ELSE n || ' nguồn · đang xử lý ' || pending END AS label FROM (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS pending FROM events GROUP BY ALL)")
def rollup_labels(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("pending"))
    return n.select("user_id", "event_type", K.rollup_label(F.col("n"), F.col("pending")).alias("label"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '[REDACTED]' ELSE event_type END AS shown FROM (SELECT event_id, event_type FROM events)")
def redacted_fields(spark, d):
    private = F.col("event_type").isin("click", "view")
    m = F.create_map(F.when(private, "query").otherwise("kind"), "event_type")
    return _t(spark, d, "events").select("event_id", F.map_values(A.redacted(m))[0].alias("shown"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32 AS batch FROM events")
def batches(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return _t(spark, d, "events").select("user_id", "event_id", F.floor(place / C.BATCH).cast("long").alias("batch"))

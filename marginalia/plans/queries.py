"""Registered queries: each runs over the whole tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.config import BRANCH_TOP_K, CONTEXT_BUDGET, DEFAULT_TITLE, MAX_DISTANCE, NOT_FOUND, SEARCH_TOP_K, STUDIO_BUDGET
from marginalia.functions import answers as A
from marginalia.functions import checks as K
from marginalia.functions import text as T
from marginalia.operators import chunking, keyword, packing, vectors
from marginalia.plans import chunk_sql as S
from marginalia.sources.scratch import TEXTS, kept, spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found  # texts, which are much work for each row


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", T.cleaned(F.col("text")).alias("text"))
    return chunking.chunk(docs)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item asks."""
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


_ASK = "questions AS (SELECT item_id AS qid, text AS question FROM benchmark)"


def _bm25_sql(units: str, k: int) -> str:
    tok = lambda c: f"regexp_extract_all({S.fold_sql(c)}, '[\\p{{L}}\\p{{N}}]+')"
    return f"""asked AS (SELECT qid, unnest({tok('question')}) AS token FROM questions),
listed AS (SELECT id, {tok('text')} AS tokens FROM ({units})),
sz AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM listed),
postings AS (SELECT token, id, dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM listed) GROUP BY ALL),
w AS (SELECT token, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT token, count(*) AS df FROM postings GROUP BY token), sz),
scored AS (SELECT qid, id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) + 0.0 AS score FROM asked JOIN postings USING (token) JOIN w USING (token) GROUP BY qid, id),
kw AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) - 1 AS rank FROM scored) WHERE rank < {k})"""


# --- text -----------------------------------------------------------------


@query(f"SELECT doc_id, {S.clean_sql('text')} AS clean FROM documents")
def clean_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.cleaned(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {S.fold_sql('text')} AS folded FROM documents")
def fold_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.folded(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, len(regexp_extract_all({S.fold_sql('text')}, '[\\p{{L}}\\p{{N}}]+'))::INT AS n_tokens FROM documents")
def tokenize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


_FLAT = S.trim_sql(f"regexp_replace(text, '{S.SPACE}+', ' ', 'g')")


@query(f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 160 THEN {_FLAT} ELSE regexp_replace(substring({_FLAT}, 1, 160), '{S.SPACE}+$', '') || '…' END AS snippet FROM documents")
def snippet(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


_REST = "regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1)"
_REST = f"CASE WHEN {_REST} = '' THEN '/' WHEN starts_with({_REST}, '?') THEN '/' || {_REST} ELSE {_REST} END"


@query(f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || CASE WHEN rest LIKE '%/' AND split_part(rest, '?', 1) <> '/' THEN left(rest, length(rest) - 1) ELSE rest END AS url FROM (SELECT page_id, url, {_REST} AS rest FROM pages)")
def normalize_url(spark, d):
    return _t(spark, d, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, CASE WHEN c = '' THEN 'studio' ELSE c END AS name FROM (SELECT page_id, {S.trim_sql('substring(' + S.trim_sql('''regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|\\x00-\\x1f]', ' ', 'g'), '\\.{2,}', '.', 'g'), ''' + chr(39) + S.SPACE + '''+', ' ', 'g')''') + ', 1, 80)')} AS c FROM pages)")
def safe_export_name(spark, d):
    return _t(spark, d, "pages").select("page_id", T.export_name(F.col("url")).alias("name"))


@query("SELECT item_id, 'query: ' || text AS query_text, 'passage: ' || text AS passage_text FROM benchmark")
def prefix_passage(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.concat(F.lit("query: "), "text").alias("query_text"), F.concat(F.lit("passage: "), "text").alias("passage_text"))


# --- chunks ---------------------------------------------------------------


@query(S.CHUNKS + " SELECT * FROM chunks")
def chunk_documents(spark, d):
    return _chunks(spark, d)


@query(S.CHUNKS + " SELECT source AS notebook_id, count(*) AS n_chunks FROM chunks JOIN documents USING (doc_id) GROUP BY source")
def chunk_counts(spark, d):
    owner = _t(spark, d, "documents").select("doc_id", F.col("source").alias("notebook_id"))
    return _chunks(spark, d).select("doc_id").join(owner, "doc_id").groupBy("notebook_id").agg(F.count("*").alias("n_chunks"))


@query(f"SELECT doc_id, {S.clean_sql('text')} AS rebuilt FROM documents WHERE length({S.clean_sql('text')}) > 0")
def reconstruct(spark, d):
    pieces = F.collect_list(F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.col("text").alias("t")))
    return _chunks(spark, d).groupBy("doc_id").agg(chunking.rebuilt(pieces).alias("rebuilt"))


@query(S.CHUNKS + " SELECT doc_id, (ordinal // 3 + 1)::BIGINT AS page, min(char_start) AS offset_start FROM chunks GROUP BY ALL")
def page_breaks(spark, d):
    return _chunks(spark, d).groupBy("doc_id", (F.expr("ordinal div 3") + 1).cast("long").alias("page")).agg(F.min("char_start").alias("offset_start"))


# --- keyword search -------------------------------------------------------


@query("WITH " + _ASK + ", " + _bm25_sql("SELECT doc_id AS id, text FROM documents", BRANCH_TOP_K) + " SELECT qid, id, score, rank FROM kw")
def bm25_topk(spark, d):
    units = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return keyword.bm25(units, _questions(spark, d), BRANCH_TOP_K).withColumn("rank", F.col("rank").cast("long"))


@query(
    S.CHUNKS + ", " + _ASK + ", " + _bm25_sql("SELECT chunk_id AS id, text FROM chunks", SEARCH_TOP_K)
    + f" SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n, id AS chunk_id, 'doc-' || doc_id::VARCHAR AS title, char_start, char_end, CASE WHEN length({_FLAT}) <= 160 THEN {_FLAT} ELSE regexp_replace(substring({_FLAT}, 1, 160), '{S.SPACE}+$', '') || '…' END AS snippet FROM kw JOIN chunks ON chunk_id = id"
)
def content_search(spark, d):
    chunks = kept(_chunks(spark, d), **TEXTS)  # the index is made of it and the hits are looked up there
    hits = kept(keyword.bm25(chunks.select(F.col("chunk_id").alias("id"), "text"), _questions(spark, d), SEARCH_TOP_K))  # of known size: few are sent to the chunks
    found = hits.join(chunks, hits["id"] == chunks["chunk_id"])
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long")
    return found.select("qid", n.alias("n"), "chunk_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), "char_start", "char_end", T.snippet(F.col("text")).alias("snippet"))


# --- vectors --------------------------------------------------------------

_COS = "CASE WHEN sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))) = 0 THEN 0.0 ELSE list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE)))) END"
_NEAR = f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) - 1 AS rank FROM (
SELECT q.vec_id AS qid, v.vec_id AS id, round(1 - ({_COS.format(a='q.embedding', b='v.embedding')}), 8) + 0.0 AS distance FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rank < {BRANCH_TOP_K})"""


def _near(spark, d):
    """Queries are all vectors whose id is divisible by 20, against all vectors."""
    all_ = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = all_.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    return vectors.top_k(all_, asked, BRANCH_TOP_K).withColumn("rank", F.col("rank").cast("long"))


@query("WITH " + _NEAR + " SELECT qid, id, distance, rank FROM near")
def cosine_topk(spark, d):
    return _near(spark, d)


@query("WITH " + _NEAR + f" SELECT qid, id, distance FROM near WHERE distance <= {MAX_DISTANCE}")
def relevance_filter(spark, d):
    return _near(spark, d).where(F.col("distance") <= MAX_DISTANCE).select("qid", "id", "distance")


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 8) AS norm2, round(u[1], 8) + 0.0 AS first_value FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)")
def l2_normalize(spark, d):
    unit = _t(spark, d, "embeddings").select("vec_id", vectors.normalized(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 8).alias("norm2"), (F.round(F.col("u")[0], 8) + 0.0).alias("first_value"))


@query("WITH " + _NEAR + ", other AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY vec_id) - 1 AS rank FROM embeddings, (SELECT vec_id AS qid, label AS l FROM embeddings WHERE vec_id % 20 = 0) WHERE label = l QUALIFY rank < 10) SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) + 0.0 AS score FROM (SELECT qid, id, rank FROM near UNION ALL SELECT qid, id, rank FROM other) GROUP BY qid, id")
def rrf(spark, d):
    e = _t(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("l"))
    least = F.slice(F.array_sort(F.collect_list("vec_id")), 1, 10)  # the same for all queries of a label
    first = e.groupBy("label", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(least.alias("ids")).groupBy("label").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 10).alias("ids"))
    other = asked.join(first, F.col("l") == F.col("label")).select("qid", F.posexplode("ids").alias("rank", "id"))
    return vectors.rrf([_near(spark, d), other])


def _mmr_sql(candidates: str, n: int) -> str:
    """WITH parts: picked(qid, ids) of candidates (qid, id, rank, v, q), one more in each step."""
    like = _COS.format(a="a.v", b="b.v")
    return f"""m AS ({candidates}), rel AS (SELECT qid, id, rank, {_COS.format(a='q', b='v')} AS rel FROM m),
pairs AS (SELECT a.qid, a.id AS a, b.id AS b, {like} AS c FROM m a JOIN m b ON a.qid = b.qid AND a.id <> b.id),
r(qid, step, ids) AS (SELECT DISTINCT qid, 0, []::BIGINT[] FROM m UNION ALL
SELECT qid, step + 1, list_append(any_value(ids), arg_min(id, key)) FROM (
SELECT r.qid, step, any_value(ids) AS ids, rel.id, round(-round(0.7 * any_value(rel) - 0.3 * greatest(0, coalesce(max(c), 0)), 10) * 1e10)::BIGINT * 100 + any_value(rank) AS key
FROM r JOIN rel ON rel.qid = r.qid LEFT JOIN pairs ON pairs.qid = r.qid AND pairs.a = rel.id AND list_contains(r.ids, pairs.b)
WHERE step < {n} AND NOT list_contains(r.ids, rel.id) GROUP BY r.qid, step, rel.id) GROUP BY qid, step),
picked AS (SELECT qid, max_by(ids, step) AS ids FROM r GROUP BY qid)"""


@query(
    "WITH RECURSIVE " + _NEAR + ", " + _mmr_sql("SELECT near.qid, near.id, rank, v.embedding AS v, q.embedding AS q FROM near JOIN embeddings v ON v.vec_id = near.id JOIN embeddings q ON q.vec_id = near.qid", 6)
    + " SELECT qid, (k - 1)::INT AS place, ids[k] AS id FROM (SELECT qid, ids, unnest(range(1, len(ids) + 1)) AS k FROM picked)"
)
def mmr(spark, d):
    e = _t(spark, d, "embeddings")
    near = _near(spark, d).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "v"))).alias("c"))
    both = lists.join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "qid")
    return both.select("qid", F.posexplode(vectors.mmr(F.col("c"), F.col("q"), 6)).alias("place", "id"))


# --- context --------------------------------------------------------------


def _pack_sql(key: str, order: str, forced: str, budget: int) -> str:
    """Packing step by step over chunks ``c`` (key, chunk_id, ordinal, doc_id, text)."""
    size = "length('[' || {n} || '] (Nguồn: doc-' || c.doc_id || ', trang —)' || chr(10) || c.text) + 2"
    fits = f"({forced} OR n = 0 OR used + {size.format(n='n + 1')} <= {budget})"
    return f"""c AS (SELECT {key} AS key, chunk_id, ordinal, doc_id, chunks.text, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k, count(*) OVER (PARTITION BY {key}) AS total FROM chunks JOIN documents USING (doc_id)),
p(key, k, used, n, ids) AS (SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM c UNION ALL
SELECT p.key, c.k, CASE WHEN {fits} THEN used + {size.format(n='n + 1')} ELSE used END, CASE WHEN {fits} THEN n + 1 ELSE n END, CASE WHEN {fits} THEN CASE WHEN n = 0 THEN '' ELSE ids || ',' END || chunk_id ELSE ids END FROM p JOIN c ON c.key = p.key AND c.k = p.k + 1)
SELECT p.key AS {key}, n, used, ids, n < total AS truncated FROM p JOIN c ON c.key = p.key AND c.k = p.k WHERE p.k = total"""


def _packed(rows, key, order, budget):
    """n, used, ids, truncated of each group's packed chunks."""
    title = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    sized = rows.select(key, *order, "force", F.col("chunk_id").alias("id"), packing.size_of(title, F.lit(None).cast("int"), F.col("text")).alias("size"))
    taken, stats = packing.pack(sized, key, order, budget)
    ids = taken.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("ids"))
    return stats.join(ids, key).select(key, "n", "used", "ids", "truncated")


@query(S.CHUNKS + ", " + _pack_sql("doc_id", "ordinal", "false", CONTEXT_BUDGET))
def context_pack(spark, d):
    return _packed(_chunks(spark, d).withColumn("force", F.lit(False)), "doc_id", ["ordinal"], CONTEXT_BUDGET)


@query(S.CHUNKS + ", " + _pack_sql("source", "ordinal, doc_id", "c.ordinal = 0", STUDIO_BUDGET).replace("p.key AS source", "p.key AS notebook_id"))
def balanced_pack(spark, d):
    """For each notebook its sources' chunks in rounds; the first of every source is taken in any case."""
    owner = _t(spark, d, "documents").select("doc_id", F.col("source").alias("notebook_id"))
    rows = _chunks(spark, d).join(owner, "doc_id").withColumn("force", F.col("ordinal") == 0)
    return _packed(rows, "notebook_id", ["ordinal", "doc_id"], STUDIO_BUDGET)


# --- citations ------------------------------------------------------------


@query("WITH a AS (SELECT conv_id, turn, text || ' [1] and [9] , then [' || (turn % 5)::VARCHAR || '].' AS answer FROM conversations), t AS (SELECT conv_id, turn, unnest(regexp_extract_all(answer, '\\[(\\d{1,6})\\]', 1))::INT AS n FROM a) SELECT conv_id, turn, n FROM t WHERE n BETWEEN 1 AND 3 GROUP BY ALL")
def validate_citations(spark, d):
    """Cited numbers of answers that the context (1 to 3) has, each once."""
    answer = F.concat("text", F.lit(" [1] and [9] , then ["), (F.col("turn") % 5).cast("string"), F.lit("]."))
    cited = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)))).alias("n"))
    return cited.select("conv_id", "turn", F.col("n").cast("int").alias("n")).where("n between 1 and 3").distinct()


@query(f"SELECT conv_id, turn, CASE WHEN trim(text) = '' OR regexp_matches(text, '(?i)không tìm thấy') THEN 'not-found' WHEN role = 'user' THEN 'open' ELSE 'grounded' END AS decision, CASE WHEN trim(text) = '' THEN '{NOT_FOUND}' ELSE text END AS answer FROM conversations")
def answer_decision(spark, d):
    missing = A.is_not_found(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.when(missing, "not-found").when(F.col("role") == "user", "open").otherwise("grounded").alias("decision"), F.when(T.trimmed(F.col("text")) == "", NOT_FOUND).otherwise(F.col("text")).alias("answer"))


# --- intervals ------------------------------------------------------------


@query(S.CHUNKS + " SELECT chunk_id, min(seg * 2.5) AS t_start, max(seg * 2.5 + 2.5) AS t_end FROM chunks, LATERAL (SELECT unnest(range(char_start // 120, (char_end - 1) // 120 + 1)) AS seg) GROUP BY chunk_id")
def time_for_chunk(spark, d):
    """Chunks against a map of 120-character segments of 2.5 s: an interval overlap that is an equality of buckets."""
    c = _chunks(spark, d).withColumn("seg", F.explode(F.sequence(F.expr("char_start div 120"), F.expr("(char_end - 1) div 120"))))
    return c.groupBy("chunk_id").agg(F.min(F.col("seg") * 2.5).alias("t_start"), F.max(F.col("seg") * 2.5 + 2.5).alias("t_end"))


# --- catalogue ------------------------------------------------------------


@query("SELECT n_name AS name, n_nationkey AS id, coalesce(n, 0) AS sources FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def notebook_list(spark, d):
    counts = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = _t(spark, d, "nation")
    return nations.join(counts, nations["n_nationkey"] == counts["c_nationkey"], "left").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"), F.coalesce("n", F.lit(0)).alias("sources"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_flag(spark, d):
    first = F.min("doc_id").over(Window.partitionBy("source", F.sha2(F.col("text").cast("binary"), 256)))
    return _t(spark, d, "documents").select("doc_id", (F.col("doc_id") > first).alias("duplicate"))


@query("SELECT user_id, event_type, min(event_id) AS id, min(ts) AS created_at, max(ts) AS updated_at, max_by(value, event_id) AS content FROM events GROUP BY user_id, event_type")
def studio_upsert(spark, d):
    """Last write wins, first id and creation time stay."""
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("value", "event_id").alias("content"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7')")
def cascade_delete(spark, d):
    gone = _t(spark, d, "documents").select("source").distinct().where("source in ('src0', 'src7')")
    return _t(spark, d, "documents").join(gone, "source", "left_anti").select("doc_id", "source")


@query("SELECT conv_id, turn * 2 + k AS created_at, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM conversations, (SELECT unnest([0, 1]) AS k)")
def save_turn(spark, d):
    both = F.explode(F.array(*(F.struct((F.col("turn") * 2 + k).alias("created_at"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))))).alias("r")
    return _t(spark, d, "conversations").select("conv_id", "text", both).select("conv_id", "r.created_at", "r.role", "text")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 6")
def last_six_turns(spark, d):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return _t(spark, d, "conversations").withColumn("k", k).where("k <= 6").select("conv_id", "turn", "role", "text")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 <> 0) AS pending, bool_or(doc_id % 3 = 0) AS any_ready FROM documents GROUP BY source")
def status_rollup(spark, d):
    ready = F.col("doc_id") % 3 == 0
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(~ready).alias("pending"), F.bool_or(ready).alias("any_ready"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def reindex_todo(spark, d):
    docs, e = _t(spark, d, "documents"), _t(spark, d, "embeddings")
    return docs.join(e, docs["doc_id"] == e["vec_id"], "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, coalesce('v' || e.label::VARCHAR, '" + DEFAULT_TITLE + "') AS title FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def title_lookup(spark, d):
    docs, e = _t(spark, d, "documents"), _t(spark, d, "embeddings").select("vec_id", "label")
    return docs.join(e, docs["doc_id"] == e["vec_id"], "left").select("doc_id", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit(DEFAULT_TITLE)).alias("title"))


# --- validation, JSON, scalars --------------------------------------------


@query(f"SELECT conv_id, turn, CASE WHEN length({S.trim_sql('text')}) = 0 THEN 'empty' WHEN length({S.trim_sql('text')}) > 2000 THEN 'long' ELSE 'ok' END AS verdict FROM conversations")
def question_valid(spark, d):
    n = F.length(T.trimmed(F.col("text")))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.when(n == 0, "empty").when(n > 2000, "long").otherwise("ok").alias("verdict"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN '0 B' ELSE CASE WHEN i = 0 OR v >= 100 THEN round(v)::BIGINT::VARCHAR ELSE regexp_replace(printf('%.1f', round(v, 1)), '\\.0$', '') END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB', 'PB'][i + 1] END AS size FROM (SELECT o_orderkey, o_totalprice, i, o_totalprice / pow(1024, i) AS v FROM (SELECT o_orderkey, o_totalprice, least(5, floor(ln(greatest(o_totalprice, 1)) / ln(1024)))::INT AS i FROM orders))")
def format_bytes(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", K.bytes_label(F.col("o_totalprice")).alias("size"))


_DIFF = "(1704067200000 + 2592000000 - epoch_ms(ts))"


@query(f"SELECT event_id, CASE WHEN x < 60000 THEN 'vừa xong' WHEN x < 3600000 THEN (x // 60000)::VARCHAR || ' phút trước' WHEN x < 86400000 THEN (x // 3600000)::VARCHAR || ' giờ trước' WHEN x < 172800000 THEN 'hôm qua' WHEN x < 604800000 THEN (x // 86400000)::VARCHAR || ' ngày trước' WHEN x < 1209600000 THEN 'tuần trước' ELSE strftime(ts, '%d/%m/%Y') END AS label FROM (SELECT event_id, ts, {_DIFF} AS x FROM events)")
def relative_time(spark, d):
    x = F.lit(1704067200000 + 2592000000) - F.unix_millis(F.col("ts").cast("timestamp"))
    return _t(spark, d, "events").select("event_id", K.relative_time(x, F.col("ts")).alias("label"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'rate-limit' WHEN s >= 500 THEN 'server' ELSE 'unknown' END AS status FROM (SELECT 400 + event_id % 150 AS s FROM events)) GROUP BY status")
def error_class(spark, d):
    s = F.lit(400) + F.col("event_id") % 150
    return _t(spark, d, "events").groupBy(K.error_class(s, F.lit(False)).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS last_event FROM events GROUP BY user_id")
def latest_progress(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("last_event"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS folded FROM conversations GROUP BY conv_id")
def token_fold(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, "").alias("folded"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

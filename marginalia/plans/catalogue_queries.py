"""Registered queries of the catalogue: documents as sources, their source as notebook; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import config as C
from marginalia.functions import text as T
from marginalia.operators import catalog, keyword, retrieval, vectors
from marginalia.operators.numbering import numbered
from marginalia.plans import chunk_sql as S
from marginalia.plans.queries import _FLAT, _COS, _bm25_sql, _chunks, _t, query
from marginalia.sources.scratch import TEXTS, kept

_STATUS = f"{list(C.STATES)}[doc_id % 5 + 1]"
_SRC = f"src AS (SELECT doc_id AS id, source AS notebook_id, lang AS kind, {_STATUS} AS status, CASE WHEN doc_id % 5 = 4 THEN 'x' END AS error_label, doc_id * 37 % 1009 AS created_at, doc_id * 37 % 1009 AS updated_at, sha256(text) AS content_hash FROM documents)"


def _sources(spark, d):
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, C.STATES)), (i % 5 + 1).cast("int"))
    made = i * 37 % 1009
    return _t(spark, d, "documents").select(i.alias("id"), F.col("source").alias("notebook_id"), F.col("lang").alias("kind"), status.alias("status"), F.when(i % 5 == 4, "x").alias("error_label"), made.alias("created_at"), made.alias("updated_at"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query(f"WITH {_SRC} SELECT l.doc_id AS id, src.notebook_id, src.id IS NOT NULL AS found FROM (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels) l LEFT JOIN src ON src.id = l.doc_id")
def point_lookup(spark, d):
    keys = _t(spark, d, "labels").select((F.col("doc_id") * 2).alias("id")).distinct()
    return catalog.lookup(_sources(spark, d).select("id", "notebook_id"), keys)


@query(f"WITH {_SRC} SELECT id, notebook_id, row_number() OVER (PARTITION BY notebook_id ORDER BY created_at, id) AS place FROM src")
def sources_in_order(spark, d):
    return catalog.ordered(_sources(spark, d), "notebook_id", F.col("created_at")).select("id", "notebook_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_SRC} SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS place FROM src")
def sources_by_status(spark, d):
    return catalog.ordered(_sources(spark, d), "status", F.col("created_at")).select("id", "status", F.col("place").cast("long").alias("place"))


@query(f"WITH {_SRC} SELECT notebook_id, max(updated_at) AS updated_at, row_number() OVER (ORDER BY max(updated_at) DESC, notebook_id) AS place FROM src GROUP BY notebook_id")
def recent_notebooks(spark, d):
    """Notebooks, last changed first: sorted by ranges, no task has them all."""
    books = _sources(spark, d).groupBy("notebook_id").agg(F.max("updated_at").alias("updated_at")).withColumn("all", F.lit(0))
    return numbered(books, "all", [F.desc("updated_at"), F.asc("notebook_id")]).select("notebook_id", "updated_at", "place")


@query("SELECT item_id AS qid, row_number() OVER (PARTITION BY item_id ORDER BY k) AS n, doc_id AS id, lang FROM benchmark, (SELECT unnest(range(12)) AS k), documents WHERE doc_id = (item_id * 31 + k * 997) % 3000")
def ordered_fetch(spark, d):
    """Twelve ids of each question in their order, most of which exist."""
    k = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("place")
    wanted = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), k).withColumn("id", (F.col("qid") * 31 + F.col("place") * 997) % 3000)
    found = retrieval.ordered_fetch(wanted, _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"))
    return found.select("qid", F.col("n").cast("long").alias("n"), "id", "lang")


@query("SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS source_id, o_custkey AS notebook_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def chunk_refs(spark, d):
    chunks = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("source_id"))
    return catalog.chunk_refs(chunks, _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("notebook_id")))


@query(f"WITH {_SRC} SELECT id, notebook_id FROM src WHERE status = 'ready' AND (kind <> 'de' OR id % 2 = 1)")
def ready_sources(spark, d):
    """Sources that can be asked; of German ones only those of a given list."""
    wanted = F.when(F.col("kind") == "de", F.when(F.col("id") % 2 == 1, F.array("id")).otherwise(F.expr("cast(array() as array<bigint>)")))
    return catalog.ready(_sources(spark, d), wanted).select("id", "notebook_id")


@query("WITH c AS (SELECT source AS notebook_id, count(*) AS n_chunks FROM documents GROUP BY 1), v AS (SELECT source AS notebook_id, count(*) AS n_vectors FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY 1) SELECT notebook_id, n_chunks, coalesce(n_vectors, 0) AS n_vectors, coalesce(n_vectors, 0) < n_chunks AS incomplete FROM c LEFT JOIN v USING (notebook_id)")
def completeness(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("notebook_id"))
    return catalog.completeness(docs, _t(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")))


@query(f"WITH {_SRC}, n AS (SELECT notebook_id, count(*) AS n, count(*) FILTER (WHERE status NOT IN ('ready', 'error')) AS pending, bool_or(status = 'ready') AS any_ready FROM src GROUP BY 1) SELECT *, n || ' nguồn · ' || CASE WHEN pending = 0 THEN 'đã lập chỉ mục' ELSE 'đang xử lý ' || pending END AS label FROM n")
def source_rollup(spark, d):
    return catalog.rollup(_sources(spark, d))


@query(f"WITH {_SRC} SELECT id, row_number() OVER (PARTITION BY notebook_id, content_hash ORDER BY created_at, id) > 1 AS duplicate FROM src")
def duplicate_sources(spark, d):
    return catalog.duplicates(_sources(spark, d)).select("id", "duplicate")


@query(f"WITH {_SRC} SELECT id, notebook_id, status, created_at FROM src UNION ALL SELECT page_id + 1000000, 'web', 'queued', 7 FROM pages")
def add_sources(spark, d):
    new = _t(spark, d, "pages").select((F.col("page_id") + 1_000_000).alias("id"), F.lit("web").alias("notebook_id"), F.lit("url").alias("kind"), F.col("url").alias("origin"))
    return catalog.add_sources(_sources(spark, d), new, F.lit(7).cast("long")).select("id", "notebook_id", "status", "created_at")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, -1 FROM labels")
def replace_vectors(spark, d):
    """Vectors of labelled documents are made anew; doing it twice changes nothing."""
    old = _t(spark, d, "embeddings").select("vec_id", "label")
    new = _t(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(-1).alias("label")).distinct()
    return catalog.replaced(catalog.replaced(old, new, "vec_id"), new, "vec_id")


@query(f"WITH {_SRC}, p AS (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'ready' ELSE 'error' END AS status, CASE quality WHEN 1 THEN NULL ELSE 'low' END AS error_label FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)) SELECT src.id, coalesce(p.status, src.status) AS status, CASE WHEN p.id IS NULL THEN src.error_label ELSE p.error_label END AS error_label, CASE WHEN p.id IS NULL THEN updated_at ELSE 5000 END AS updated_at FROM src LEFT JOIN p USING (id)")
def point_updates(spark, d):
    """Labelled sources get their state from the label; an error label is reset to null."""
    q = F.max("quality") == 1
    changes = _t(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.when(q, "ready").otherwise("error").alias("status"), F.when(~q, "low").alias("error_label"))
    return catalog.updated(_sources(spark, d), changes, "id", F.lit(5000).cast("long")).select("id", "status", "error_label", "updated_at")


@query("""WITH gone AS (SELECT DISTINCT 'src' || item_id AS nb FROM benchmark WHERE item_id % 2 = 0), s AS (SELECT doc_id FROM documents WHERE source IN (SELECT nb FROM gone))
SELECT 'source' AS tbl, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT 'chunk', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT 'vector', count(*) FROM embeddings WHERE 'src' || label NOT IN (SELECT nb FROM gone) UNION ALL SELECT 'chat_message', count(*) FROM conversations WHERE 'src' || conv_id NOT IN (SELECT nb FROM gone)""")
def cascade_counts(spark, d):
    """What is left of each table when every second notebook and all that hangs on it goes."""
    gone = _t(spark, d, "benchmark").where("item_id % 2 = 0").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("notebook_id"))
    named = lambda t, c: _t(spark, d, t).select(F.concat(F.lit("src"), F.col(c).cast("string")).alias("notebook_id"))
    tables = {"source": _sources(spark, d), "chunk": _t(spark, d, "labels").select(F.col("doc_id").alias("source_id")), "vector": named("embeddings", "label"), "chat_message": named("conversations", "conv_id")}
    counts = [df.select(F.lit(name).alias("tbl")).groupBy("tbl").agg(F.count("*").alias("n")) for name, df in catalog.cascade(tables, gone).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT user_id, event_type, min(event_id) AS id, min(event_id) AS created_at, max(event_id) AS updated_at, max_by(value, event_id) AS content FROM events GROUP BY ALL")
def upsert_rows(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("event_id").alias("created_at"), F.col("event_id").alias("updated_at"), F.col("value").alias("content"))
    return catalog.upserted(rows, ["user_id", "event_type"], "updated_at")


@query("SELECT conv_id AS notebook_id, r AS role, CASE WHEN r = 'user' THEN text ELSE text || '!' END AS content, CASE WHEN r = 'assistant' THEN CASE WHEN turn % 2 = 0 THEN 'open' ELSE 'grounded' END END AS mode_used, turn * 10 + (r = 'assistant')::INT AS created_at FROM conversations, (SELECT unnest(['user', 'assistant']) AS r)")
def chat_turns(spark, d):
    asked = _t(spark, d, "conversations").select(F.col("conv_id").alias("notebook_id"), F.col("text").alias("question"), F.concat("text", F.lit("!")).alias("answer"), F.when(F.col("turn") % 2 == 0, "open").alias("mode"), (F.col("turn") * 10).alias("asked_at"))
    return catalog.turns(asked)


@query(f"WITH {_SRC} SELECT id, CASE WHEN status IN ('queued', 'processing') THEN 'error' ELSE status END AS status, CASE WHEN status IN ('queued', 'processing') THEN '{C.INTERRUPTED}' ELSE error_label END AS error_label, CASE WHEN status IN ('queued', 'processing') THEN 9 ELSE updated_at END AS updated_at FROM src")
def restart_recovery(spark, d):
    return catalog.recovered(_sources(spark, d), F.lit(9).cast("long")).select("id", "status", "error_label", "updated_at")


@query(f"WITH {_SRC} SELECT id, CASE WHEN status = 'error' AND id IN (SELECT doc_id FROM labels) THEN 'queued' ELSE status END AS status, CASE WHEN status = 'error' AND id IN (SELECT doc_id FROM labels) THEN NULL ELSE error_label END AS error_label FROM src")
def retry_sources(spark, d):
    wanted = _t(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return catalog.retried(_sources(spark, d), wanted, F.lit(9).cast("long")).select("id", "status", "error_label")


@query("SELECT doc_id AS chunk_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS batch FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def reindex_resume(spark, d):
    """Batches of the chunks that a cut-off reindex has left."""
    refs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.col("source").alias("notebook_id"))
    return catalog.reindex_plan(refs, _t(spark, d, "embeddings").select(F.col("vec_id").alias("id")), F.lit(C.MODEL_REINDEXING)).select("chunk_id", "batch")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def live_vectors(spark, d):
    """Vectors whose source is still there when they are to be written."""
    new = _t(spark, d, "embeddings").select("vec_id", "label", F.col("vec_id").alias("source_id"))
    return catalog.live_only(new, _sources(spark, d)).select("vec_id", "label")


# --- searches within a notebook -------------------------------------------



@query("WITH questions AS (SELECT item_id AS qid, text AS question FROM benchmark), " + _bm25_sql("SELECT doc_id AS id, text FROM documents", 10**9) + ", o AS (SELECT kw.qid, kw.id, kw.score, row_number() OVER (PARTITION BY kw.qid ORDER BY kw.score, kw.id) - 1 AS rank FROM kw JOIN documents ON doc_id = kw.id WHERE source = 'src' || kw.qid % 20) SELECT qid, id, score, rank FROM o WHERE rank < 10")
def scoped_keyword(spark, d):
    """Whole test items ask, each in one notebook; the statistics are those of all documents."""
    units = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("scope"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"))
    return keyword.bm25(units, asked, C.BRANCH_TOP_K).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) - 1 AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, round(1 - ({_COS.format(a='q.embedding', b='v.embedding')}), 8) + 0.0 AS distance FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q WHERE q.label = v.label)) WHERE rank < 10")
def scoped_topk(spark, d):
    """Nearest vectors of the same notebook, for every vector whose id is divisible by 20."""
    all_ = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))
    asked = all_.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"), "scope")
    return vectors.top_k(all_, asked, C.BRANCH_TOP_K).select("qid", "id", "distance", F.col("rank").cast("long").alias("rank"))


@query(
    S.CHUNKS + ", questions AS (SELECT item_id AS qid, text AS question FROM benchmark WHERE item_id % 3 > 0), " + _bm25_sql("SELECT chunk_id AS id, text FROM chunks", 10**9)
    + ", o AS (SELECT kw.*, doc_id, char_start, text, row_number() OVER (PARTITION BY qid ORDER BY score, kw.id) AS n FROM kw JOIN chunks ON chunk_id = kw.id JOIN documents USING (doc_id) WHERE source = 'src' || qid % 20)".replace("char_start, text,", "char_start, chunks.text,")
    + f" SELECT qid, n, id AS chunk_id, coalesce('v' || label, '{C.DEFAULT_TITLE}') AS title, char_start, CASE WHEN length({_FLAT}) <= 160 THEN {_FLAT} ELSE regexp_replace(substring({_FLAT}, 1, 160), '{S.SPACE}+$', '') || '…' END AS snippet FROM o LEFT JOIN embeddings ON vec_id = doc_id WHERE n <= 20"
)
def notebook_search(spark, d):
    """Search within a notebook; questions without a notebook are refused, titles are looked up and have a default."""
    chunks = kept(_chunks(spark, d).join(_t(spark, d, "documents").select("doc_id", F.col("source").alias("scope")), "doc_id"), **TEXTS)
    scope = F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), scope.alias("scope")).where("scope is not null")
    hits = keyword.bm25(chunks.select(F.col("chunk_id").alias("id"), "text", "scope"), asked, C.SEARCH_TOP_K)
    found = retrieval.ordered_fetch(hits.select("qid", F.col("rank").alias("place"), "id"), chunks.withColumnRenamed("chunk_id", "id"))
    titles = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("title"))
    return found.join(titles, "doc_id", "left").select("qid", F.col("n").cast("long").alias("n"), F.col("id").alias("chunk_id"), F.coalesce("title", F.lit(C.DEFAULT_TITLE)).alias("title"), "char_start", T.snippet(F.col("text")).alias("snippet"))

"""Registered queries of questions, results and contents of notebooks, and of intervals; importing this registers them.

Documents are sources, their source is the notebook.  The models are stand-ins that any
machine has: vectors are hashed words, and the answering one cites what it is shown.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import functions as F

from marginalia.config import DEFAULT_TITLE
from marginalia.functions import answers as A
from marginalia.functions import checks as K
from marginalia.functions import plugins
from marginalia.operators import catalog, intervals, rag
from marginalia.plans import chunk_sql as S
from marginalia.plans.queries import _chunks, _t, query
from marginalia.sources.scratch import kept


class Quoting:
    """A model that answers with the first words of each block it is shown, and their numbers."""

    id = "quoting"

    def chat(self, prompts: list[str]) -> list[str]:
        found = (re.findall(r"(?m)^\[(\d+)\] \(.*\)\n\s*(\S+)", p) for p in prompts)
        return [" ".join(f"{word} [{n}]" for n, word in blocks) for blocks in found]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [_hashed_words(t) for t in texts]


def _hashed_words(text: str, dim: int = 256) -> list[float]:
    """How often the words of each hash occur."""
    found = [0.0] * dim
    for word in text.lower().split():
        found[zlib.crc32(word.encode()) % dim] += 1
    return found


def _sources(spark, d):
    """Chunks with a page for each three and their notebook, and the documents' notebooks and titles."""
    owner = _t(spark, d, "documents").select("doc_id", F.col("source").alias("notebook_id"), F.when(F.col("doc_id") % 5 > 0, F.concat("lang", F.lit(" "), F.col("doc_id").cast("string"))).alias("title"))
    chunks = kept(_chunks(spark, d).withColumn("page", F.expr("ordinal div 3 + 1")).join(owner, "doc_id"))
    return chunks, owner


def _notebooks(spark, d):
    """Chunks, vectors, titles, questions of the test items with a conversation before them."""
    chunks, owner = _sources(spark, d)
    known = chunks.select(F.col("chunk_id").alias("id"), plugins.embeddings(F.col("text"), "passage", Quoting().embed).alias("vector"), "notebook_id")
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    talks = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    talks = talks.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))
    i = F.col("item_id")
    asked = _t(spark, d, "benchmark").select(i.alias("qid"), F.col("text").alias("question"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("notebook_id"), F.when(i % 3 == 0, "open").otherwise("grounded").alias("mode"), (i % 11 == 0).alias("reindexing"))
    return chunks, kept(known), owner, asked.join(talks, F.col("qid") == F.col("conv_id"), "left").drop("conv_id")


def _found(spark, d):
    chunks, known, titles, asked = _notebooks(spark, d)
    return rag.retrieve(asked, chunks.drop("title"), known, Quoting().embed), titles, asked


@query()
def rag_retrieve(spark, d):
    """Best chunks of every test item's notebook for it, by both branches."""
    found, _, _ = _found(spark, d)
    return found.select("qid", "n", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


@query()
def rag_answers(spark, d):
    found, titles, asked = _found(spark, d)
    done = rag.answer(asked, found, titles, Quoting())
    return done.select("qid", "decision", "answer", F.transform("citations", lambda c: c["chunk_id"]).alias("cited"))


@query()
def studio_results(spark, d):
    """A result of all sources of every notebook, sources that are not ready left out."""
    chunks, owner = _sources(spark, d)  # no vectors are needed
    status = F.when(F.col("doc_id") % 7 == 0, "error").otherwise("ready")
    sources = owner.select(F.col("doc_id").alias("id"), "title", "notebook_id", status.alias("status"))
    made = rag.studio(chunks.drop("title"), sources, F.lit("summary"), Quoting(), F.lit(1).cast("long"))
    return made.select("notebook_id", "kind", F.length("content").alias("n_chars"), F.size(A.citations_of(F.col("citations_json"))).alias("n_cited"), "truncated")


@query(
    S.CHUNKS + f""", wanted AS (SELECT DISTINCT doc_id * 2 AS id FROM labels), b AS (SELECT doc_id AS id, string_agg(page || ':' || o, ',' ORDER BY page) AS breaks FROM (SELECT doc_id, ordinal // 3 + 1 AS page, min(char_start) AS o FROM chunks GROUP BY ALL) GROUP BY doc_id)
SELECT w.id, d.doc_id IS NOT NULL AS found, lang AS kind, 'doc-' || d.doc_id AS title, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN 7 END, -1) AS page_count, CASE WHEN d.doc_id IS NOT NULL THEN {S.clean_sql('text')} END AS text, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(breaks, '') END AS breaks FROM wanted w LEFT JOIN documents d ON d.doc_id = w.id LEFT JOIN b ON b.id = w.id"""
)
def source_content(spark, d):
    """What a viewer shows of each source that is asked for, put together from its chunks; some are gone."""
    docs = _t(spark, d, "documents")
    sources = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, 7).alias("page_count"))
    wanted = _t(spark, d, "labels").select((F.col("doc_id") * 2).alias("id")).distinct()
    found = catalog.source_content(wanted, sources, _chunks(spark, d).withColumn("page", F.expr("cast(ordinal div 3 + 1 as int)")))
    breaks = F.array_join(F.transform("page_breaks", lambda b: F.concat(b["page"].cast("string"), F.lit(":"), b["offset"].cast("string"))), ",")
    return found.select("id", "found", "kind", "title", F.coalesce("page_count", F.lit(-1)).alias("page_count"), "text", breaks.alias("breaks"))


# --- intervals of two tables ------------------------------------------------------

_SPANS = """l AS (SELECT o_orderkey AS id, o_custkey % 50 AS key, o_orderkey AS s, o_orderkey + (o_orderkey % 7) * (o_orderkey % 97) AS e FROM orders),
r AS (SELECT l_suppkey % 60 AS key, l_orderkey AS s, l_orderkey + l_quantity::BIGINT * (CASE WHEN l_partkey % 20 = 0 THEN 40 ELSE 1 END) AS e, l_discount AS x, l_tax AS y, l_quantity / 100 AS w, l_quantity / 50 AS h FROM lineitem)"""


def _spans(spark, d):
    o = F.col("o_orderkey")
    left = _t(spark, d, "orders").select(o.alias("id"), (F.col("o_custkey") % 50).alias("key"), o.alias("start"), (o + (o % 7) * (o % 97)).alias("end"))
    size = F.col("l_quantity").cast("long") * F.when(F.col("l_partkey") % 20 == 0, 40).otherwise(1)
    boxes = {"x": F.col("l_discount"), "y": F.col("l_tax"), "w": F.col("l_quantity") / 100, "h": F.col("l_quantity") / 50}
    right = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 60).alias("key"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + size).alias("end"), *(c.alias(n) for n, c in boxes.items()))
    return left, right


@query(f"WITH {_SPANS} SELECT l.id, min(r.s * 0.5) AS t_start, max(r.e * 0.5) AS t_end FROM l LEFT JOIN r ON l.key = r.key AND l.s < r.e AND r.s < l.e GROUP BY l.id")
def segment_times(spark, d):
    """Times of the segments that each range overlaps; ranges and segments are uneven and nested, some ranges meet none."""
    left, right = _spans(spark, d)
    timed = right.select("key", "start", "end", (F.col("start") * 0.5).alias("t_start"), (F.col("end") * 0.5).alias("t_end"))
    return intervals.timed(left, timed, "key", "id").select("id", "t_start", "t_end")


@query(f"WITH {_SPANS} SELECT l.id, round(min(x), 9) AS x, round(min(y), 9) AS y, round(max(x + w) - min(x), 9) AS w, round(max(y + h) - min(y), 9) AS h FROM l LEFT JOIN r ON l.key = r.key AND l.s < r.e AND r.s < l.e GROUP BY l.id")
def segment_boxes(spark, d):
    left, right = _spans(spark, d)
    return intervals.boxed(left, right, "key", "id").select("id", *(F.round(c, 9).alias(c) for c in "xywh"))


# --- records as users get them ------------------------------------------------------


@query(
    S.CHUNKS + """ SELECT chunk_id AS id, doc_id AS "sourceId", ordinal, CASE WHEN ordinal % 3 = 0 THEN ordinal * 2.0 END AS "tStart", CASE WHEN ordinal % 6 = 0 THEN ordinal * 2.0 + 1 WHEN ordinal % 3 = 0 THEN ordinal * 2.0 END AS "tEnd",
CASE WHEN ordinal % 2 = 0 THEN ordinal / 10 || '|' || (CASE WHEN ordinal % 4 = 0 THEN 0.5 ELSE 0.0 END) END AS bbox FROM chunks"""
)
def chunk_records(spark, d):
    """Chunks as nested records whose times and boxes are there only where they are known."""
    k = F.col("ordinal")
    rows = _chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("source_id"), "ordinal", "text", F.lit(None).cast("int").alias("page"), "char_start", "char_end", F.when(k % 3 == 0, k * 2.0).alias("t_start"), F.when(k % 6 == 0, k * 2.0 + 1).alias("t_end"), F.when(k % 2 == 0, k / 10).alias("bbox_x"), F.when(k % 4 == 0, 0.5).alias("bbox_y"), F.lit(None).cast("double").alias("bbox_w"), F.lit(None).cast("double").alias("bbox_h"))
    r = rows.select(catalog.chunk_struct().alias("r"))
    box = F.concat_ws("|", F.col("r.locator.bbox.x").cast("string"), F.col("r.locator.bbox.y").cast("string"))
    return r.select("r.id", "r.sourceId", "r.ordinal", "r.locator.tStart", "r.locator.tEnd", F.when(F.col("r.locator.bbox").isNotNull(), box).alias("bbox"))


@query(S.CHUNKS + " SELECT source AS notebook_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) JOIN documents USING (doc_id) GROUP BY source")
def longest_group(spark, d):
    owner = _t(spark, d, "documents").select("doc_id", F.col("source").alias("notebook_id"))
    return catalog.longest_group(_chunks(spark, d).join(owner, "doc_id"), "notebook_id", "doc_id")


@query("SELECT conv_id, turn, role, '{\"role\":\"' || role || '\",\"content\":\"[REDACTED]\",\"parts\":[{\"n\":' || turn || ',\"token\":\"[REDACTED]\"}],\"more\":{\"query\":\"[REDACTED]\",\"kind\":\"k\"}}' AS logged FROM conversations")
def redacted_log(spark, d):
    """Nested metadata with the private fields hidden at every depth."""
    part = F.struct(F.col("turn").alias("n"), F.col("text").alias("token"))
    meta = F.struct("role", F.col("text").alias("content"), F.array(part).alias("parts"), F.create_map(F.lit("query"), F.col("text"), F.lit("kind"), F.lit("k")).alias("more"))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role", meta.alias("meta"))
    return rows.select("conv_id", "turn", "role", F.to_json(A.redacted_deep(F.col("meta"), rows.schema["meta"].dataType)).alias("logged"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 40 > 0 THEN (o_orderkey % 40 // 2) / (o_orderkey % 40) ELSE 1.0 END AS progress FROM orders")
def embed_progress(spark, d):
    n = F.col("o_orderkey") % 40
    return _t(spark, d, "orders").select("o_orderkey", K.embed_progress(F.floor(n / 2), n).alias("progress"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Cần cập nhật App' ELSE 'App gặp lỗi khi khởi động' END AS title, event_type AS error_type,
CASE WHEN event_id % 3 = 0 THEN 'Dữ liệu trên máy được tạo bởi một phiên bản App mới hơn (schema v' || event_id || '), trong khi bản đang chạy chỉ hỗ trợ tới v7.' || chr(10) || chr(10) || 'Vui lòng cập nhật App lên phiên bản mới nhất rồi mở lại. Dữ liệu của bạn vẫn an toàn — ứng dụng cố ý không hạ cấp để tránh mất dữ liệu.'
ELSE 'Ứng dụng không thể khởi động (loại lỗi: ' || event_type || ').' || chr(10) || chr(10) || 'Vui lòng mở lại ứng dụng. Nếu vẫn lỗi, hãy cập nhật lên phiên bản mới nhất.' END AS detail FROM events"""
)
def startup_errors(spark, d):
    told = K.startup_error("App", F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")), F.lit(7))
    return _t(spark, d, "events").select("event_id", told.alias("e")).select("event_id", "e.title", "e.detail", "e.error_type")

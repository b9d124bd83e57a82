"""The relational catalogue: notebooks, their sources, chunks, vectors and chats as DataFrames.

Every writer takes the present rows and gives the new ones, so that a store (or any table)
can keep them; nothing here reads or writes files.  Columns follow one naming: a source has
id, notebook_id, kind, title, origin, status, error_label, page_count, content_hash,
created_at, updated_at; a chunk id, source_id; a vector id, source_id, notebook_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import BATCH, INTERRUPTED
from marginalia.functions.checks import reindex_phase, rollup_label
from marginalia.operators.chunking import rebuilt


# --- reads ----------------------------------------------------------------


def lookup(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The row of each key, or nulls: ``keys`` has one column named like the key."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ordered(table: DataFrame, group: str, by: Column, key: str = "id") -> DataFrame:
    """Rows with their place (from 1) in their group's order; ties go to the lesser key."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(by, key)))


def chunk_refs(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """What the index is built anew from, without texts: chunk_id, source_id, notebook_id."""
    owner = sources.select(F.col("id").alias("source_id"), "notebook_id")
    return chunks.select(F.col("id").alias("chunk_id"), "source_id").join(owner, "source_id")


def ready(sources: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Sources that can be asked, of a list of ids if one is given."""
    found = sources.where(F.col("status") == "ready")
    return found if wanted is None else found.where(wanted.isNull() | F.array_contains(wanted, F.col("id")))


def completeness(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """notebook_id, n_chunks, n_vectors, incomplete: whether a notebook with chunks lacks vectors."""
    c = chunks.groupBy("notebook_id").agg(F.count("*").alias("n_chunks"))
    v = vectors.groupBy("notebook_id").agg(F.count("*").alias("n_vectors"))
    both = c.join(v, "notebook_id", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0)))
    return both.withColumn("incomplete", (F.col("n_chunks") > 0) & (F.col("n_vectors") < F.col("n_chunks")))


def rollup(sources: DataFrame) -> DataFrame:
    """notebook_id, n, pending, any_ready, label."""
    n = sources.groupBy("notebook_id").agg(F.count("*").alias("n"), F.count_if(~F.col("status").isin("ready", "error")).alias("pending"), F.bool_or(F.col("status") == "ready").alias("any_ready"))
    return n.withColumn("label", rollup_label(F.col("n"), F.col("pending")))


def duplicates(sources: DataFrame) -> DataFrame:
    """Sources with a flag: an earlier one of the notebook has the same content.  They are kept all the same.

    A source without a notebook or a hash is no duplicate.
    """
    known = sources.where("notebook_id is not null and content_hash is not null")
    first = known.groupBy("notebook_id", "content_hash").agg(F.min(F.struct("created_at", "id")).alias("first"))
    later = F.coalesce(F.struct("created_at", "id") > F.col("first"), F.lit(False))
    return sources.join(first, ["notebook_id", "content_hash"], "left").withColumn("duplicate", later).drop("first")


def source_content(wanted: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, found, kind, title, page_count, text, page_breaks of each wanted source (id), put together from its chunks.

    A source that is gone has nulls; one without chunks an empty text.  ``page_breaks`` is
    array<struct<page,offset>> of the pages with a number, by page.
    """
    piece = F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.col("text").alias("t"))
    mine = chunks.join(wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = mine.groupBy("doc_id").agg(rebuilt(F.collect_list(piece)).alias("text"))
    pages = mine.where("page is not null").groupBy("doc_id", "page").agg(F.min("char_start").alias("offset"))
    breaks = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "offset"))).alias("page_breaks"))
    told = texts.join(breaks, "doc_id", "left").withColumnRenamed("doc_id", "id")
    found = lookup(sources.select("id", "kind", "title", "page_count"), wanted).join(told, "id", "left")
    none = F.expr("cast(array() as array<struct<page:int,offset:int>>)")
    return found.select("id", "found", "kind", "title", "page_count", F.when(F.col("found"), F.coalesce("text", F.lit(""))).alias("text"), F.when(F.col("found"), F.coalesce("page_breaks", none)).alias("page_breaks"))


def source_struct() -> Column:
    """A row of sources as users get it, without its origin and hash."""
    names = {"id": "id", "notebookId": "notebook_id", "kind": "kind", "title": "title", "status": "status", "errorLabel": "error_label", "pageCount": "page_count", "createdAt": "created_at", "updatedAt": "updated_at"}
    return F.struct(*(F.col(c).alias(n) for n, c in names.items()))


def chunk_struct() -> Column:
    """A row of chunks as users get it; times and box are there only where the chunk has them.

    An end without a value is the start, other parts of a box are 0.
    """
    times = F.when(F.col("t_start").isNotNull(), F.struct(F.col("t_start").alias("tStart"), F.coalesce("t_end", "t_start").alias("tEnd")))
    part = lambda c: F.coalesce(c, F.lit(0.0)).alias(c[-1])
    box = F.when(F.col("bbox_x").isNotNull(), F.struct(F.col("bbox_x").alias("x"), part("bbox_y"), part("bbox_w"), part("bbox_h")))
    locator = F.struct("page", F.col("char_start").alias("charStart"), F.col("char_end").alias("charEnd"), times["tStart"].alias("tStart"), times["tEnd"].alias("tEnd"), box.alias("bbox"))
    return F.struct("id", F.col("source_id").alias("sourceId"), "ordinal", "text", locator.alias("locator"))


def longest_group(chunks: DataFrame, group: str, source: str) -> DataFrame:
    """group, longest: chunks of the source that has most of its group, so the rounds of a balanced context."""
    return chunks.groupBy(group, source).agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias("longest"))


# --- writes ---------------------------------------------------------------


def add_sources(sources: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New sources (id, notebook_id, kind, title, origin, content_hash) join the others, queued."""
    fresh = new.withColumns({"status": F.lit("queued"), "error_label": F.lit(None).cast("string"), "page_count": F.lit(None).cast("int"), "created_at": now, "updated_at": now})
    return sources.unionByName(fresh, allowMissingColumns=True)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys`` (one column of that name)."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of all rows that share a key with it: doing it twice changes nothing."""
    return without(table, new, key).unionByName(new)


def live_only(new: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose source still exists: what is left to write after a long step."""
    return new.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def updated(table: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """Columns of ``changes`` (key and new values, null included) put into the rows with that key; updated_at moves."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*names).alias("_new"))
    joined = table.join(new, key, "left")
    put = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in names}
    return joined.withColumns(put | {"updated_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at"))}).drop("_new").select(table.columns)


def cascade(tables: dict[str, DataFrame], notebooks: DataFrame) -> dict[str, DataFrame]:
    """All tables without some notebooks (one column, notebook_id) and what hangs on them.

    Vectors, studio results and chats know their notebook, chunks only their source.
    """
    gone = notebooks.select("notebook_id").distinct()
    sources = tables["source"].join(gone, "notebook_id", "left_semi").select(F.col("id").alias("source_id"))
    out = {k: without(tables[k], gone, "notebook_id") for k in ("vector", "studio_result", "chat_message", "source") if k in tables}
    if "chunk" in tables:
        out["chunk"] = without(tables["chunk"], sources, "source_id")
    if "notebook" in tables:
        out["notebook"] = without(tables["notebook"], gone.withColumnRenamed("notebook_id", "id"), "id")
    return out


def upserted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last one's values with the first one's id and created_at."""
    others = [c for c in rows.columns if c not in (*keys, "id", "created_at", order)]
    last = F.max_by(F.struct(*others), order)
    found = rows.groupBy(*keys).agg(F.min_by("id", order).alias("id"), F.min("created_at").alias("created_at"), F.max(order).alias(order), last.alias("last"))
    return found.select(*keys, "id", "created_at", order, *(F.col(f"last.{c}").alias(c) for c in others))


def turns(asked: DataFrame) -> DataFrame:
    """Two chat rows of each (notebook_id, question, answer, mode, asked_at): the answer comes one millisecond later.

    The question's row has no mode; an answer without one was grounded.
    """
    said = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("mode_used"), F.col("asked_at").alias("created_at")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.coalesce("mode", F.lit("grounded")).alias("mode_used"), (F.col("asked_at") + 1).alias("created_at")),
    )
    return asked.select("notebook_id", F.explode(said).alias("r")).select("notebook_id", "r.*")


# --- life of a source, and of the index -----------------------------------


def recovered(sources: DataFrame, now: Column) -> DataFrame:
    """Sources after a restart: those that were under way are in error and can be tried again."""
    cut = F.col("status").isin("queued", "processing")
    return sources.withColumns({"error_label": F.when(cut, INTERRUPTED).otherwise(F.col("error_label")), "updated_at": F.when(cut, now).otherwise(F.col("updated_at")), "status": F.when(cut, "error").otherwise(F.col("status"))})


def retried(sources: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Sources in error that are asked for (id) are queued again; others do not change."""
    again = sources.where(F.col("status") == "error").join(wanted, "id", "left_semi").select("id", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error_label"))
    return updated(sources, again, "id", now)


def reindex_plan(refs: DataFrame, vectors: DataFrame, stored: Column, size: int = BATCH) -> DataFrame:
    """chunk_id, source_id, notebook_id, batch: chunks to embed, ``size`` a batch within their notebook.

    ``stored`` is the version that the index was last built with: nothing is left to do for
    the present one, chunks without a vector if that work was cut off, else all.
    """
    if size <= 0:
        raise ValueError("a batch has one chunk at least")
    phase = reindex_phase(stored)
    has = vectors.select(F.col("id").alias("chunk_id"), F.lit(True).alias("has"))
    todo = refs.join(has, "chunk_id", "left").where((phase == "fresh") | ((phase == "resume") & F.col("has").isNull())).drop("has")
    place = F.row_number().over(Window.partitionBy("notebook_id").orderBy("chunk_id")) - 1
    return todo.withColumn("batch", F.floor(place / size).cast("long"))

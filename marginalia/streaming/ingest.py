"""Ingest: arriving sources become chunks, an index and vectors in a store, step by step, with the state of each source.

Every batch of a stream of sources is one run of the same steps that a retry runs: the
sources are listed as queued, parsed ones are cut into chunks and indexed, chunks are
embedded, and a source is ready when its vectors are stored.  One that fails in a step is in
error with that step's label, and the others go on.  Each step puts rows in place of those
with the same key, so a batch that comes again after a crash changes nothing that is there.
Sources removed meanwhile are known by their tombstones and write nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import checks
from marginalia.functions.plugins import tried_embeddings
from marginalia.functions.text import trimmed
from marginalia.operators import catalog, chunking, intervals
from marginalia.sources import files, scratch
from marginalia.sources.store import Store

SOURCE = "id string, notebook_id string, kind string, title string, origin string, status string, error_label string, page_count int, content_hash string, created_at timestamp, updated_at timestamp, duplicate boolean"
CHUNK = "chunk_id string, doc_id string, notebook_id string, ordinal int, page int, char_start int, char_end int, text string, t_start double, t_end double, box struct<x:double,y:double,w:double,h:double>"
VECTOR = "id string, source_id string, notebook_id string, vector array<double>"
PROGRESS = "source_id string, seq long, step string, status string, progress double, error_label string"
Embed = Callable[[list[str]], list[list[float]]]


class Ingest:
    """Runs over one store.  ``embed`` makes vectors of texts, ``ready`` says whether it can be asked now."""

    def __init__(self, store: Store, embed: Embed, readers: dict[str, files.Reader] | None = None, ready: Callable[[], bool] = lambda: True):
        self.store, self.embed, self.readers, self.ready = store, embed, readers, ready
        for table, schema, key in (("source", SOURCE, "id"), ("chunk", CHUNK, "doc_id"), ("vector", VECTOR, "source_id"), ("progress", PROGRESS, "source_id"), ("removed", "id string", "id")):
            store.create(table, store.spark.createDataFrame([], schema).schema, key)

    # --- what users do ----------------------------------------------------------

    def start(self, arriving: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run for each batch of a stream of sources (id, notebook_id and the columns of ``files.parsed``)."""
        return arriving.writeStream.foreachBatch(lambda rows, batch: self.run(rows, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def retry(self, ids: list[str], now: Column | None = None) -> None:
        """Sources in error are queued again and run; others are refused."""
        s = self.store.spark
        wanted = s.createDataFrame([(i,) for i in ids], "id string")
        rows = wanted.join(self.store.read("source"), "id").collect()  # as many as were asked for
        if len(rows) < len(set(ids)) or any(r.status != "error" for r in rows):
            raise ValueError("only sources in error can be tried again")
        gone = wanted.withColumnRenamed("id", "doc_id")
        self.store.delete_chunks(gone)
        self.store.delete("vector", wanted.withColumnRenamed("id", "source_id"), "source_id")
        known = self.store.read("source").join(wanted, "id").select("id", "notebook_id", "origin")
        read = files.scan(s, sorted({r.origin for r in rows}), self.readers)
        self.run(known.join(read, "origin"), now=now)

    def remove(self, ids: list[str]) -> None:
        """Sources go with their chunks, index and vectors; runs under way will not bring them back."""
        gone = self.store.spark.createDataFrame([(i,) for i in ids], "id string")
        self.store.put("removed", gone, "id")
        self.store.delete("vector", gone.withColumnRenamed("id", "source_id"), "source_id")
        self.store.delete_chunks(gone.withColumnRenamed("id", "doc_id"))
        self.store.delete("source", gone, "id")

    def resume_awaiting(self) -> None:
        """Embed the sources whose chunks wait for a model."""
        if self.ready():
            waiting = scratch.kept(self.store.read("source").where("status = 'awaiting_embedding'").select("id"))
            self._state(waiting.withColumn("status", F.lit("processing")), "embed", 0.5)
            self._embedded(waiting)
            scratch.forget(waiting)

    def resume_interrupted(self) -> None:
        """After a restart: sources that were under way are in error and can be tried again."""
        now = F.current_timestamp()
        cut = scratch.kept(self.store.read("source").where("status in ('queued', 'processing')"))
        self.store.put("source", catalog.recovered(cut, now), "id")
        scratch.forget(cut)

    # --- one run ------------------------------------------------------------------

    def run(self, arrived: DataFrame, batch: int | None = None, now: Column | None = None) -> None:
        """All steps for some sources; ``arrived`` rows may come again.

        Rows without an id, a notebook or an origin are refused and never listed.
        """
        store = self.store
        for column in ("id", "notebook_id", "origin"):
            arrived = arrived.where(trimmed(F.col(column)) != "")
        rows = scratch.kept(arrived.join(store.read("removed"), "id", "left_anti"))  # files are read once
        now = F.current_timestamp() if now is None else now
        self._add(rows, now)
        failed = rows.where("error_label is not null").select("id", F.lit("error").alias("status"), "error_label")
        self._state(failed, "parse", 0.0)
        good = rows.where("error_label is null")
        self._state(good.select("id", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error_label"), "page_count", "title"), "parse", 0.1)
        store.add_chunks(self._chunks(good))
        self._emptied(good)
        self._state(self._live(good).select("id", F.lit("processing").alias("status")), "chunk", 0.4)
        if self.ready():
            self._embedded(good.select("id"))
        else:
            self._state(self._live(good).select("id", F.lit("awaiting_embedding").alias("status")), "embed", 0.5)
        scratch.forget(rows)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.store.read("source").select("id"), "id", "left_semi")

    def _add(self, rows: DataFrame, now: Column) -> None:
        """New sources queued; those that are known keep their place, time and title."""
        new = rows.join(self.store.read("source").select("id"), "id", "left_anti")
        new = new.select("id", "notebook_id", "kind", "title", "origin", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error_label"), "page_count", "content_hash", now.alias("created_at"), now.alias("updated_at"))
        there = self.store.read("source").drop("duplicate").join(new.select("notebook_id", "content_hash"), ["notebook_id", "content_hash"], "left_semi")
        flagged = catalog.duplicates(there.unionByName(new)).join(new.select("id"), "id", "left_semi")
        names = [f.name for f in self.store.read("source").schema]
        self.store.put("source", flagged.select(names), "id")

    def _state(self, changes: DataFrame, step: str, progress: float) -> None:
        """Put states (id, status and other columns) into the sources that are still there, and tell of it."""
        sources = self.store.read("source")
        changes = scratch.kept(self._live(changes))
        mine = sources.join(changes.select("id"), "id", "left_semi")
        if "title" in changes.columns:  # only pages know theirs
            changes_ = changes.join(mine.select("id", "kind", F.col("title").alias("old")), "id").withColumn("title", F.when(F.col("kind") == "url", F.coalesce("title", "old")).otherwise(F.col("old"))).drop("kind", "old")
        else:
            changes_ = changes
        self.store.put("source", catalog.updated(mine, changes_, "id", F.current_timestamp()), "id")
        label = F.col("error_label") if "error_label" in changes.columns else F.lit(None).cast("string")
        told = changes.select(F.col("id").alias("source_id"), (F.unix_micros(F.current_timestamp())).alias("seq"), F.lit(step).alias("step"), "status", F.lit(progress).alias("progress"), label.alias("error_label"))
        self.store.append("progress", told, "source_id")
        scratch.forget(changes)

    def _chunks(self, good: DataFrame) -> DataFrame:
        """Chunks with the times and boxes of what they overlap."""
        owner = good.select(F.col("id").alias("doc_id"), "notebook_id")
        chunks = chunking.chunk_pages(good.select(F.col("id").alias("doc_id"), "pages")).join(owner, "doc_id")
        chunks = scratch.kept(chunks.withColumns({"start": F.col("char_start"), "end": F.col("char_end")}))
        of = lambda c: good.select(F.col("id").alias("doc_id"), F.inline(c)).withColumnsRenamed({"char_start": "start", "char_end": "end"})
        placed = intervals.boxed(intervals.timed(chunks, of("times")), of("boxes"))
        box = F.when(F.col("x").isNotNull(), F.struct("x", "y", "w", "h"))
        return placed.withColumn("box", box).select([f.name for f in self.store.read("chunk").schema])

    def _emptied(self, good: DataFrame) -> None:
        """Sources without any text now (a video without speech) lose chunks of an earlier run."""
        self.store.delete_chunks(good.where(F.size("pages") == 0).select(F.col("id").alias("doc_id")))

    def _embedded(self, ids: DataFrame) -> None:
        """Vectors of all chunks of some sources; one whose embedding fails is in error and gets none."""
        store = self.store
        chunks = store.read("chunk").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        made = scratch.kept(chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("source_id"), "notebook_id", tried_embeddings(F.col("text"), "passage", self.embed).alias("vector")))
        failed = made.where("vector is null").select(F.col("source_id").alias("id")).distinct()
        good = ids.join(failed, "id", "left_anti")
        live = catalog.live_only(made.join(failed.withColumnRenamed("id", "source_id"), "source_id", "left_anti"), store.read("source"))
        store.put("vector", live.select("id", "source_id", "notebook_id", "vector"), "source_id")
        kinds = store.read("source").select("id", "kind")
        self._state(failed.join(kinds, "id").select("id", F.lit("error").alias("status"), checks.error_label(F.lit("embed"), F.col("kind")).alias("error_label")), "embed", 0.0)
        self._state(good.select("id", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error_label")), "done", 1.0)
        scratch.forget(made)

"""A store of catalogue tables in one folder, dealt to buckets by the hash of each table's key.

A table is a folder of Parquet files with one partition for each bucket.  A change reads and
writes the buckets that its keys fall into and no others; Spark's dynamic partition overwrite
puts the new files of a bucket in the place of the old ones when the job has succeeded, so a
job that is cut off while it runs changes nothing, and running it again is safe.  (Buckets
are replaced one after another: should the driver die in just that moment, run the change
again before others.)  Marks are small values kept beside the tables.
"""

from __future__ import annotations

import base64
import json
import urllib.parse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.operators import catalog, chunking, keyword
from marginalia.sources import scratch

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # --- files ---------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def mark(self, name: str, value) -> None:
        """Keep a small value; a later one counts once its file is whole."""
        at = max(self._marks(name), default=0) + 1
        path, fs = self._path(f"{self.folder}/_marks/{name}/new-{at}")
        out = fs.create(path, True)
        out.write(json.dumps(value).encode())
        out.close()
        fs.rename(path, self._path(f"{self.folder}/_marks/{name}/{at}")[0])
        for old in self._marks(name):
            if old < at:
                fs.delete(self._path(f"{self.folder}/_marks/{name}/{old}")[0], False)

    def _marks(self, name: str) -> list[int]:
        path, fs = self._path(f"{self.folder}/_marks/{name}")
        return [int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()] if fs.exists(path) else []

    def marked(self, name: str):
        """The value kept last, or None."""
        at = max(self._marks(name), default=None)
        return None if at is None else json.loads(self.spark.read.text(f"{self.folder}/_marks/{name}/{at}", wholetext=True).first().value)

    # --- tables --------------------------------------------------------------

    def _of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def create(self, table: str, schema: StructType, key: str) -> None:
        """An empty table whose rows are known by ``key``; one that exists stays."""
        if not self.has(table):
            self.mark(f"table-{table}", {"key": key, "buckets": self.buckets, "schema": json.loads(schema.json())})

    def has(self, table: str) -> bool:
        return self.marked(f"table-{table}") is not None

    def _kept(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows with their bucket."""
        told = self.marked(f"table-{table}")
        if told is None:
            raise FileNotFoundError(f"{self.folder}/{table}")
        self.buckets = told["buckets"]
        schema = StructType.fromJson(told["schema"])
        path, fs = self._path(f"{self.folder}/{table}")
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        found = self.spark.read.schema(StructType([*schema.fields]).add("bucket", "integer")).parquet(f"{self.folder}/{table}")
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def read(self, table: str) -> DataFrame:
        return self._kept(table).drop("bucket")

    def key(self, table: str) -> str:
        return self.marked(f"table-{table}")["key"]

    def drop(self, table: str) -> None:
        scratch.delete(self.spark, f"{self.folder}/{table}")
        scratch.delete(self.spark, f"{self.folder}/_marks/table-{table}")

    def _touched(self, keys: DataFrame, key: str) -> list[int]:
        return [r.bucket for r in keys.select(self._of(F.col(key)).alias("bucket")).distinct().collect()]  # ``buckets`` numbers at most

    def _overwrite(self, table: str, rows: DataFrame, buckets: int, **options: int | str) -> None:
        rows.repartition(buckets, "bucket").write.options(**options).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{table}")

    def _replace(self, table: str, rows: DataFrame, buckets: list[int], **options: int | str) -> None:
        """``rows`` (with bucket) as the whole content of some buckets, one file for each.

        Dynamic overwrite leaves a partition alone that gets no rows, so buckets that are
        empty now are deleted.
        """
        if not buckets:
            return
        rows = scratch.kept(rows, **options)
        full = {r.bucket for r in rows.select("bucket").distinct().collect()}
        if full:
            self._overwrite(table, rows, len(full), **options)
        for bucket in set(buckets) - full:
            scratch.delete(self.spark, f"{self.folder}/{table}/bucket={bucket}")
        scratch.forget(rows)

    def put(self, table: str, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` in place of those that share a key with them; the table is made if it is not there.

        The rows are made once and kept until they are written, whatever they cost.
        """
        self.create(table, rows.schema, key)
        rows = scratch.kept(rows)
        buckets = self._touched(rows, key)
        old = self._kept(table, buckets)
        new = rows.withColumn("bucket", self._of(F.col(key)))
        if buckets:
            self._overwrite(table, catalog.replaced(old, new.select(old.columns), key), len(buckets))
        scratch.forget(rows)
        return self.read(table)

    def append(self, table: str, rows: DataFrame, key: str) -> None:
        """New rows, whose keys the table may hold already; nothing is rewritten."""
        self.create(table, rows.schema, key)
        rows.withColumn("bucket", self._of(F.col(key))).select(*self._kept(table).columns).write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/{table}")

    def delete(self, table: str, keys: DataFrame, key: str) -> DataFrame:
        """The table without the rows of some keys (one column named like the key)."""
        keys = scratch.kept(keys.select(key).distinct())
        if key == self.key(table):
            buckets = self._touched(keys, key)
        else:  # rows anywhere may hold it
            buckets = [r.bucket for r in self._kept(table).join(keys, key, "left_semi").select("bucket").distinct().collect()]
        old = self._kept(table, buckets)
        self._replace(table, catalog.without(old, keys, key).select(old.columns), buckets)
        scratch.forget(keys)
        return self.read(table)

    def rebuild(self, table: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The table with other columns: ``change`` makes the new rows of the old ones and keeps the key."""
        key, new = self.key(table), scratch.kept(change(self.read(table)))
        self.drop(table)
        self.append(table, new, key)
        scratch.forget(new)
        return self.read(table)

    def migrate(self, steps: list) -> int:
        """Run the steps (functions of the store) beyond the version kept here; a newer store is refused, never changed."""
        at = self.marked("version") or 0
        if at > len(steps):
            raise ValueError(f"the store has version {at}, this program knows {len(steps)}")
        for k, step in enumerate(steps[at:], at + 1):
            step(self)
            self.mark("version", k)
        return len(steps)

    # --- chunks and their index ------------------------------------------------

    def add_chunks(self, chunks: DataFrame) -> DataFrame:
        """Chunks (chunk_id, doc_id, text, ...) in place of all of their sources, and the index of the buckets that changed.

        With a column ``notebook_id`` the index can be searched notebook by notebook.
        """
        self.create("chunk", chunks.schema, "doc_id")
        rows = scratch.kept(chunks)
        self.put("chunk", rows, "doc_id")
        self.index_buckets(self._touched(rows, "doc_id"))
        scratch.forget(rows)
        return self.read("chunk")

    def delete_chunks(self, sources: DataFrame) -> None:
        """Forget all chunks of some sources (doc_id), in the index too."""
        if self.has("chunk"):
            buckets = self._touched(sources, "doc_id")
            self.delete("chunk", sources, "doc_id")
            self.index_buckets(buckets)

    def index_buckets(self, buckets: list[int] | None = None) -> None:
        """Make the index of some buckets anew from their chunks; of all of them to fill in one that was never made."""
        chunks = self._kept("chunk", buckets)
        scope = F.col("notebook_id").cast("string") if "notebook_id" in chunks.columns else F.lit(None).cast("string")
        units = chunks.select("bucket", scope.alias("scope"), F.col("chunk_id").alias("id"), "text")
        made = keyword.index(units, ("bucket", "scope"))
        self.create("index", StructType([f for f in made.schema if f.name != "bucket"]), "scope")
        self._replace("index", made, list(range(self.buckets)) if buckets is None else buckets, **keyword.WRITTEN)

    def index(self) -> DataFrame:
        """What ``keyword.search`` reads."""
        return self.read("index")

    # --- vectors ----------------------------------------------------------------

    def reindex(self, refs: DataFrame, embed: Callable[[DataFrame], DataFrame], version: str, reindexing: str, batches: int = 1) -> DataFrame:
        """Embed chunks (chunk_id, source_id, notebook_id) with another model, some planned batches of each notebook at a time.

        ``embed`` makes (id, source_id, notebook_id, vector) of planned chunks.  What a step has
        written counts at once.  The version comes last, so a run that was cut off anywhere
        goes on with the chunks that have no vector yet, and a finished one does nothing.
        ``batches`` planned batches of every notebook are one step.
        """
        stored = self.marked("index-version")
        if stored == version:
            return self.read("vector")
        if stored != reindexing:
            self.drop("vector")
            self.mark("index-version", reindexing)
        known = self.read("vector") if self.has("vector") else self.spark.createDataFrame([], "id string")
        plan = scratch.kept(catalog.reindex_plan(refs, known, F.lit(reindexing)))
        last = plan.agg(F.max("batch")).first()[0]
        for at in range(0, 0 if last is None else last + 1, batches):
            self.append("vector", embed(plan.where(F.col("batch").between(at, at + batches - 1))), "source_id")
        scratch.forget(plan)
        self.mark("index-version", version)
        return self.read("vector") if self.has("vector") else known


def export_markdown(answers: DataFrame, folder: str) -> None:
    """One file ``<name>.md`` in ``folder`` for each (name, content); names are safe ones (``export_name``),
    and those that several results share get a number.

    Spark writes the texts; only names pass through the driver, which moves each file to its place.
    """
    spark, top = answers.sparkSession, folder.rstrip("/")
    place = F.row_number().over(Window.partitionBy("name").orderBy("content"))
    name = F.when(place > 1, F.concat("name", F.lit(" ("), place.cast("string"), F.lit(")"))).otherwise(F.col("name"))
    named = answers.select("name", "content").withColumn("name", name).select(F.base64(F.col("name").cast("binary")).alias("of"), F.col("content").alias("value"))
    named = named.withColumn("of", F.translate("of", "/+=", "_-."))  # any name is a folder's name so
    named.repartition("of").write.mode("overwrite").option("lineSep", "\n").partitionBy("of").text(f"{top}/_new")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for one in fs.listStatus(path(f"{top}/_new")):
        key = one.getPath().getName()
        if key.startswith("of="):
            to = base64.b64decode(urllib.parse.unquote(key[3:]).translate(str.maketrans("_-.", "/+="))).decode()
            part = next(f.getPath() for f in fs.listStatus(one.getPath()) if f.getPath().getName().startswith("part-"))
            fs.delete(path(f"{top}/{to}.md"), False)
            fs.rename(part, path(f"{top}/{to}.md"))
    scratch.delete(spark, f"{top}/_new")

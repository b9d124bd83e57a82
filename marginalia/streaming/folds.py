"""State of running streams: latest progress of a source, text of a token stream.

The folds take batch or streaming DataFrames.  ``to_changes`` keeps a stream's updates in a
folder that can be written again for the same batch, so a restarted query repeats no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TERMINAL = ("ready", "error")


def latest_progress(events: DataFrame) -> DataFrame:
    """(source_id, state, progress, seq): the last event of each source; ``running`` drops those at an end."""
    last = F.max_by(F.struct("status", "progress"), "seq")
    return events.groupBy("source_id").agg(last.alias("last"), F.max("seq").alias("seq")).select("source_id", F.col("last.status").alias("status"), F.col("last.progress").alias("progress"), "seq")


def running(latest: DataFrame) -> DataFrame:
    return latest.where(~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)))


def token_fold(deltas: DataFrame) -> DataFrame:
    """(stream_id, text, seq): the deltas before a stream's stop mark in order; one answer's deltas are one state row."""
    d = F.array_sort(F.collect_list(F.struct("seq", "delta", "stop")))
    stop = F.coalesce(F.array_min(F.transform(F.filter("d", lambda x: x["stop"]), lambda x: x["seq"])), F.lit((1 << 63) - 1))
    text = F.array_join(F.transform(F.filter("d", lambda x: x["seq"] < stop), lambda x: x["delta"]), "")
    return deltas.groupBy("stream_id").agg(d.alias("d"), F.max("seq").alias("seq")).select("stream_id", text.alias("text"), "seq")


def lines(chunks: DataFrame) -> DataFrame:
    """(stream_id, n, line): the lines of streams that came in pieces (stream_id, seq, delta), wherever they were cut.

    A last line without its end comes too; an empty one behind the last end does not.
    """
    d = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(d, lambda x: x["delta"]), "").alias("text"))
    cut = whole.select("stream_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"), "text")
    last = (F.col("line") == "") & (F.col("n") == F.size(F.split("text", "\r?\n")) - 1)
    return cut.where(~last).select("stream_id", "n", "line")


def messages(history: DataFrame, streams: DataFrame) -> DataFrame:
    """(conv_id, seq, role, content, streaming) of stored turns and, behind them, the answers under way.

    ``streams`` is (conv_id, text, stopped); a stopped one is final, one without text is not shown.
    """
    last = history.groupBy("conv_id").agg(F.max("seq").alias("last"))
    running = streams.where(F.coalesce("text", F.lit("")) != "").join(last, "conv_id", "left")
    new = running.select("conv_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.lit("assistant").alias("role"), F.col("text").alias("content"), (~F.col("stopped")).alias("streaming"))
    return history.select("conv_id", "seq", "role", "content", F.lit(False).alias("streaming")).unionByName(new)


def serial(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """(queue, id, place) of jobs (queue, id, seq) that still run, first in first out; cancelled ones (id) are left out."""
    left = jobs.join(cancelled.select("id").distinct(), "id", "left_anti")
    return left.select("queue", "id", F.row_number().over(Window.partitionBy("queue").orderBy("seq", "id")).alias("place"))


def to_changes(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start writing each batch's changed rows to its own part of ``folder``."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key."""
    cols = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("last")).select(key, *(f"last.{c}" for c in cols))

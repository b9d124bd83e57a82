"""Running streams that keep state for each key and let it go: progress, lines, serial queues.

Each is a processor of Spark's keyed state: what it holds is bounded by what is under way,
never by what has passed.  Rows of one micro-batch are taken in order of ``seq``; rows that
come again (a seq that was seen) are left out.  The session needs the state store that keeps
such states on disk; ``prepared`` sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from marginalia.streaming.folds import TERMINAL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    prepared(stream.sparkSession)
    return stream.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Update", timeMode="ProcessingTime")


# --- progress -----------------------------------------------------------------


class _Latest(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r.seq)
        if self.last.exists() and self.last.get()[0] >= newest.seq:
            return
        if newest.status in TERMINAL:
            self.last.clear()
        else:
            self.last.update((newest.seq,))
        yield Row(source_id=key[0], status=newest.status, progress=newest.progress, seq=newest.seq)

    def close(self) -> None:
        pass


def latest_progress(events: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """Changes of (source_id string, status, progress double, seq long): the last event of each source as it comes.

    Older events than the last one are left out.  A source at an end (ready or in error)
    comes out once more and its state is deleted; one that falls silent loses its state after
    ``ttl_ms``.
    """
    return _keyed(events, "source_id", _Latest(ttl_ms), "source_id string, status string, progress double, seq long")


# --- lines ----------------------------------------------------------------------


class _Lines(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seq long, n long, tail binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, n, tail = self.open.get() if self.open.exists() else (-1, 0, b"")
        parts, ended = [bytes(tail)], False
        for r in sorted(rows, key=lambda r: r.seq):
            if r.seq <= seq or ended:
                continue
            seq, ended = r.seq, bool(r.done)
            parts.append(bytes(r.delta or b""))
        *lines, rest = b"".join(parts).split(b"\n")
        if ended and rest.strip():
            lines.append(rest)
        for k, line in enumerate(lines):
            yield Row(stream_id=key[0], n=n + k, line=line.removesuffix(b"\r").decode("utf-8", "replace"))
        if ended:
            self.open.clear()
        else:
            self.open.update((seq, n + len(lines), rest))

    def close(self) -> None:
        pass


def lines(chunks: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """(stream_id, n, line): each line of streams of bytes (stream_id string, seq long, delta binary, done boolean) once.

    Bytes may be cut anywhere, within a character or a line end too.  A line comes out when
    its end is there, the last one at the end mark unless it is blank.  Between batches only
    the open tail of a stream is held.
    """
    return _keyed(chunks, "stream_id", _Lines(ttl_ms), "stream_id string, n long, line string")


# --- serial queues ----------------------------------------------------------------

Step = Callable[[str, int], bool]


class _Serial(StatefulProcessor):
    def __init__(self, step: Step, steps: int | None):
        self.step, self.steps = step, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, payload string")
        self.running = handle.getValueState("running", "id string, payload string, k int")
        self.seen = handle.getValueState("seen", "seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        running = tuple(self.running.get()) if self.running.exists() else None
        seen = self.seen.get()[0] if self.seen.exists() else -1
        for r in sorted(rows, key=lambda r: r.seq):
            if r.seq <= seen:
                continue
            seen = r.seq
            if r.action == "add":
                waiting.append((r.id, r.payload))
            elif r.action == "cancel":
                if running is not None and running[0] == r.id:
                    running = None
                    yield Row(queue=key[0], id=r.id, event="cancelled")
                elif any(i == r.id for i, _ in waiting):
                    waiting = [w for w in waiting if w[0] != r.id]
                    yield Row(queue=key[0], id=r.id, event="cancelled")
        self.seen.update((seen,))
        yield from self._work(key, waiting, running, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        yield from self._work(key, waiting, tuple(self.running.get()) if self.running.exists() else None, timerValues)

    def _work(self, key, waiting: list, running: tuple | None, timerValues) -> Iterator[Row]:
        left = self.steps
        while (running or waiting) and left != 0:
            if running is None:
                (i, payload), *waiting = waiting
                running = (i, payload, 0)
                yield Row(queue=key[0], id=i, event="started")
            left = None if left is None else left - 1
            try:
                more = self.step(running[1], running[2])
            except Exception:  # a job's failure is its own
                yield Row(queue=key[0], id=running[0], event="error")
                running = None
                continue
            if more:
                running = (running[0], running[1], running[2] + 1)
            else:
                yield Row(queue=key[0], id=running[0], event="done")
                running = None
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        if running:
            self.running.update(running)
        else:
            self.running.clear()
        if running or waiting:  # goes on in the next batch, whether rows come or not
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def close(self) -> None:
        pass


def serial(jobs: DataFrame, step: Step, steps: int | None = None) -> DataFrame:
    """(queue, id, event) of queues that run one job at a time, first in first out.

    ``jobs`` is (queue string, seq long, action string, id string, payload string); an action
    is ``add`` or ``cancel``.  ``step(payload, k)`` does the k-th step of a job and says
    whether there are more.  A batch does up to ``steps`` steps of each queue (all, if None)
    and the next one goes on, so a cancel reaches a job that waits and, between two of its
    steps, one that runs.  Events are started, done, error (the step raised; the next job
    runs all the same) and cancelled.
    """
    return _keyed(jobs, "queue", _Serial(step, steps), "queue string, id string, event string")

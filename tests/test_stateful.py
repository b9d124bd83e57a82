"""Keyed state over several micro-batches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.streaming import stateful


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a stream over batches of rows, one file and micro-batch each; gives what each batch put out and the state rows left."""

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a run over what is there shall end, timers or not

    class Feed:
        def __init__(self):
            self.out, self.state = [], []

        def run(self, make, schema, batches):
            folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
            for k, rows in enumerate(batches):
                if rows:
                    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
                stream = spark.readStream.schema(schema).parquet(folder)
                got = []
                q = make(stream).writeStream.outputMode("update").foreachBatch(lambda df, _, got=got: got.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
                q.awaitTermination()
                self.state.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) if q.lastProgress else None)
                self.out.append(got)
            return self.out

    yield Feed()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_finished_sources_hold_no_state(spark, feed):
    schema = "source_id string, status string, progress double, seq long"
    many = [(f"s{k}", "processing", 0.1, 2 * k) for k in range(10_000)]
    ends = [(f"s{k}", "error" if k % 3 else "ready", 1.0, 2 * k + 1) for k in range(10_000)]
    more = [("x", "processing", 0.3, 5), ("x", "processing", 0.2, 4), ("y", "ready", 1.0, 1)]
    out = feed.run(stateful.latest_progress, schema, [many, ends, more, [("x", "queued", 0.0, 3), ("z", "queued", 0.0, 1)]])
    assert len(out[0]) == len(out[1]) == 10_000 and {r.status for r in out[1]} == {"ready", "error"}
    assert {(r.source_id, r.progress, r.seq) for r in out[2]} == {("x", 0.3, 5), ("y", 1.0, 1)}
    assert [(r.source_id, r.seq) for r in out[3]] == [("z", 1)]  # what is older than the last is left out
    assert feed.state == [10_000, 0, 1, 2]


def test_every_line_comes_once_wherever_it_is_cut(spark, feed):
    r = random.Random(2)
    texts = {f"t{k}": "\r\n".join(r.choice(["", "é", "日本", "data: x", "  "]) * r.randint(0, 4) for _ in range(30)) + r.choice(["", "\n", "\n  ", "last é"]) for k in range(5)}
    batches, seq = [[] for _ in range(3)], 0
    for name, text in texts.items():
        raw = text.encode()
        cuts = sorted(r.sample(range(len(raw)), min(20, len(raw))))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        for k, part in enumerate(parts):
            batches[k * 3 // len(parts)].append((name, seq := seq + 1, part, k == len(parts) - 1))
    for b in batches:
        r.shuffle(b)
    batches[1] += batches[0][:3]  # rows that come again
    out = feed.run(stateful.lines, "stream_id string, seq long, delta binary, done boolean", batches)
    got = defaultdict(list)
    for rows in out:
        for x in rows:
            got[x.stream_id].append((x.n, x.line))
    for name, text in texts.items():
        *want, rest = text.split("\n")
        want = [x.removesuffix("\r") for x in want] + [rest] * bool(rest.strip())
        assert got[name] == list(enumerate(want))
    assert feed.state[-1] == 0 and all(out)


def test_queues_run_one_job_at_a_time(spark, feed):
    def step(payload, k):
        if payload == "bad":
            raise ValueError(payload)
        return k + 1 < int(payload)

    add = lambda q, s, i, p="1": (q, s, "add", i, p)
    cancel = lambda q, s, i: (q, s, "cancel", i, None)
    batches = [
        [add("a", 3, "a3"), add("a", 1, "a1", "2"), add("a", 2, "a2", "bad"), add("b", 1, "b1", "9"), add("b", 2, "b2"), add("b", 3, "b3")],
        [cancel("b", 4, "b3"), cancel("b", 5, "b1"), cancel("b", 6, "unknown"), add("a", 1, "a1", "2")],
        [add("c", 1, "c1")],
    ]
    out = feed.run(lambda s: stateful.serial(s, step, 3), "queue string, seq long, action string, id string, payload string", batches)
    of = lambda q: [(r.id, r.event) for rows in out for r in rows if r.queue == q]
    assert of("a") == [("a1", "started"), ("a1", "done"), ("a2", "started"), ("a2", "error"), ("a3", "started"), ("a3", "done")]
    assert of("b") == [("b1", "started"), ("b3", "cancelled"), ("b1", "cancelled"), ("b2", "started"), ("b2", "done")]
    assert of("c") == [("c1", "started"), ("c1", "done")]


def test_queues_run_to_the_end_without_a_limit(spark, feed):
    jobs = [("q", k, "add", f"j{k}", str(k % 4 + 1)) for k in range(20)] + [("q", 20, "cancel", "j7", None)]
    out = feed.run(lambda s: stateful.serial(s, lambda p, k: k + 1 < int(p)), "queue string, seq long, action string, id string, payload string", [jobs])
    events = [(r.id, r.event) for r in out[0]]
    assert events[0] == ("j7", "cancelled") and events[1:] == [(f"j{k}", e) for k in range(20) if k != 7 for e in ("started", "done")]

"""Life of sources in a stream of arriving files."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marginalia.operators import keyword
from marginalia.sources import files
from marginalia.sources.store import Store
from marginalia.streaming.ingest import Ingest


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Model:
    def __init__(self, bad="unspeakable"):
        self.bad = bad

    def __call__(self, texts):
        if any(self.bad in t for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]


READERS = {
    "audio": lambda raw: {"pages": [(None, raw.decode())], "times": [(0, 600, 0.0, 30.0), (600, 1200, 30.0, 61.5), (1200, 5000, 61.5, 90.0)]},
    "image": lambda raw: {"pages": [(None, raw.decode())], "boxes": [(0, 4, 0.1, 0.1, 0.2, 0.1), (5, 9, 0.5, 0.3, 0.25, 0.2), (900, 999, 0.0, 0.0, 1.0, 1.0)]},
    "video": lambda raw: {"pages": [] if raw == b"no sound" else [(None, raw.decode())]},
}


@pytest.fixture
def world(spark, tmp_path):
    class World:
        folder = tmp_path / "in"
        store = Store(spark, str(tmp_path / "store"), buckets=2)

        def ingest(self, **more):
            return Ingest(self.store, more.pop("embed", Model()), READERS, **more)

        def put(self, name, content):
            self.folder.mkdir(exist_ok=True)
            (self.folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())

        def go(self, ingest):
            found = files.arriving(spark, str(self.folder), READERS)
            named = found.withColumns({"id": F.col("title"), "notebook_id": F.lit("n1")})
            ingest.start(named, str(tmp_path / "checkpoint")).awaitTermination()

        def states(self):
            return {r.id: (r.status, r.error_label) for r in self.store.read("source").collect()}

        def ids(self, table, column):
            return {r[0] for r in self.store.read(table).select(column).distinct().collect()}

    return World()


def test_arriving_files_become_ready_and_failures_stop_nobody(spark, world):
    world.put("a.txt", "First text " * 200)
    world.put("b.docx", b"broken")
    world.put("c.md", "this is unspeakable")
    world.put("silent.mp4", b"no sound")
    world.put("copy.txt", "First text " * 200)
    run = world.ingest()
    world.go(run)
    assert world.states() == {"a.txt": ("ready", None), "copy.txt": ("ready", None), "b.docx": ("error", "Lỗi trích xuất"), "c.md": ("error", "Lỗi nhúng"), "silent.mp4": ("ready", None)}
    chunks = {r.chunk_id: r for r in world.store.read("chunk").collect()}
    assert {r.id for r in world.store.read("vector").collect()} == {c for c in chunks if not c.startswith("c.md")} and len(chunks) == 7
    assert sum(r.duplicate for r in world.store.read("source").collect()) == 1
    asked = spark.createDataFrame([(1, "first", "n1"), (2, "first", "n2")], "qid int, question string, scope string")
    assert {r.qid for r in keyword.search(world.store.index(), asked, 3).collect()} == {1}
    told = world.store.read("progress").where("source_id = 'a.txt'").orderBy("seq").collect()
    assert [(r.step, r.status, r.progress) for r in told] == [("parse", "processing", 0.1), ("chunk", "processing", 0.4), ("done", "ready", 1.0)]
    # another batch: new files only
    world.put("d.txt", "later")
    world.go(run)
    assert world.states()["d.txt"] == ("ready", None) and world.store.read("chunk").count() == 8
    # a retry reads the file again
    world.put("b.docx", b"still broken")
    world.put("c.md", "this can be said")
    run.retry(["c.md", "b.docx"])
    assert world.states()["c.md"] == ("ready", None) and world.states()["b.docx"][0] == "error"
    for bad in (["a.txt"], ["unknown"]):
        with pytest.raises(ValueError):
            run.retry(bad)
    run.remove(["a.txt"])
    assert "a.txt" not in world.states() and not world.store.read("chunk").where("doc_id = 'a.txt'").count() and "a.txt" not in world.ids("vector", "source_id")


def test_a_batch_that_comes_again_changes_nothing(spark, world):
    world.put("a.txt", "First text " * 200)
    rows = files.scan(spark, str(world.folder), READERS).withColumns({"id": F.lit("a"), "notebook_id": F.lit("n")})
    run = world.ingest()
    run.run(rows)
    before = [sorted(map(str, world.store.read(t).drop("updated_at").collect())) for t in ("source", "chunk", "vector")]
    run.run(rows)
    assert before == [sorted(map(str, world.store.read(t).drop("updated_at").collect())) for t in ("source", "chunk", "vector")]


def test_without_a_model_sources_wait(spark, world):
    world.put("a.txt", "some text")
    world.put("bad.txt", "unspeakable")
    there = []
    run = world.ingest(ready=lambda: bool(there))
    world.go(run)
    assert {s for s, _ in world.states().values()} == {"awaiting_embedding"} and world.store.read("chunk").count() == 2 and not world.store.read("vector").count()
    run.resume_awaiting()
    assert {s for s, _ in world.states().values()} == {"awaiting_embedding"}
    there.append(1)
    run.resume_awaiting()
    assert world.states() == {"a.txt": ("ready", None), "bad.txt": ("error", "Lỗi nhúng")} and world.ids("vector", "source_id") == {"a.txt"}


def test_a_source_removed_meanwhile_writes_nothing(spark, world):
    world.put("a.txt", "some text")
    world.put("b.txt", "other text")

    class Removing(Ingest):
        def _embedded(self, ids):
            self.remove(["a.txt"])
            super()._embedded(ids)

    run = Removing(world.store, Model(), READERS)
    world.go(run)
    assert world.states() == {"b.txt": ("ready", None)} and world.ids("vector", "source_id") == {"b.txt"} and world.ids("chunk", "doc_id") == {"b.txt"}
    rows = files.scan(spark, str(world.folder), READERS).withColumns({"id": F.col("title"), "notebook_id": F.lit("n1")})
    world.ingest().run(rows)  # the batch comes again
    assert set(world.states()) == {"b.txt"}


def test_a_run_that_was_cut_off_can_be_tried_again(spark, world):
    world.put("a.txt", "some text")

    class Dying(Ingest):
        def _chunks(self, good):
            raise RuntimeError("cut off")

    rows = files.scan(spark, str(world.folder), READERS).withColumns({"id": F.col("title"), "notebook_id": F.lit("n1")})
    with pytest.raises(RuntimeError):
        Dying(world.store, Model(), READERS).run(rows)
    assert world.states() == {"a.txt": ("processing", None)}
    run = world.ingest()
    run.resume_interrupted()
    assert world.states() == {"a.txt": ("error", "Gián đoạn khi nạp — thử lại")}
    run.retry(["a.txt"])
    assert world.states() == {"a.txt": ("ready", None)}


def test_chunks_know_their_times_and_boxes(spark, world):
    world.put("talk.mp3", "word " * 500)
    world.put("sign.png", "Exit here")
    world.put("plain.txt", "text")
    world.go(world.ingest())
    got = {r.chunk_id: (r.t_start, r.t_end, r.box) for r in world.store.read("chunk").collect()}
    assert got["talk.mp3-0"] == (0.0, 61.5, None) and got["talk.mp3-1"] == (30.0, 90.0, None) and got["talk.mp3-2"] == (61.5, 90.0, None)
    x, y, w, h = got["sign.png-0"][2]
    assert (x, y) == (0.1, 0.1) and abs(w - 0.65) < 1e-12 and abs(h - 0.4) < 1e-12
    assert got["plain.txt-0"] == (None, None, None)


def test_rows_without_a_notebook_are_refused_and_pages_give_their_title(spark, world):
    world.put("a.txt", "text")
    rows = files.scan(spark, str(world.folder), READERS)
    named = lambda i, book, **more: rows.withColumns({"id": F.lit(i), "notebook_id": F.lit(book).cast("string"), **more})
    page = named("p", "n", kind=F.lit("url"), title=F.lit("https://x.y/z"), origin=F.lit("https://x.y/z"))
    run = world.ingest()
    run.run(named("a", None).unionByName(named("b", "  ")).unionByName(named("c", "n", origin=F.lit(""))).unionByName(page))
    assert world.states() == {"p": ("ready", None)} and world.store.read("source").first().title == "https://x.y/z"
    run.run(page.withColumn("title", F.lit("The page's title")))
    assert world.store.read("source").first().title == "The page's title" and world.states() == {"p": ("ready", None)}

"""Readers, the store, writers and plug-ins on small files and rows."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import answers as A
from marginalia.functions import checks as K
from marginalia.functions import plugins
from marginalia.operators import catalog, chunking, rag, vectors
from marginalia.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes("\ufeffone\r\n\r\n\r\n\r\ntwo  three".encode())
    (d / "b.MARKDOWN").write_text("# head\n\ntext")
    (d / "empty.md").write_text(" \n ")
    (d / "c.xyz").write_text("?")
    (d / "d.png").write_bytes(b"pixels")
    ns = "xmlns:w=\"http://schemas.openxmlformats.org/wordprocessingml/2006/main\""
    with zipfile.ZipFile(d / "e.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>part</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>")
    (d / "broken.docx").write_bytes(b"no archive")
    out = io.BytesIO(b"")
    streams = [b"BT (Page one) Tj (goes on\\)) Tj ET", zlib.compress(b"BT <5477 6F> Tj ET")]
    out.write(b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R 3 0 R] >> endobj\n2 0 obj << /Type /Page /Contents 4 0 R >> endobj\n3 0 obj << /Type /Page /Contents [5 0 R] >> endobj\n")
    for n, (s, kind) in enumerate(zip(streams, (b"", b"/Filter /FlateDecode"), strict=True), 4):
        out.write(b"%d 0 obj << /Length %d %s >>\nstream\n%s\nendstream endobj\n" % (n, len(s), kind, s))
    (d / "f.pdf").write_bytes(out.getvalue())
    return str(tmp_path / "in")


def test_scan_reads_every_kind_and_loses_no_file(spark, folder):
    got = {r.title: r for r in files.scan(spark, folder).collect()}
    pages = lambda n: [(p.page, p.text) for p in got[n].pages]
    assert pages("a.txt") == [(None, "one\n\ntwo three")] and pages("b.MARKDOWN") == [(None, "# head\n\ntext")] and got["b.MARKDOWN"].kind == "md"
    assert pages("e.docx") == [(None, "First\tpart\n\nSecond".replace("\t", " "))]
    assert pages("f.pdf") == [(1, "Page one goes on)"), (2, "Two")] and got["f.pdf"].page_count == 2
    assert all(got[n].error_label == "Lỗi trích xuất" and got[n].pages == [] for n in ("empty.md", "broken.docx", "d.png", "c.xyz"))
    assert got["c.xyz"].kind is None and all(got[n].error_label is None for n in ("a.txt", "e.docx", "f.pdf"))
    shown = {r.title: r for r in files.scan(spark, folder, {"image": lambda raw: [(None, raw.decode())]}).collect()}
    assert shown["d.png"].pages[0].text == "pixels" and shown["d.png"].error_label is None
    size = files.folder_size(spark, folder).first()
    assert size.files == 8 and size.bytes == sum(r["size"] for r in got.values())


def test_markdown_of_pages(spark):
    page = "<html><head><title> A &amp; B </title></head><body><nav>no</nav><article><h2>Head</h2><p>Some <b>bold</b> <a href='/x'>link</a>.</p><ul><li>one<li>two</ul></article></body>"
    rows = spark.createDataFrame([("u1", page), ("u2", "<nav>x</nav>"), ("u3", None)], "url string, html string")
    got = {r.origin: r for r in files.web_sources(rows).collect()}
    assert got["u1"].title == "A & B" and got["u1"].text == "## Head\n\nSome **bold** [link](/x).\n\n- one\n- two"
    assert got["u2"].error_label == "Lỗi tải trang" == got["u3"].error_label and got["u3"].title == "u3"


def test_plugins(spark):
    class Echo:
        id = "echo"

        def chat(self, prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("bad")
            return [p.upper() for p in prompts]

        def embed(self, texts):
            return [[float(len(t)), 0.0] for t in texts]

    r = plugins.Registry()
    with pytest.raises(LookupError):
        _ = r.active
    r.register(Echo())
    other = Echo()
    other.id = "other"
    r.register(other)
    assert r.active.id == "echo" and r.ids() == ["echo", "other"]
    r.set_active("other")
    assert r.active.id == "other"
    with pytest.raises(KeyError):
        r.set_active("none")
    df = spark.createDataFrame([("a",), (None,), ("bad",)], "t string").coalesce(1)
    assert [x.x for x in df.select(plugins.answers(F.col("t"), Echo()).alias("x")).collect()] == ["A", None, None]
    assert [x.x for x in df.select(plugins.embeddings(F.col("t"), "query", Echo().embed).alias("x")).collect()] == [[1.0, 0.0], None, [1.0, 0.0]]


def test_pages_never_share_a_chunk(spark):
    pages = [(1, "a" * 1200), (None, ""), (3, "b" * 10)]
    df = spark.createDataFrame([("s", pages), ("t", None)], "doc_id string, pages array<struct<page:int,text:string>>")
    got = [(r.ordinal, r.page, r.char_start, r.char_end) for r in chunking.chunk_pages(df).orderBy("ordinal").collect()]
    assert got == [(0, 1, 0, 1000), (1, 1, 850, 1200), (2, 3, 1204, 1214)]


def test_exact_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 5))
    v[7] = 0
    v[100:110] = v[3]  # ties go to the lesser id
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = df.where("id % 10 = 3").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    monkeypatch.setattr(vectors, "QUERIES", 4)
    got = {(r.qid, r["rank"]): (r.id, r.distance) for r in vectors.top_k(df, q, 6).collect()}
    for i in range(3, 300, 10):
        norm = np.linalg.norm(v, axis=1) * np.linalg.norm(v[i])
        d = np.round(1 - np.divide(v @ v[i], norm, out=np.zeros(300), where=norm > 0), 8) + 0.0
        want = sorted(zip(d, range(300), strict=True))[:6]
        assert [got[i, k][0] for k in range(6)] == [j for _, j in want]


def test_answers_without_context(spark):
    none = F.expr(A._NONE)
    assert one(spark, A.decided(F.lit("x [1]"), F.lit("open"), none, F.lit(False))).answer == "x "
    assert one(spark, A.decided(F.lit("x"), F.lit("grounded"), none, F.lit(False))).decision == "not-found"
    assert one(spark, A.postprocessed(F.lit("[12345678901] a [1] ,"), none)).answer == " a,"
    assert one(spark, A.citations_of(F.lit(None).cast("string"))) == []
    assert one(spark, A.rewritten(F.lit("q"), F.lit(None).cast("string"))) == "q"
    assert one(spark, K.mode_error(F.lit(None).cast("string"))) and one(spark, K.question_error(F.lit(" a "))) is None
    assert one(spark, K.bytes_label(F.lit(3.0 * 2**50))) == "3 PB"


def test_answers_from_a_notebook(spark):
    """Retrieval within the notebook, packing, the model's answer, its citations; a result from all sources that is made anew."""

    class Model:
        id = "m"

        def chat(self, prompts):
            return ["nothing cited" if "all" in p else "Red things [1] , and [7]." for p in prompts]

        def embed(self, texts):
            return [[float("red" in t), float("blue" in t)] for t in texts]

    m = Model()
    text = {"a-0": ("a", "n1", "red roses grow here"), "b-0": ("b", "n1", "blue sky above"), "c-0": ("c", "n2", "red cars elsewhere")}
    chunks = spark.createDataFrame([(k, d, 0, 3 if d == "a" else None, t, n) for k, (d, n, t) in text.items()], "chunk_id string, doc_id string, ordinal int, page int, text string, notebook_id string")
    known = spark.createDataFrame([(k, v, text[k][1]) for k, v in zip(text, m.embed([x[2] for x in text.values()]), strict=True)], "id string, vector array<double>, notebook_id string")
    asked = spark.createDataFrame([(1, "what is red", "n1", "grounded", False), (2, "zzz", "n3", "grounded", False), (3, "red", "n1", "open", True)], "qid long, question string, notebook_id string, mode string, reindexing boolean")
    titles = spark.createDataFrame([("a", "Roses")], "doc_id string, title string")
    found = rag.retrieve(asked, chunks, known, m.embed)
    assert [(r.qid, r.n, r.id, r.score) for r in found.where("qid = 1").collect()] == [(1, 1, "a-0", 0.0)]
    got = {r.qid: r for r in rag.answer(asked, found, titles, m).collect()}
    assert got[1].decision == "grounded" and got[1].answer == "Red things [1], and." and [(c.n, c.chunk_id, c.title, c.page) for c in got[1].citations] == [(1, "a-0", "Roses", 3)]
    assert got[2].decision == "not-found" and got[3].decision == "reindexing" and got[3].citations == []
    sources = spark.createDataFrame([("a", "Roses", "n1", "ready"), ("b", None, "n1", "ready"), ("c", "C", "n2", "error")], "id string, title string, notebook_id string, status string")
    first = rag.studio(chunks, sources, F.lit("all"), m, F.lit(5).cast("long"))
    again = rag.studio(chunks, sources, F.lit("all"), m, F.lit(9).cast("long"), first).collect()
    assert [(r.notebook_id, r.created_at, r.updated_at, r.content, r.truncated) for r in again] == [("n1", 5, 9, "nothing cited", False)]
    assert one(spark, F.size(A.citations_of(F.lit(again[0].citations_json)))) == 2


def test_missing_hashes_are_no_duplicates(spark):
    rows = [(1, "n", "h", 1), (2, "n", "h", 2), (3, "n", None, 1), (4, "n", None, 2), (5, None, "h", 1), (6, None, None, 1), (7, "m", "h", 1), (8, "n", "h", None)]
    got = catalog.duplicates(spark.createDataFrame(rows, "id long, notebook_id string, content_hash string, created_at long")).collect()
    assert len(got) == len(rows)  # no source is lost
    assert {r.id for r in got if r.duplicate} == {1, 2}  # the one without a time of making is the earliest


def test_null_vectors_are_no_hits_and_scopes_keep_apart(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 1.0], "b"), (4, [1.0, 1.0], None), (5, [2.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, scope string")
    asked = spark.createDataFrame([(10, [1.0, 0.0], "a"), (11, [1.0, 0.0], None), (12, [1.0, 0.0], "c"), (13, None, "a")], "qid long, q array<double>, scope string")
    got = {}
    for r in vectors.top_k(df, asked, 9).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {10: [1], 11: [1, 5, 4, 3]}

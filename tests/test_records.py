"""Scalars, retrieval and streams on literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import records as R
from marginalia.operators import retrieval
from marginalia.streaming import folds


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("header", "want"), [("bytes=7-21", (7, 21)), ("bytes=998-", (998, 999)), ("bytes=-3", (997, 999)), ("bytes=-1001", (0, 999)), ("bytes=400-2000", (400, 999)), ("bytes=-", None), ("bytes=8-7", None), ("bytes=1000-1001", None), ("lines=1-2", None), (None, None)])
def test_byte_range(spark, header, want):
    got = one(spark, R.byte_range(F.col("h"), F.lit(1000)), h=header)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("dialect", "line", "want"), [
    ("ndjson", '{"message":{"content":"a"},"done":false}', "a"), ("ndjson", '{"message":{"content":5}}', None), ("ndjson", "junk", None), ("ndjson", "", None),
    ("choices", 'data: {"choices":[{"delta":{"content":"b"}}]}', "b"), ("choices", "data: [DONE]", None), ("choices", ": ping", None),
    ("blocks", 'data: {"type":"content_block_delta","delta":{"text":"c"}}', "c"), ("blocks", 'data: {"type":"ping","delta":{"text":"c"}}', None),
    ("parts", 'data: {"candidates":[{"content":{"parts":[{"text":"d"},{"x":1},{"text":"e"}]}}]}', "de"), ("parts", "data: {}", None), (None, "x", None),
])
def test_stream_delta(spark, dialect, line, want):
    assert one(spark, R.stream_delta(F.col("l"), F.col("d")), l=line, d=dialect) == want


PUBLIC = ("https://some.host.net/x?y#z", "http://93.184.215.14", "HTTP://name", "http://172.15.9.9/", "http://172.33.0.0", "http://192.169.1.1:81", "http://[2a00:1450::8a]/", "http://[::ffff:93.184.215.14]/", "http://u:p@host.net:8080/", "http://0x.host.net/")
INNER = (
    "http://2130706433/", "http://127.1/", "http://0x7f.1/", "http://0177.0.0.1/", "http://localhost./", "http://a.localhost", "http://172.20.1.1", "http://192.168.0.9", "http://169.254.7.7", "http://0.0.0.0", "http://300.1.1.1/", "http://10.0.0.5:99/q",
    "http://[::]/", "http://[::1]:80/", "http://[fd12::1]/", "http://[fe80::5]/", "http://[::ffff:10.0.0.1]/", "http://[::127.0.0.1]/", "http://[zz]/", "file:///etc/x", "mailto:a@b", "http:///x", "", None,
)


@pytest.mark.parametrize(("url", "want"), [*((u, True) for u in PUBLIC), *((u, False) for u in INNER)])
def test_public_url(spark, url, want):
    assert one(spark, R.public_url(F.col("u")), u=url) is want


def plain_embedding(text):
    h = 2166136261
    data = text.encode("utf-16-be")
    for k in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619 % 2**32
    out = []
    for _ in range(384):
        h ^= h << 13 & 0xFFFFFFFF
        h ^= h >> 17
        h ^= h << 5 & 0xFFFFFFFF
        out.append(h / 0xFFFFFFFF * 2 - 1)
    return np.array(out) / np.linalg.norm(out)


@pytest.mark.parametrize("text", ["", "passage: xin chào", "𝄞 z"])
def test_hash_embedding(spark, text):
    assert np.allclose(one(spark, R.hash_embedding(F.col("t")), t=text), plain_embedding(text))


def test_segments(spark):
    c = R.segments(F.lit(10), F.col("a").cast("int"), F.col("b").cast("int"), F.expr("array(named_struct('offset', 0, 'page', 1L), named_struct('offset', 6, 'page', 2L), named_struct('offset', 11, 'page', 3L))"))
    assert [tuple(x) for x in one(spark, c, a="2", b="6")] == [(0, 2, False, 1), (2, 6, True, None), (6, 10, False, 2)]
    assert [tuple(x) for x in one(spark, c, a="2", b="12")] == [(0, 6, False, 1), (6, 10, False, 2)]


def test_retrieve_puts_units_without_vector_last(spark):
    near = spark.createDataFrame([(1, "a", 0.2, 0), (1, "b", 0.4, 1)], "qid long, id string, distance double, rank int")
    words = spark.createDataFrame([(1, "x", 0), (1, "b", 1)], "qid long, id string, rank int")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, q array<double>")
    got = [(r.id, r.score) for r in retrieval.retrieve(near, words, v, q).orderBy("place").collect()]
    assert got == [("a", 0.2), ("b", 0.4), ("x", 0.5)]
    asks_too = words.unionByName(spark.createDataFrame([(2, "y", 0)], "qid long, id string, rank int"))
    got = {(r.qid, r.id, r.score) for r in retrieval.retrieve(near, asks_too, v, q).collect()}
    assert (2, "y", 0.5) in got and len(got) == 4
    got = [r.id for r in retrieval.retrieve(near, words, None, q, 2).orderBy("place").collect()]
    assert got == ["b", "a"]


def test_stream_of_progress(spark, tmp_path):
    kind = "source_id string, status string, progress double, seq long"
    for k, rows in enumerate(([("s", "processing", 0.1, 1), ("t", "processing", 0.2, 2)], [("s", "processing", 0.9, 3), ("t", "ready", 1.0, 4)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        q = folds.to_changes(folds.latest_progress(stream), f"{tmp_path}/out", f"{tmp_path}/mark")
        q.awaitTermination(120)
        now = folds.current(spark.read.parquet(f"{tmp_path}/out"), "source_id")
        want = [{"s", "t"}, {"s"}][k]
        assert {r.source_id for r in folds.running(now).collect()} == want


def test_stopped_stream_keeps_its_prefix(spark):
    rows = spark.createDataFrame([("a", 2, "y", False), ("a", 1, "x", False), ("a", 3, None, True), ("a", 4, "z", False), ("b", 1, "q", False)], "stream_id string, seq long, delta string, stop boolean")
    assert {r.stream_id: r.text for r in folds.token_fold(rows).collect()} == {"a": "xy", "b": "q"}

"""Answers, results and packing against plain Python."""

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.config import STUDIO_BUDGET
from marginalia.functions import answers as A
from marginalia.operators import catalog, packing, rag
from marginalia.operators.numbering import numbered
from marginalia.plans import notebook_queries as nq
from marginalia.plans import queries as q

SF = "/root/testdata/sf0.001"


def plain_pack(items, budget):
    """(n, used, ids) of (force, id, title, page, text) in order."""
    used, ids = 0, []
    for force, i, title, page, text in items:
        size = len(f"[{len(ids) + 1}] (Nguồn: {title}, trang {'—' if page is None else page})\n{text}") + 2
        if force or not ids or used + size <= budget:
            used += size
            ids.append(i)
    return len(ids), used, ids


def test_packs_of_many_rounds(spark, monkeypatch):
    """Few candidates at a time, long firsts, forced rows beyond the budget, a group of forced rows only."""
    monkeypatch.setattr(packing, "ROUND", 3)
    rng = np.random.default_rng(0)
    rows = [(g, k, bool(k < force), f"{g}-{k}", f"t{k}", None if k % 2 else k, "x" * int(rng.integers(0, 160 if k else first))) for g, (n, force, first) in {"a": (90, 0, 900), "b": (60, 5, 90), "c": (40, 25, 90), "d": (7, 7, 20), "e": (1, 0, 5), "f": (30, 0, 90)}.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, force boolean, id string, title string, page int, text string")
    sized = df.withColumn("size", packing.size_of(F.col("title"), F.col("page"), F.col("text")))
    taken, stats = packing.pack(sized, "g", ["k"], 600)
    got = defaultdict(list)
    for r in taken.orderBy("n").collect():
        got[r.g].append((r.n, r.id))
    for r in stats.collect():
        mine = [x for x in rows if x[0] == r.g]
        n, used, ids = plain_pack([x[2:] for x in mine], 600)
        assert (r.n, r.used, r.truncated) == (n, used, n < len(mine)) and got[r.g] == list(enumerate(ids, 1))
    assert stats.count() == 6


def test_packing_reads_no_text_and_gathers_no_group(spark):
    rows = spark.range(200_000).select(F.lit("n").alias("g"), F.lit(0).alias("k"), F.col("id").alias("doc"), F.lit(True).alias("force"), F.col("id"), F.lit(100).alias("size"))
    taken, stats = packing.pack(rows, "g", ["k", "doc"], STUDIO_BUDGET)
    assert tuple(stats.first())[1] == 200_000 and taken.agg(F.max("n"), F.countDistinct("id")).first() == (200_000, 200_000)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # what rounds gather is written before, ROUND rows of a group at most


def test_places_of_groups_over_many_parts(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = defaultdict(dict)
    for r in numbered(rows, "g", [F.desc("v")]).collect():
        got[r.g][r.place] = r.v
    for g, places in got.items():
        assert [places[k] for k in sorted(places)] == sorted(places.values(), reverse=True) and sorted(places) == list(range(1, len(places) + 1)), g
    assert len(got["hot"]) == 1667 and len(got[None]) == 1666


@pytest.fixture(scope="module")
def notebooks(spark):
    chunks = [r.asDict() for r in q._chunks(spark, SF).collect()]
    owner = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for c in chunks:
        c["book"], c["page"] = owner[c["doc_id"]][0], c["ordinal"] // 3 + 1
        c["title"] = f"{owner[c['doc_id']][1]} {c['doc_id']}" if c["doc_id"] % 5 else "Nguồn"
    return chunks


def test_answers_are_made_of_what_was_retrieved(spark, notebooks):
    by = {c["chunk_id"]: c for c in notebooks}
    found = defaultdict(list)
    for r in nq.rag_retrieve(spark, SF).orderBy("qid", "n").collect():
        found[r.qid].append(r.chunk_id)
        assert by[r.chunk_id]["book"] == f"src{r.qid % 20}" and r.n == len(found[r.qid]) <= 6 and 0 <= r.score <= 0.5
    items = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.qid: r for r in nq.rag_answers(spark, SF).collect()}
    assert set(got) == items and set(found) <= items and len(found) > len(items) / 2
    for i, r in got.items():
        if i % 11 == 0:
            assert r.decision == "reindexing" and r.cited == []
            continue
        _, _, ids = plain_pack([(False, c, by[c]["title"], by[c]["page"], by[c]["text"]) for c in found[i]], 6000)
        if not ids:
            assert r.decision == ("open" if i % 3 == 0 else "not-found")
            continue
        assert r.decision == ("open" if i % 3 == 0 else "grounded") and set(r.cited) <= set(ids) and r.cited


def test_a_model_is_told_the_last_turns(spark):
    class Parrot:
        id = "parrot"

        def chat(self, prompts):
            return prompts

        def embed(self, texts):
            return [[1.0] for _ in texts]

    turns = [("user" if k % 2 == 0 else "assistant", f"turn{k}") for k in range(9)]
    asked = spark.createDataFrame([(1, "now?", "open", False, turns), (2, "first?", "open", False, None)], "qid long, question string, mode string, reindexing boolean, history array<struct<role:string,content:string>>")
    none = spark.createDataFrame([], "qid long, n int, id string, doc_id string, page int, text string, score double")
    got = {r.qid: r.answer for r in rag.answer(asked, none, spark.createDataFrame([], "doc_id string, title string"), Parrot()).collect()}
    assert "turn2" not in got[1] and "user: turn4\n\nassistant: turn5" in got[1] and got[1].endswith("assistant: turn3\n\n" + "".join(f"{r}: {t}\n\n" for r, t in turns[4:]) + "now?") and got[2].endswith("first?")


def test_retrieval_without_a_keyword_index_takes_the_vectors(spark):
    chunks = spark.createDataFrame([("a-0", "a", 0, "red", "n"), ("b-0", "b", 0, "blue", "n")], "chunk_id string, doc_id string, ordinal int, text string, notebook_id string")
    known = spark.createDataFrame([("a-0", [1.0, 0.0], "n"), ("b-0", [0.0, 1.0], "n")], "id string, vector array<double>, notebook_id string")
    asked = spark.createDataFrame([(1, "blue", "n")], "qid int, question string, notebook_id string")

    def missing():
        raise FileNotFoundError("no index")

    got = rag.retrieve(asked, chunks, known, lambda texts: [[1.0, 0.0] for _ in texts], index=missing).collect()
    assert [(r.id, r.score) for r in got] == [("a-0", 0.0)]


def test_results_of_all_sources(spark, notebooks):
    want = {}
    for book in {c["book"] for c in notebooks}:
        mine = sorted((c for c in notebooks if c["book"] == book and c["doc_id"] % 7), key=lambda c: (c["ordinal"], c["doc_id"]))
        if mine:
            n, _, ids = plain_pack([(c["ordinal"] == 0, c["chunk_id"], c["title"], c["page"], c["text"]) for c in mine], STUDIO_BUDGET)
            want[book] = (n, n < len(mine))
    got = {r.notebook_id: (r.n_cited, r.truncated) for r in nq.studio_results(spark, SF).collect()}
    assert got == want


def test_records_and_redaction(spark):
    row = spark.createDataFrame([("c", "s", 0, "t", None, 1, 2, 3.0, None, 0.5, None, None, 0.25), ("d", "s", 1, "t", 4, 1, 2, None, 9.0, None, 1.0, 1.0, 1.0)], "id string, source_id string, ordinal int, text string, page int, char_start int, char_end int, t_start double, t_end double, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    a, b = (r.r.locator for r in row.select(catalog.chunk_struct().alias("r")).orderBy("r.id").collect())
    assert (a.tStart, a.tEnd, tuple(a.bbox)) == (3.0, 3.0, (0.5, 0.0, 0.0, 0.25)) and (b.tStart, b.tEnd, b.bbox, b.page) == (None, None, None, 4)
    nested = spark.createDataFrame([({"a": [{"token": "x", "n": 1}], "text": "t"},), (None,)], "m struct<a:array<struct<token:string,n:int>>,text:string>")
    got = [r.x for r in nested.select(F.to_json(A.redacted_deep(F.col("m"), nested.schema["m"].dataType)).alias("x")).collect()]
    assert got == ['{"a":[{"token":"[REDACTED]","n":1}],"text":"[REDACTED]"}', None]


def test_many_citations_of_many_chunks(spark):
    """thousands of citations are looked up by place; numbers with gaps are still looked up one by one."""
    def checked(answer, numbers):
        context = F.transform(F.array(*map(F.lit, numbers)) if isinstance(numbers, tuple) else F.sequence(F.lit(1), F.lit(numbers)), lambda n: F.struct(n.cast("int").alias("n"), n.cast("string").alias("chunk_id"), n.cast("string").alias("source_id"), F.lit("t").alias("title"), F.lit(None).cast("int").alias("page")))
        rows = spark.range(1).select(F.lit(answer).alias("a"), context.alias("c")).repartition(1)  # as columns, not as literals that are folded
        r = rows.select(A.postprocessed(F.col("a"), F.col("c")).alias("p")).first().p
        return r.answer, [c.n for c in r.citations]

    many = " ".join(f"w [{n}]" for n in range(20_000, 0, -1))
    began = time.monotonic()
    assert checked(many, 20_000) == (many, list(range(1, 20_001)))
    assert time.monotonic() - began < 30
    assert checked("a [3] b [007] c [9] [0] [99999999999] d [1].", 7) == ("a [3] b [007] c d [1].", [1, 3, 7])
    assert checked("a [3] b [4] c [8].", (2, 4, 8)) == ("a b [4] c [8].", [4, 8])

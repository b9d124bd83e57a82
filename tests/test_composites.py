"""Queries that no SQL stands for, against plain Python over the same whole tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.config import CONTEXT_BUDGET, MAX_DISTANCE, STUDIO_BUDGET
from marginalia.plans import queries as q
from marginalia.plans import records
from marginalia.sources.scratch import clear

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def diverse(ids, query, vectors, n):
    left, picked = list(ids), []
    while left and len(picked) < n:
        value = lambda i: round(0.7 * cosine(query, vectors[i]) - 0.3 * max([0.0, *(cosine(vectors[p], vectors[i]) for p in picked)]), 10)
        best = max(left, key=value)  # the first of equals
        left.remove(best)
        picked.append(best)
    return picked


def test_mmr(spark, vectors):
    near = defaultdict(list)
    for r in q._near(spark, SF).orderBy("qid", "rank").collect():
        near[r.qid].append(r.id)
    want = {(i, k, x) for i, ids in near.items() for k, x in enumerate(diverse(ids, vectors[i], vectors, 6))}
    assert {(r.qid, r.place, r.id) for r in q.queries()["mmr"](spark, SF).collect()} == want and len(want) == 6 * len(near)


def test_hybrid_retrieve(spark, vectors):
    near, words = records._asked(spark, SF)
    lists = defaultdict(lambda: ([], []))
    distance = {}
    for r in near.orderBy("qid", "rank").collect():
        lists[r.qid][0].append(r.id)
        distance[r.qid, r.id] = r.distance
    for r in words.orderBy("qid", "rank").collect():
        lists[r.qid][1].append(r.id)
    want = set()
    for i, both in lists.items():
        score, first = defaultdict(float), {}
        for n, ids in enumerate(both):
            for k, x in enumerate(ids):
                score[x] += 1 / (60 + k)
                first.setdefault(x, (n, k))
        fused = sorted(score, key=lambda x: (-round(score[x], 10), first[x]))
        if i in vectors:
            known = [x for x in fused if x in vectors]
            fused = diverse(known, vectors[i], vectors, 6) + [x for x in fused if x not in vectors]
        want |= {(i, k, x, distance.get((i, x), 0.5)) for k, x in enumerate(fused[:6])}
    got = {(r.qid, r.place, r.id, r.score) for r in q.queries()["hybrid_retrieve"](spark, SF).collect()}
    assert got == want and {g[0] for g in got} == set(lists) and MAX_DISTANCE == 0.5


def test_hybrid_retrieve_searches_once(spark):
    """the fused list is read twice, so it is kept; no search is in the plan that reads it."""
    plan = q.queries()["hybrid_retrieve"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    clear(spark)


def packed(chunks, budget):
    """(n, used, ids) of (force, id, title, text) in order."""
    used, ids = 0, []
    for force, i, title, text in chunks:
        size = len(f"[{len(ids) + 1}] (Nguồn: {title}, trang —)\n{text}") + 2
        if force or not ids or used + size <= budget:
            used += size
            ids.append(i)
    return len(ids), used, ",".join(ids)


def test_packs(spark):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_doc, by_book = defaultdict(list), defaultdict(list)
    for r in q._chunks(spark, SF).orderBy("doc_id", "ordinal").collect():
        by_doc[r.doc_id].append((False, r.chunk_id, f"doc-{r.doc_id}", r.text))
        by_book[source[r.doc_id]].append((r.ordinal, r.doc_id, (r.ordinal == 0, r.chunk_id, f"doc-{r.doc_id}", r.text)))
    want = {d: (*p, p[0] < len(c)) for d, c in by_doc.items() for p in [packed(c, CONTEXT_BUDGET)]}
    assert {r.doc_id: (r.n, r.used, r.ids, r.truncated) for r in q.queries()["context_pack"](spark, SF).collect()} == want
    want = {b: (*p, p[0] < len(c)) for b, c in by_book.items() for p in [packed([x for *_, x in sorted(c, key=lambda y: y[:2])], STUDIO_BUDGET)]}
    assert {r.notebook_id: (r.n, r.used, r.ids, r.truncated) for r in q.queries()["balanced_pack"](spark, SF).collect()} == want


def test_hash_embeddings_are_unit_vectors(spark):
    got = q.queries()["hash_embedding"](spark, SF).select(F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 9).alias("norm")).distinct().collect()
    assert [tuple(r) for r in got] == [(384, 1.0)]

"""Operators 11 to 13 against plain Python, on odd tables and on the given ones."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle, segment_topk, whitening
from marginalia.llm import queries as q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- manifest -----------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """Levels of a tree, and a function that gives the siblings of a leaf."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])

    def way(i):
        for level in levels[:-1]:
            at = i // 16 * 16
            yield level[at:i], level[i + 1 : at + 16]
            i //= 16

    return levels[-1][0], way


def plain_manifest(rows):
    by = {}
    for r in rows:
        small = r[1] and "".join(c.lower() if c.isascii() else c for c in r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], small, *r[2:]) if hit else leaf(*r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in sources}
    root, top = climb([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, mine, other) in enumerate(sorted(by[s])):
            way = [*trees[s][1](i), *top(k)]
            node = other
            for left, right in way:
                node = sha(*left, node, *right)
            out.append((doc_id if known else None, mine, trees[s][0], root, sha(*(x for left, right in way for x in left + right)), node, node == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(df).collect()), key=str)


def test_manifest_of_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in q.op11_merkle(spark, SF).collect()), key=str)
    assert got == sorted(plain_manifest(rows), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_deep_and_odd_trees(spark):
    """A source of three rounds' levels, twenty of one row, null and empty ones, null and repeated ids and rows."""
    rows = [(k, f"Text {k} Über" * (k % 3), "en", "hot", k) for k in range(300)] + [(k, "Lone", "de", f"s{k}", None) for k in range(20)]
    rows += [(None, "Null Id", None, None, 3), (None, None, None, None, None), (5, None, "fr", None, 1), (7, "Same", "fr", "", 1), (7, "Same", "fr", "", 1), (7, "Other", "fr", "ä", 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "pos": F.lit("x"), "digest": F.lit(None).cast("string")})
    assert manifest_rows(df) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_one_row_of_none_and_of_long_text(spark):
    assert manifest_rows(spark.createDataFrame([], DOCS)) == []
    one = [(1, "Ab" * 500_000, "en", "s", 1)]
    assert manifest_rows(spark.createDataFrame(one, DOCS)) == plain_manifest(one)


def test_states_before_slots_are_what_folding_goes_on_from():
    children = [sha(str(k)).encode() for k in range(37)]
    digests, states = merkle.parents(children)
    for i in range(37):
        at = i // 16 * 16
        h = states[i].copy()
        h.update(b"".join(children[i : at + 16]))
        assert h.hexdigest().encode() == digests[i // 16]
        assert b"".join(merkle.siblings(children, i)) == b"".join(c for k, c in enumerate(children[at : at + 16]) if k + at != i)
    assert [merkle.levels_above(n) for n in (0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 1, 2, 2, 3]


# --- exact search ---------------------------------------------------------------


def plain_nearest(rows, every=50, k=5):
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a in ints:
        if i is not None and i % every == 0:
            found = sorted(((-min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1), j is None, j or 0) for j, b in ints if j != i))[:k]
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(found)]
    return sorted(out, key=str)


def nearest_rows(df, **more):
    return sorted((tuple(r) for r in segment_topk.nearest(df, **more).select("query_id", "rank", "vec_id", "score").collect()), key=str)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_search_of_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in q.op12_exact_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == plain_nearest(rows) and len(got) == 50


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_search_with_ties_repeats_and_many_slices(spark, d):
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((6, d))
    rows = [(k, (centres[k % 6] + 0.2 * rng.integers(-1, 2, d)).tolist()) for k in range(900)]
    rows += [(k, v) for k, v in rows[:30]] + [(900 + k, rows[10][1]) for k in range(20)]  # repeated rows, equal vectors
    assert nearest_rows(vectors(spark, rows)) == plain_nearest(rows)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (250, []), (300, [3.0]), (None, [9.0, 9.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5, 4.0]), (350, [1e14, 2.0]), (3, [1e14, -1e14]), (0, [0.5, 0.0])]
    df = vectors(spark, rows).withColumns({"id": F.lit(1), "qid": F.lit(2), "v": F.lit(3), "number": F.lit(4)})
    assert nearest_rows(df) == plain_nearest(rows)
    assert nearest_rows(vectors(spark, [])) == [] and nearest_rows(vectors(spark, [(0, [1.0])])) == []


def test_search_takes_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(segment_topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(200)]
    assert nearest_rows(vectors(spark, rows), every=10, k=3) == plain_nearest(rows, 10, 3)


def test_bounds_are_above_products_and_get_closer():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-200, 200, (40, 64)).astype(float), rng.integers(-200, 200, (50, 64)).astype(float)
    last = np.full((40, 50), np.inf)
    assert segment_topk.widths(64) == [64, 16, 4, 2] and segment_topk.widths(1) == []
    for w in segment_topk.widths(64):
        bound = segment_topk.statistics(a, w) @ segment_topk.statistics(b, w).T
        assert (bound >= a @ b.T - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound


def test_pruning_leaves_few_pairs_to_multiply(monkeypatch):
    rng = np.random.default_rng(1)
    v = np.floor(256 * (rng.standard_normal((30, 64))[rng.integers(0, 30, 3000)] + 0.1 * rng.standard_normal((3000, 64)))).astype(np.int64)
    done = []
    plain = segment_topk.exact
    monkeypatch.setattr(segment_topk, "exact", lambda q, v, a, b: done.append(len(a)) or plain(q, v, a, b))
    s = segment_topk.Searcher(np.arange(20), v[:20], 5)
    for at in range(0, 3000, 500):
        s.meet(np.arange(at, at + 500), np.zeros(500, bool), v[at : at + 500])
    assert sum(done) < 0.2 * 20 * 3000


# --- whitening ------------------------------------------------------------------


def plain_whitening(rows, most=16):
    x = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = np.array(sorted({v for _, v in x}), dtype=object)
    n, total = len(fit), fit.sum(0)
    mean = np.array([s / n for s in total])
    centred = fit.astype(float) - mean
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    trace = (centred**2).sum() / n
    return {(i, c + 1): (n, sum((n * a - s) ** 2 for a, s in zip(v, total)), float((np.array(v, float) - mean) @ u[:, c] / np.sqrt(e[c])), e[c] / trace) for i, v in x for c in range(len(e))}


def check_whitening(got, want):
    got = {(r.vec_id, r.component): r for r in got}
    assert got.keys() == want.keys()
    sign = {}
    for key, (n, deviation, w, explained) in sorted(want.items()):
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained) <= 1e-9 and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            sign.setdefault(key[1], np.sign(w) * np.sign(r.whitened))
        assert abs(sign.get(key[1], 1) * r.whitened - w) < 1e-7


def test_whitening_of_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(q.op13_whitening(spark, SF).collect(), plain_whitening(rows))


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.standard_normal(5) * [9, 7, 5, 3, 1]).tolist()) for k in range(60)]
    want = plain_whitening(rows)
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5), (94, [float("-inf")] * 5), (95, [1.0] * 4), (96, [1e300] * 5)]
    again = [(None, rows[3][1]), *rows[:4]]  # equal vectors count once in the fit
    df = vectors(spark, rows + odd + again).withColumns({"x": F.lit(1), "d": F.lit(2), "n": F.lit(3)})
    got = whitening.whitened(df).collect()
    assert len(got) == 65 * 5 and {r.vec_id for r in got} == {*range(60), None}
    check_whitening([r for r in got if r.vec_id is not None], want)


def test_whitening_without_variance(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)]  # one direction only
    got = whitening.whitened(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12 and len(got) == 9


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whitened(vectors(spark, [(0, [0.0]), (1, [2.0**40]), (2, [2.0**40 + 1])])).collect()
    assert {r.vec_id: r.deviation for r in got} == dict.fromkeys(range(3))


@pytest.mark.parametrize("kind", ["full", "flat", "equal", "close", "diagonal", "blocks"])
def test_spectrum_is_that_of_a_dense_solver(kind):
    rng = np.random.default_rng(5)
    b = rng.standard_normal((40, 40))
    basis = np.linalg.qr(b)[0]
    a = {"full": b @ b.T, "flat": b[:, :6] @ b[:, :6].T, "equal": 3 * np.eye(40), "close": basis @ np.diag(np.r_[5 + 1e-9 * np.arange(20), np.arange(20) / 20]) @ basis.T, "diagonal": np.diag(rng.random(40)), "blocks": np.kron(np.eye(4), np.ones((10, 10)))}[kind]
    a = (a + a.T) / 2
    values, u = whitening.spectrum(a)
    scale = np.abs(a).max() * 40
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * scale
    assert np.abs(u.T @ u - np.eye(40)).max() < 1e-13 and np.abs(a @ u - u * values).max() < 1e-13 * scale


def test_polar_factor_is_orthogonal_and_leaves_a_positive_part():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u.T - np.eye(30)).max() < 1e-13 and np.linalg.eigvalsh((u @ a + a @ u) / 2).min() > -1e-12

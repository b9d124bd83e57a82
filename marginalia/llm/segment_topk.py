"""Operator 12: exact top-k by inner product, candidates dropped by segment statistics, coarse to fine.

A vector is cut into segments of one width; a segment of width w has a mean m and a
deviation s.  For two vectors the squared distance is at least the sum over segments of
w ((m - m')^2 + (s - s')^2), so their inner product, which is half of the squared norms less
the squared distance, is at most the sum of w (m m' + s s').  Narrower segments give closer
bounds.  For each query the pairs whose bound is below the k-th score found so far are
dropped, level by level; vectors that no query has left are not looked at on finer levels,
and only what is left in the end is multiplied exactly, as integers.

Queries are a stated set.  They go to the workers in blocks of about ``QUERIES``, so what is
broadcast is bounded and a larger set takes more passes; a task keeps ``k`` rows for each
query and these are all that is shuffled.

Components x of vectors count as floor(256 x).  Vectors that are null or hold a null or a
component that is not finite take no part, on either side.  Rows that share a query's id are
its own and no candidates; equal query rows each get their list.  Shorter vectors count as
if filled up with 0.  A candidate without an id comes last among equals, a query without an
id is none.  Scores beyond a 64-bit integer count as its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import stored, tidy

QUERIES = 2000  # that are sent to the workers together
ROWS = 1000  # vectors that meet them at one time
PAIRS = 50_000  # that are multiplied exactly at one time
SCALE = 256


def quantised(vector: Column) -> Column:
    """Integer components; null for a vector that takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(x, lambda c: F.floor(F.lit(SCALE) * c)))


def widths(d: int) -> list[int]:
    """Segment widths, coarse to fine: all, then a quarter each time, and pairs last."""
    found = []
    while d >= 2:
        found.append(d)
        d //= 4
    return [*found, *[2] * (found[-1:] > [2])]


def statistics(x: np.ndarray, width: int) -> np.ndarray:
    """Mean and deviation of each segment of each row, times the root of its size."""
    edges = np.arange(0, x.shape[1], width)
    sizes = np.diff(np.append(edges, x.shape[1]))
    means = np.add.reduceat(x, edges, axis=1) / sizes
    apart = x - np.repeat(means, sizes, axis=1)
    return np.hstack([means * np.sqrt(sizes), np.sqrt(np.add.reduceat(apart * apart, edges, axis=1))])


def _matrix(lists: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of integers, filled up with 0 to ``d``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(lists), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def _longest(lists: pa.Array | pa.ChunkedArray) -> int:
    return max(1, int(np.asarray(lists.combine_chunks().value_lengths() if isinstance(lists, pa.ChunkedArray) else lists.value_lengths()).max(initial=0)))


def exact(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows, exact; by large integers where 64 bits might not do."""
    most = int(max(np.abs(q.astype(float)).max(initial=0), 1) * max(np.abs(v.astype(float)).max(initial=0), 1) * q.shape[1] * 1.01)
    if most < 1 << 62:
        return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[qi[a : a + PAIRS]], v[vi[a : a + PAIRS]]) for a in range(0, len(qi), PAIRS))])
    whole = (sum(x * y for x, y in zip(q[a].tolist(), v[b].tolist(), strict=True)) for a, b in zip(qi, vi, strict=True))
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


class Best:
    """The ``k`` best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.full(n, -np.inf)  # the k-th score of each query, once there is one

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        q, score, ids, null = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, ~score, q))
        q, score, ids, null = q[order], score[order], ids[order], null[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.q, self.score, self.ids, self.null = q[keep], score[keep], ids[keep], null[keep]
        ends = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.least[q[ends]] = score[ends].astype(float)


class Searcher:
    """A block of queries that meets slices of vectors one after another."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int):
        self.qids, self.q, self.k = qids, q, k
        self.best = Best(len(q), k)
        self.levels = [(w, statistics(q.astype(float), w)) for w in widths(q.shape[1])]
        self.norms = np.sqrt((q.astype(float) ** 2).sum(1))

    def meet(self, ids: np.ndarray, null: np.ndarray, v: np.ndarray) -> None:
        best, x = self.best, v.astype(float)
        slack = 1e-9 * np.outer(self.norms, np.sqrt((x * x).sum(1))) + 0.5  # the bounds are rounded
        alive = (self.qids[:, None] != ids[None, :]) | null[None, :]
        left = np.arange(len(ids))  # vectors that some query still has
        for width, of_queries in self.levels:
            bound = of_queries @ statistics(x[left], width).T + slack[:, left]
            bound[~alive[:, left]] = -np.inf
            self._probe(bound, left, v)
            some = alive[:, left] & (bound >= best.least[:, None])
            alive[:, left] = some
            left = left[some.any(0)]
            if not len(left):
                return
        qi, at = np.nonzero(alive[:, left])
        vi = left[at]
        score = exact(self.q, v, qi, vi)
        high = score >= best.least[qi]
        best.add(qi[high], score[high], ids[vi[high]], null[vi[high]])

    def _probe(self, bound: np.ndarray, left: np.ndarray, v: np.ndarray) -> None:
        """A query without k candidates yet: its k-th score is at least that of the vectors with the highest bounds."""
        new = np.flatnonzero(np.isinf(self.best.least))
        if not len(new) or bound.shape[1] < self.k:
            return
        top = np.argpartition(-bound[new], self.k - 1, axis=1)[:, : self.k]
        usable = np.isfinite(np.take_along_axis(bound[new], top, 1)).all(1)
        new, top = new[usable], top[usable]
        scores = exact(self.q, v, np.repeat(new, self.k), left[top.ravel()]).reshape(-1, self.k)
        self.best.least[new] = scores.min(1).astype(float) if len(new) else self.best.least[new]


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank from 1, id, score: the ``k`` highest of (id, vector) for each (qid, q), all if there are fewer."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), quantised(F.col("vector")).alias("v")).where("v is not null")
    asked = stored(queries.select(F.col("qid").cast("long").alias("qid"), quantised(F.col("q")).alias("q")).where("qid is not null and q is not null").withColumn("number", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERIES))
    passes = []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).toArrow()  # about QUERIES rows
        sent = vectors.sparkSession.sparkContext.broadcast(part)

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part, searcher = sent.value, None
            if not part.num_rows:
                return
            qids = part.column("qid").to_numpy()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    d = max(_longest(part.column("q")), _longest(some.column(1)))
                    if searcher is None or searcher.q.shape[1] < d:
                        grown = Searcher(qids, _matrix(part.column("q"), d), k)
                        grown.best = searcher.best if searcher else grown.best
                        searcher = grown
                    ids = some.column(0)
                    searcher.meet(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), _matrix(some.column(1), searcher.q.shape[1]))
            if searcher is not None:
                b = searcher.best
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("number"))[b.q]), pa.array(qids[b.q]), pa.array(b.ids, mask=b.null), pa.array(b.score)], ["number", "qid", "id", "score"])

        found = rows.mapInArrow(tidy(near), "number long, qid long, id long, score long")
        passes.append(found if blocks == 1 else stored(found))
    all_ = passes[0]
    for more in passes[1:]:
        all_ = all_.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: rows of ``embeddings`` whose vec_id is divisible by ``every`` ask all the others."""
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vectors.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    return search(vectors, queries, k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


_INTS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
NEAREST = f"""
WITH v AS (
  SELECT vec_id, {_INTS} AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

"""Operator 13: whitening by spectral divide and conquer with QDWH polar decompositions.

The covariance of the distinct vectors is summed up in tasks from centred vectors; only its
d x d entries meet.  Its eigenvectors come from polar factors: for a shift s inside the
spectrum the orthogonal polar factor of (covariance - s I) is its matrix sign, half of sign
plus I projects onto the eigenvectors above s, and orthonormal bases of that space and of
its complement split the matrix into two smaller ones, which are treated alike until each
is one component or a multiple of I.  Polar factors are computed by the QR-based, dynamically
weighted Halley iteration, which needs no inverse and about six steps for any condition.
The components are then broadcast (d x ``COMPONENTS`` numbers) and every vector is projected
where it lies.

Entries c count as floor(64 c) + 1000000.  Rows whose vector is null, empty, or holds a null
or a value that is not finite (or beyond 2^46, whose integer no double holds) are left out,
as are vectors of another length than most have (the longer on a tie).  Equal vectors count
once in the fit and each in the result; rows may share an id or have none.  A direction
without variance (below ``FLAT`` of the total) can't be whitened and is no component, so one
distinct vector, or none, gives no rows.  A deviation beyond a 64-bit integer is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import stored, tidy

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
FLAT = 1e-13  # of the trace
SLICE = 2000  # vectors handled at one time
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, not singular, by weighted Halley steps on QR."""
    n = len(a)
    x, low = a / max(np.linalg.norm(a), np.finfo(float).tiny), _EPS / 4  # singular values now lie in [low, 1]
    for _ in range(12):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2)
        s = np.sqrt(1 + root)
        p = s + np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * s)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        whole, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (whole[:n] @ whole[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved, x = np.linalg.norm(new - x), new
        if 1 - low < 10 * _EPS and moved < 1e-8:
            break
    return 1.5 * x - 0.5 * x @ x @ x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant spaces above and below a shift; None for a multiple of I."""
    n, scale = len(a), np.abs(a).max()
    diagonal = np.sort(np.diag(a))
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal[0] + (diagonal[-1] - diagonal[0]) * f for f in (0.37, 0.61, 0.83, 0.19, 0.5))):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= 8 * n * _EPS * scale:
            return None
        sign = polar(moved)
        if np.linalg.norm(sign @ sign - np.eye(n)) > 1e-10:  # the shift is an eigenvalue
            continue
        up = (sign + np.eye(n)) / 2
        k = round(np.trace(up))
        if 0 < k < n:
            basis = up @ np.random.default_rng(n).standard_normal((n, k))
            for _ in range(2):
                basis = up @ np.linalg.qr(basis)[0]
            whole = np.linalg.qr(basis, mode="complete")[0]
            return whole[:, :k], whole[:, k:]
    return None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    total = np.abs(a).max(initial=0)

    def parts(m: np.ndarray, basis: np.ndarray) -> list[np.ndarray]:
        if len(m) == 1 or np.abs(m - np.diag(np.diag(m))).max() <= _EPS * total / 4:
            return [basis]
        found = _split(m)
        if found is None:
            return [basis]
        return [v for part in found for v in parts(part.T @ m @ part, basis @ part)]

    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    vectors = np.hstack(parts(a, np.eye(len(a))))
    for _ in range(2):  # what rounding left between the parts, to first order
        vectors = np.linalg.qr(vectors)[0]
        t = vectors.T @ a @ vectors
        values = np.diag(t)
        gap = values[None, :] - values[:, None]
        clear = np.abs(gap) > np.maximum(1e3 * np.abs(t), 1e3 * _EPS * total)
        vectors = vectors + vectors @ np.where(clear, t / np.where(clear, gap, 1), 0)
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a vector that is left out."""
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 46)))
    return F.when(usable, F.transform(x, lambda c: F.floor(F.lit(SCALE) * c) + F.lit(OFFSET)))


def _slices(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            yield some, np.asarray(some.column(column).flatten()).reshape(-1, d)


def _summed(rows: DataFrame, d: int, entry) -> np.ndarray:
    """Sum over all vectors (one column) of the matrices that ``entry`` makes of a slice: one a task, added up by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for _, x in _slices(batches, 0, d):
            out = entry(x) if out is None else out + entry(x)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["cell", "value"])

    cells = rows.mapInArrow(tidy(run), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # d x d at most
    found = np.zeros(cells.num_rows)
    found[np.asarray(cells.column("cell"))] = np.asarray(cells.column("value"))
    side = int(np.sqrt(len(found)))
    return found.reshape(side, side)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x")).where("x is not null")
    length = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    usable = usable.where(F.size("x") == d)
    fit = stored(usable.select("x").distinct())
    sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()  # d rows
    n, total = sums[0]["n"], [r["s"] for r in sums]
    mean = np.array([s / n for s in total])  # rightly rounded quotients of integers
    covariance = _summed(fit, d, lambda x: (x - mean).T @ (x - mean)) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, vectors = spectrum(covariance)
    keep = min(components, int((values > FLAT * trace).sum())) if trace > 0 else 0
    if not keep:
        return spark.createDataFrame([], schema)
    project = vectors[:, :keep] / np.sqrt(values[:keep])
    explained = values[:keep] / trace
    made = _summed(fit, d, lambda x: ((x - mean) @ project).T @ ((x - mean) @ project)) / n
    error = float(np.abs(made - np.eye(keep)).max())
    sent = spark.sparkContext.broadcast((mean, total, project, explained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, total, project, explained = sent.value
        for some, x in _slices(batches, 1, d):
            w = (x - mean) @ project
            apart = np.abs(x - mean).max(initial=0) * n + 1
            if d * apart**2 < 2**62:
                dev = ((n * x - np.array(total)) ** 2).sum(1)
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x.tolist()]
                dev = [v if v < 1 << 63 else None for v in exact]
            rows = len(x)
            of = pa.array(np.repeat(np.arange(rows), keep))
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(of), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), rows)), pa.array(np.full(rows * keep, n)), pa.array(dev, pa.int64()).take(of), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * keep, error))],
                schema=pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]),
            )

    return usable.mapInArrow(tidy(run), schema)

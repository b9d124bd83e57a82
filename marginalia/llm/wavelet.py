"""Operator 9: token ids in wavelet matrices, one compressed file for each shard.

Documents are dealt to shards by ranges of doc_id (null ids first, equal ids by text) and
written in that order through Spark's own writer, so shards land in whatever store the
folder names.  A shard is one compressed file.  Its matrix is cut into parts of whole
documents, up to about ``BLOCK`` ids (a longer document alone), so that no task ever holds a
shard: a part has a directory of its documents, one bit-plane for each bit of an id, most
significant first, and the rank directory of each plane.  At each plane the ids are split
stably into those with a zero and those with a one bit, which is all that access, rank and
select need.  The number of ids before a part in its shard is a column of the file, and
places count over all shards, so ``access``, ``count_token`` and ``occurrences`` answer from
the files alone.

A null text is an empty one: it has the end id only.  Rows with equal or null doc_ids are
documents of their own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.library_tokens import library
from marginalia.llm.shared import shared_folder

BLOCK = 1 << 18  # ids
STRIDE = 512  # bits between two entries of the rank directory
MAGIC = b"WVM2"


class WaveletMatrix:
    """Ids below ``2 ** bits`` with rank and select; positions count from 0."""

    def __init__(self, n: int, planes: list[np.ndarray], before: list[np.ndarray] | None = None):
        """``before``: ones before each ``STRIDE`` bits of each plane, and all."""
        self.n, self.planes, self.bits = n, planes, len(planes)
        self.before = before or list(map(self._directory, planes))
        self.zeros = [n - int(b[-1]) for b in self.before]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        step = STRIDE // 8
        padded = np.zeros(-(-max(len(plane), 1) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(1, dtype=np.int64)
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(ones)])

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, seq = [], ids
        for k in range(bits - 1, -1, -1):
            one = (seq >> k) & 1 == 1
            planes.append(np.packbits(one, bitorder="little"))
            seq = np.concatenate([seq.take(np.flatnonzero(~one)), seq.take(np.flatnonzero(one))])  # by places: a third of the time that masks take
        return cls(len(ids), planes)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // STRIDE
        at, p = block * STRIDE // 8, self.planes[level]
        n = int(self.before[level][block]) + int(np.bitwise_count(p[at : i >> 3]).sum())
        return n + (bin(int(p[i >> 3]) & ((1 << (i & 7)) - 1)).count("1") if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._ones(k, start), self._ones(k, stop)
            start, stop = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``value`` in [start, stop)."""
        if value < 0 or value >> self.bits or not self.n:
            return 0
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    rank = count

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        ones = self.before[level]
        have = ones if bit else np.arange(len(ones), dtype=np.int64) * STRIDE - ones
        block = int(np.searchsorted(have, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * STRIDE // 8 : (block + 1) * STRIDE // 8], bitorder="little")
        return block * STRIDE + int(np.flatnonzero(part == bit)[k - int(have[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``; IndexError if there are fewer."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - (self.zeros[level] if bit else 0))
        return i

    def occurrences(self, value: int) -> Iterator[int]:
        """Positions of ``value`` in ascending order."""
        return (self.select(value, k) for k in range(self.count(value)))

    def all(self) -> np.ndarray:
        """All ids, from the last plane up."""
        seq = np.zeros(self.n, np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, np.uint32)
            up[~one], up[one] = seq[: self.zeros[k]], seq[self.zeros[k] :] | (1 << (self.bits - 1 - k))
            seq = up
        return seq


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One part: header, directory (null doc_ids marked), bit-planes and their ranks; the body is compressed."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    matrix = WaveletMatrix.build(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    null = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes()
    ranks = [b.astype("<i4").tobytes() for b in matrix.before]
    body = b"".join([np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null, np.array(sizes, "<i8").tobytes(), *(p.tobytes() for p in matrix.planes), *ranks])
    return MAGIC + struct.pack("<IQB", len(doc_ids), len(ids), bits) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(part: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, ids of each document, and the matrix of a part."""
    if part[:4] != MAGIC:
        raise ValueError("no wavelet matrix")
    docs, n, bits = struct.unpack("<IQB", part[4:17])
    body = zstandard.ZstdDecompressor().decompress(part[17:])
    at = docs * 8
    null = np.unpackbits(np.frombuffer(body, np.uint8, -(-docs // 8), at), count=docs, bitorder="little")
    ids = [None if z else d for d, z in zip(np.frombuffer(body, "<i8", docs).tolist(), null, strict=True)]
    at += -(-docs // 8)
    sizes = np.frombuffer(body, "<i8", docs, at)
    at, plane = at + docs * 8, -(-n // 8)
    planes = [np.frombuffer(body, np.uint8, plane, at + k * plane) for k in range(bits)]
    ranks = np.frombuffer(body, "<i4", offset=at + bits * plane).reshape(bits, -1).astype(np.int64)
    return ids, sizes, WaveletMatrix(n, planes, list(ranks))


_SHARD = "shard int, ahead long, n_ids long, data binary"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 0, shards: int | None = None) -> None:
    """Write all texts of ``docs`` (doc_id, text) to ``folder``.

    A null text is an empty one; every document is followed by ``end_id``.  Other columns
    are not read.  An empty table gives a folder without parts.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, ahead = library(path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            data = pack(doc_ids, sizes, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([ahead], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["shard", "ahead", "n_ids", "data"])

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for ids, bounds in enc.encode_all(batch.column(1)):
                for (a, b), d in zip(pairwise(bounds.tolist()), names, strict=False):
                    n = b - a + 1
                    if held and held + n > BLOCK:
                        yield flush()
                        ahead, held = ahead + held, 0
                        doc_ids.clear(), sizes.clear(), parts.clear()
                    doc_ids.append(d)
                    sizes.append(n)
                    parts.extend((ids[a:b], end))
                    held += n
        if held:
            yield flush()

    ordered.mapInArrow(encode, _SHARD).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """(base, n_ids, data) of each part; base: ids of all parts before it.

    What is broadcast has one row for each shard, so as many as the writer had tasks.
    """
    parts = spark.read.schema(_SHARD).parquet(folder)
    per_shard = parts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "shard").select((F.col("before") + F.col("ahead")).alias("base"), "n_ids", "data")


def read_shards(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    ``start`` is the number of ids of all documents before it.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, sizes, matrix = unpack(data.as_py())
                ids = matrix.all()
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(bounds.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + base), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return _parts(spark, folder).select("base", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """n: occurrences of one id in all shards, by rank on the planes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unpack(x.as_py())[2].count(token) for x in batch.column(1)], pa.int64())], ["n"])

    return _parts(spark, folder).select("base", "data").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """place: where one id occurs in the ids of all documents, by select on the planes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([base + k for k in unpack(data.as_py())[2].occurrences(token)], pa.int64())], ["place"])

    return _parts(spark, folder).select("base", "data").mapInArrow(find, "place long")


def access(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """place, id: the ids at ``places`` (one column, place); places that do not exist are left out.

    A place meets its part through the number of the interval of ``BLOCK`` ids that it lies
    in, which a part overlaps once or twice (a longer document: more).  A part then gets its
    distinct places in one list, at most as long as the part.
    """
    parts = _parts(spark, folder)
    cells = F.sequence(F.floor(F.col("base") / BLOCK), F.floor((F.col("base") + F.col("n_ids") - 1) / BLOCK))
    of_part = parts.select("base", "n_ids", F.explode(cells).alias("cell"))
    met = places.select("place", F.floor(F.col("place") / BLOCK).alias("cell")).distinct().join(of_part, "cell").where("place >= base and place < base + n_ids")
    asked = met.groupBy("base").agg(F.collect_list("place").alias("places")).join(parts.select("base", "data"), "base").select("base", "places", "data")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, places_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                matrix = unpack(data.as_py())[2]
                yield pa.RecordBatch.from_arrays([pa.array(places_, pa.int64()), pa.array([matrix.access(p - base) for p in places_], pa.int64())], ["place", "id"])

    return asked.mapInArrow(look, "place long, id long")


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to a folder of the shared directory, read it back: doc_id, start, n_tokens, ids_crc32."""
    folder = os.path.join(shared_folder(docs.sparkSession), "tokens")
    write_shards(docs, folder, path)
    return read_shards(docs.sparkSession, folder, with_ids=False)

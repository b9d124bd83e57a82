"""Joins of two tables of intervals that overlap, of any and uneven lengths.

An interval's level is the least power of 16 that is not below its length.  A pair meets at
the higher of its two levels, in bins of that width, of which either interval touches two at
most.  So an interval goes into two bins, mostly one, for each level that the other side has
from its own one on, however long its partners are: long, short and nested intervals
together make no more rows than that.  Pairs that share two bins are kept in the one where
the overlap starts.  Finer levels would compare fewer pairs, but send each row more often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


STEP = 4  # bits from one level to the next


def _level(size: Column) -> Column:
    """Bits of the bins' width."""
    bits = F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))
    return (F.ceil(bits / STEP) * STEP).cast("int")


def _binned(table: DataFrame, own: str, levels: list[int]) -> DataFrame:
    """Each row once for each bin: _level, _bin, and whether the level is the interval's own."""
    level = _level(F.col("end") - F.col("start"))
    wanted = F.array_union(F.array(level), F.filter(F.array(*map(F.lit, levels)), lambda k: k > level))
    rows = table.where("start <= end").withColumn("_level", F.explode(wanted)).withColumn(own, F.col("_level") == level)
    last = F.greatest(F.col("end") - 1, F.col("start"))
    bins = F.sequence(F.expr("shiftright(start, _level)"), F.call_function("shiftright", last, F.col("_level")))
    return rows.withColumn("_bin", F.explode(bins))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` (key, start, end, ...) with ``other``, a struct of each row of ``right`` that it overlaps.

    Intervals are half open, from ``start`` up to ``end`` (integers), and overlap if each
    starts before the other ends; an empty one overlaps what it lies within.  Rows with a
    null key or bound, or that end before they start, overlap nothing.
    """
    levels = [[r[0] for r in t.where("start <= end").select(_level(F.col("end") - F.col("start"))).distinct().collect()] for t in (left, right)]  # 64 numbers at most
    a = _binned(left.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")}), "_a", levels[1])
    b = _binned(right.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")}), "_b", levels[0])
    other = b.select(key, "_level", "_bin", "_b", F.struct(*(c for c in right.columns if c != key)).alias("other"))
    met = a.join(other, [key, "_level", "_bin"]).where(F.col("_a") | F.col("_b"))
    real = met.where((F.col("start") < F.col("other.end")) & (F.col("other.start") < F.col("end")))
    first = F.call_function("shiftright", F.greatest("start", F.col("other.start").cast("long")), F.col("_level"))
    return real.where(F.col("_bin") == first).select(*left.columns, "other")


def spanned(left: DataFrame, right: DataFrame, key: str, id_: str, **found: Column) -> DataFrame:
    """``left`` with what is aggregated over all that it overlaps; null where there is nothing.

    ``found`` are aggregates of fields of ``other``; ``id_`` tells the rows of ``left`` apart.
    """
    sums = overlapping(left.select(id_, key, "start", "end"), right, key).groupBy(id_).agg(*(c.alias(n) for n, c in found.items()))
    return left.join(sums, id_, "left")


def timed(chunks: DataFrame, segments: DataFrame, key: str = "doc_id", id_: str = "chunk_id") -> DataFrame:
    """Chunks (start, end in characters) with t_start and t_end of the segments (start, end, t_start, t_end) they overlap."""
    return spanned(chunks, segments, key, id_, t_start=F.min("other.t_start"), t_end=F.max("other.t_end"))


def boxed(chunks: DataFrame, boxes: DataFrame, key: str = "doc_id", id_: str = "chunk_id") -> DataFrame:
    """Chunks with x, y, w, h of the box around all boxes (start, end, x, y, w, h) they overlap."""
    x, y = F.min("other.x"), F.min("other.y")
    right, bottom = F.max(F.col("other.x") + F.col("other.w")), F.max(F.col("other.y") + F.col("other.h"))
    return spanned(chunks, boxes, key, id_, x=x, y=y, w=right - x, h=bottom - y)

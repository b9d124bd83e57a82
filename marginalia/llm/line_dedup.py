"""Operator 7: lines that repeat an earlier line, exactly or but for one word, are removed.

A line is its words, so white space does not count.  Lines of ``least`` words or more are
compared: an occurrence is removed if an earlier occurrence (by row, then place) has the
same words.  Of lines of ``fuzzy`` words or more, one is also removed if an earlier line can
be made from it by one word changed, added or dropped, whether that line stays or not.

The second part is a join of deletion neighbourhoods in two steps.  A line emits a key for
itself without each of its quarters.  An edited word lies in one quarter of the shorter
line, so two lines one edit apart share such a key; as the longer of two lines cannot know,
each line emits its keys for its own length and for that of a line one word shorter.  Only
for keys that different lines share the second step follows, in the quarter alone: a key for
each word replaced by a gap, for each word dropped (of the longer line), and for the whole
(of the shorter).  Groups of equal keys need their earliest line only, never pairs, so a key
that many lines share is summed up before it is shuffled.  The pair of a line and its
earliest match is then verified by the edit distance of the words themselves.

Null and empty texts have no lines to compare and stay as they are; an empty table stays
empty.  A row is known by its doc_id and the hash of its text, and rows come in that order:
rows that share a doc_id, or have none, are still rows of their own.  Rows equal in both have
their lines at equal places and do not remove each other's.  Null doc_ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import KeyFilter, forget, stored, tidy
from marginalia.llm.units import slices
from marginalia.llm.words import P, P_INV, Recent, Words, mix, powers

LEAST = 5
FUZZY = 10
PARTS = 4  # a line's quarters


class Lines:
    """Lines of ``least`` words or more of some texts, with the hashes of any of their word ranges."""

    def __init__(self, texts: list[str | None], least: int = LEAST):
        found = Words(texts)
        breaks = np.flatnonzero(found.raw == 0x0A)
        at = np.searchsorted(breaks, found.start)  # line of each word, over all texts
        first = np.flatnonzero(np.diff(at, prepend=-1))
        size = np.diff(np.append(first, len(at)))
        kept = size >= least
        first, self.size = first[kept], size[kept]
        self.doc, line = found.text[first], at[first]
        begin = np.concatenate([np.zeros(1, np.int64), found.text_end[:-1]]) if len(texts) else np.zeros(1, np.int64)
        self.place = line - np.searchsorted(breaks, begin)[self.doc]
        self.low, self.high = np.concatenate([np.zeros(1, np.int64), breaks + 1])[line], breaks[line]  # bytes of the line
        self.joined = found.joined
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.words = found.hash[np.repeat(first - self.start, self.size) + np.arange(int(self.size.sum()))]
        self.up, self.down = powers(P, len(self.words) + 1), powers(P_INV, len(self.words) + 1)
        self.sums = self._running(self.words)
        other = self._running(mix(self.words, 1))
        self.line = mix(self.range(self.start, self.end), self.size)
        self.line2 = mix((other[self.end] - other[self.start]) * self.down[self.start], self.size)

    def _running(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=out[1:])
        return out

    def range(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hash of words s to e (counted over all lines)."""
        return (self.sums[e] - self.sums[s]) * self.down[s]

    def coarse(self, some: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, whether the line is a shorter one, first and last word of the gap) of each quarter of the lines ``some``."""
        k = np.concatenate([some, some[self.size[some] > least]])
        m = self.size[k] - (np.arange(len(k)) >= len(some))  # words of the shorter line
        k, m, j = np.repeat(k, PARTS), np.repeat(m, PARTS), np.tile(np.arange(PARTS), len(k))
        low, high = self.start[k] + j * m // PARTS, self.end[k] - m + (j + 1) * m // PARTS
        key = mix(self.range(self.start[k], low), m * PARTS + j) + mix(self.range(high, self.end[k]), 2)
        return k, mix(key, 3), m == self.size[k], low, high


def fine(words: np.ndarray, size: np.ndarray, key: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, kind) of gaps that lie one after the other: 0 a word replaced (shorter line), 1 the whole (shorter), 2 a word dropped (longer)."""
    end = np.cumsum(size)
    start = end - size
    up, down = powers(P, len(words) + 1), powers(P_INV, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    row, i = np.repeat(np.arange(len(size)), size), np.arange(len(words))
    full = (sums[end] - sums[start]) * down[start]
    word = (sums[i + 1] - sums[i]) * down[start[row]]
    gap = mix(mix(full[row] - word, i - start[row] + 1_000_003), 5)
    dropped = mix((sums[i] - sums[start[row]]) * down[start[row]] + (sums[end[row]] - sums[i + 1]) * down[start[row] + 1], size[row] - 1)
    whole = mix(full, size)
    of = short[row]
    rows = np.concatenate([row, np.flatnonzero(short)])
    variant = np.concatenate([np.where(of, gap, dropped), whole[short]])
    return rows, mix(key[rows] + variant, 4), np.concatenate([np.where(of, 0, 2), np.ones(int(short.sum()), np.int64)])


def within_one(a: list, b: list) -> bool:
    """Whether one word changed, added or dropped makes one sequence the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :] or a == b


def _lines(batch: pa.RecordBatch, column: int, least: int) -> Iterator[tuple[int, Lines]]:
    at = 0
    for part in slices(batch.column(column)):
        yield at, Lines(part, least)
        at += len(part)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _occurrences(rows: DataFrame, least: int, fuzzy: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _lines(batch, 1, least):
                mine = pa.array(x.doc + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(mine), batch.column(2).take(mine), pa.array(x.place.astype(np.int32)), pa.array(x.size >= fuzzy), _signed(x.line), _signed(x.line2)], ["doc_id", "row", "place", "long", "line", "line2"])

    return rows.mapInArrow(tidy(run), "doc_id long, row long, place int, long boolean, line long, line2 long")


def _coarse(rows: DataFrame, fuzzy: int, wanted: KeyFilter | None = None) -> DataFrame:
    """(key, line, short) of the quarters of all long lines; with ``wanted`` only of keys that pass, and with the gap's words.

    A task emits a line it had lately once only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, x in _lines(batch, 0, fuzzy):
                k, key, short, low, high = x.coarse(np.flatnonzero(recent.new(x.line)), fuzzy)
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([_signed(key), _signed(x.line[k]), pa.array(short)], ["key", "line", "short"])
                    continue
                on = np.flatnonzero(wanted.passes(key.view(np.int64)))
                size = high[on] - low[on]
                ends = np.cumsum(size)
                words = x.words[np.repeat(low[on] - ends + size, size) + np.arange(int(size.sum()))]
                gaps = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), ends]).astype(np.int32)), _signed(words))
                yield pa.RecordBatch.from_arrays([_signed(key[on]), _signed(x.line[k[on]]), pa.array(short[on]), gaps], ["key", "line", "short", "gap"])

    return rows.select("text").mapInArrow(tidy(run), "key long, line long, short boolean" + ", gap array<long>" * (wanted is not None))


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            gap = part.column(3)
            bounds = np.asarray(gap.offsets).astype(np.int64)
            words = np.asarray(gap.values)[bounds[0] : bounds[-1]].view(np.uint64)
            rows, key, kind = fine(words, np.diff(bounds), np.asarray(part.column(0)).view(np.uint64), part.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(kind.astype(np.int8)), part.column(1).take(pa.array(rows))], ["key", "kind", "line"])


def _near_lines(rows: DataFrame, first: DataFrame, fuzzy: int) -> DataFrame:
    """(line, at) of long lines with an earlier line one edit away; ``first`` has each line's first place."""
    keys = _coarse(rows, fuzzy).groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("short").alias("short"))
    shared = stored(keys.where("low <> high and short").select("key"))
    found = _coarse(rows, fuzzy, KeyFilter(shared)).join(shared, "key", "left_semi")
    keyed = stored(found.select("key", "line", "short", "gap").mapInArrow(tidy(_fine), "key long, kind byte, line long"))
    # keys of one line alone say nothing: most go before anything is joined
    some = keyed.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("key")
    placed = stored(keyed.join(some, "key").distinct().join(first.select("line", "at"), "line"))
    least = placed.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, F.struct("at", "line"))).alias(f"least{k}") for k in range(3)))
    other = F.when(F.col("kind") == 0, F.col("least0")).when(F.col("kind") == 1, F.col("least2")).otherwise(F.col("least1"))
    matched = placed.join(least, "key").withColumn("other", other).where("other.at < at")
    pairs = stored(matched.groupBy("line", "at").agg(F.min("other").alias("other")).select("line", "at", F.col("other.line").alias("earlier")))
    forget(shared, keyed, placed)
    return _verified(rows, pairs, fuzzy)


def _verified(rows: DataFrame, pairs: DataFrame, fuzzy: int) -> DataFrame:
    """Pairs of lines whose words are one edit apart."""
    wanted = KeyFilter(pairs.select(F.explode(F.array("line", "earlier")).alias("key")).distinct())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, x in _lines(batch, 0, fuzzy):
                hit = np.flatnonzero(wanted.passes(x.line.view(np.int64)))
                hit = hit[recent.new(x.line[hit])]
                found = [x.joined[a:b] for a, b in zip(x.low[hit].tolist(), x.high[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_signed(x.line[hit]), pa.array(found, pa.binary())], ["line", "words"])

    known = rows.select("text").mapInArrow(tidy(texts), "line long, words binary").groupBy("line").agg(F.min("words").alias("words"))

    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([within_one(x.split(), y.split()) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    left = pairs.join(known.withColumnRenamed("words", "mine"), "line")
    both = left.join(known.select(F.col("line").alias("earlier"), F.col("words").alias("theirs")), "earlier")
    return both.where(close("mine", "theirs")).select("line", "at")


def _keep_lines(text: Column, gone: Column) -> Column:
    """Text without the lines at the given places."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 200):
            part = []
            for t, p in zip(texts.slice(at, 200).to_pylist(), places.slice(at, 200).to_pylist(), strict=True):
                if t is not None and p:
                    bad = set(p)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in bad)
                part.append(t)
            out.append(pa.array(part, pa.string()))
        return pa.concat_arrays(out) if out else texts

    return kept(text, gone)


def dedup(docs: DataFrame, least: int = LEAST, fuzzy: int = FUZZY) -> DataFrame:
    """``docs`` with text less its repeated lines, and n_lines, n_removed; other columns are kept."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    at = F.struct("doc_id", "row", "place")
    seen = stored(_occurrences(rows, least, fuzzy))
    first = seen.groupBy("line", "line2").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.first("long").alias("long"))
    first = stored(first)
    repeated = seen.join(first.where("n > 1").select("line", "line2", "at"), ["line", "line2"]).where(at != F.col("at"))
    near = _near_lines(rows, first.where("long").groupBy("line").agg(F.min("at").alias("at")), max(least, fuzzy))
    gone = repeated.select("doc_id", "row", "place").unionByName(near.select("at.doc_id", "at.row", "at.place"))
    by_row = gone.groupBy(F.col("doc_id").alias("gone_doc"), F.col("row").alias("gone_row")).agg(F.collect_set("place").alias("gone"))
    mine = F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.xxhash64("text") == F.col("gone_row"))
    joined = docs.drop("n_lines", "n_removed", "gone", "gone_doc", "gone_row").join(by_row, mine, "left")
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(F.split("text", "\n"))).otherwise(0)
    counted = joined.withColumn("n_lines", n_lines).withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)))
    counted = counted.withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    return counted.withColumn("text", _keep_lines(F.col("text"), F.col("gone"))).drop("gone", "gone_doc", "gone_row")

"""Operator 6: a probabilistic suffix tree over words scores texts; its root is a smoothed unigram.

A text is its words (ASCII-lower-cased) and one end; its probability is the product of its
tokens', each given the longest retained suffix of the words before it in the text.

* The root gives (c + 0.1) / (N + 0.1 * (V + 1)): the base score.
* A context of up to ``DEPTH`` words is a state with the tokens n that follow it at least
  ``LEAST`` times as its transitions.  The minimum is a count, not a share: what the tree
  knows grows with the input, and a passage that is known on a small table is known on a large one.
* A state is retained if it diverges from its parent, the context one word shorter: the log
  likelihood ratio of what follows it must exceed ``PER_SYMBOL`` for each transition.
* A stored transition has n / (total + stored); the mass that is left is shared by all other
  tokens as the parent has it, so every state is a distribution over the same tokens.

Words, transitions and states are distributed tables; words and n-grams are known by 64-bit
hashes.  An n-gram that occurs ``LEAST`` times has parts that do, so level by level a pass over
the texts tallies the n-grams whose parts pass a filter of bounded size (``KeyFilter``): each
task sends 48 bits and a small count of each, which is all that the next filter needs.  Only
n-grams that pass are then counted with their contexts, exactly; they too are sent as sorted
runs of bytes.  Filters let others through
as they fill up; that costs work, no result.  Documents are dealt to blocks of about ``BLOCK``
tokens; a block asks for its distinct words and n-grams, the tables answer, and the answers
meet the block's documents again.  Questions and answers are dealt by the leading bits of the
hashes (shards) and sent as sorted runs of bytes, one row for each block and shard.  Blocks and
shards grow in number, not in size.

Null texts count as empty: one token, the end.  Rows without doc_id are held out.  Rows that
share a doc_id are scored each for itself; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import KeyFilter, forget, forget_shuffles, stored, tidy
from marginalia.llm.units import slices
from marginalia.llm.words import P, Words

DEPTH = 3  # words of the longest context
LEAST = 3
PER_SYMBOL = 2.0
BLOCK = 7_000_000  # training tokens of a block of documents that are scored together
HELD = 500_000  # n-grams that a task gathers before it sums them up
SENT = 3_000_000  # summed n-grams that it sends at one time
END = b"\x00 "  # no word: words have no space
_END = np.uint64(0x5851F42D4C957F2D)  # its hash


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; the end is not among them."""
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits


def _train_flag(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 != 0, F.lit(False))


def _grams(texts: list[str | None], depth: int = DEPTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1- to (depth + 1)-grams that start at each token of some texts, and how many tokens the text has from there on.

    Hashes that reach beyond their text's end mean nothing.
    """
    found = Words(texts, lower=True)
    w = np.insert(found.hash, found.bounds[1:], _END)
    sizes = np.diff(found.bounds) + 1
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w))
    out, h = [], np.zeros(len(w), np.uint64)
    for k in range(depth + 1):
        h = (h ^ np.concatenate([w[k:], np.zeros(min(k, len(w)), np.uint64)])) * P
        h ^= h >> np.uint64(29)
        out.append(h.view(np.int64))
    return out, left


class Tally:
    """Counts of keys with what belongs to each; ``HELD`` rows are summed up to a run, runs only when asked for.

    ``size`` is the number of rows that the runs have.
    """

    def __init__(self, width: int):
        self.width, self.rows, self.n, self.waiting = width, [], [], 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, n: np.ndarray | None = None) -> None:
        self.rows.append(rows)
        self.n.append(n)
        self.waiting += rows.shape[1]
        if self.waiting > HELD:
            self._run()

    def _run(self) -> None:
        if self.waiting:
            plain = self.width == 1 and all(n is None for n in self.n)
            rows = np.concatenate(self.rows, 1)
            if plain:
                key = np.sort(rows[0])
                first = _firsts(key)
                self.runs.append((key[first][None], np.diff(np.append(first, len(key)))))
            else:
                self.runs.append(self._summed(rows, np.concatenate([np.ones(r.shape[1], np.int64) if n is None else n for r, n in zip(self.rows, self.n, strict=True)])))
            self.size += len(self.runs[-1][1])
        self.rows, self.n, self.waiting = [], [], 0

    @staticmethod
    def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows[0])
        first = _firsts(rows[0][order])
        return rows[:, order[first]], np.add.reduceat(n[order], first) if len(first) else n

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows in ascending order of their keys, and the count of each; the tally is empty afterwards."""
        self._run()
        runs, self.runs, self.size = self.runs, [], 0
        if len(runs) == 1:
            return runs[0]
        return self._summed(np.concatenate([np.zeros((self.width, 0), np.int64), *(r for r, _ in runs)], 1), np.concatenate([np.zeros(0, np.int64), *(n for _, n in runs)]))


class Distinct:
    """Distinct keys.  What came in is sorted in when it is as much as is held, ``HELD`` at least, so that no key is sorted again for every text."""

    def __init__(self) -> None:
        self.keys, self.new, self.waiting, self.sorted = np.zeros(0, np.int64), [], 0, 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.waiting += len(keys)
        if self.waiting > max(HELD, len(self.keys)):
            self.all()

    def all(self) -> np.ndarray:
        """In ascending order.  ``sorted`` counts the keys that were sorted so far."""
        if self.new:
            self.sorted += len(self.keys) + self.waiting
            every = np.concatenate([self.keys, *self.new])
            every.sort()
            self.keys, self.new, self.waiting = every[_firsts(every)], [], 0
        return self.keys


def _firsts(ascending: np.ndarray) -> np.ndarray:
    """Where each distinct value starts."""
    return np.flatnonzero(np.concatenate([np.ones(1, bool), ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    at = 0
    for part in slices(batch.column(column)):
        yield at, part
        at += len(part)


def _in_parts(rows: int, *columns: np.ndarray) -> Iterator[list[pa.Array]]:
    for at in range(0, len(columns[0]), rows):
        yield [pa.array(c[at : at + rows]) for c in columns]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): training count of every word of the task's texts."""
    tally = Tally(1)

    def rows() -> Iterator[pa.RecordBatch]:
        (keys,), n = tally.sum()
        for cols in _in_parts(100_000, keys, n):
            yield pa.RecordBatch.from_arrays(cols, ["gram", "n"])

    for batch in batches:
        for _, part in _texts(batch, 0):
            tally.add(_grams(part, 0)[0][0][None])
            if tally.size > SENT:
                yield from rows()
    yield from rows()


_SENT = "part int, low binary, high binary, n binary"


def _short(gram: np.ndarray) -> np.ndarray:
    """The 48 bits of an n-gram's hash that a tally knows it by."""
    return (gram.view(np.uint64) >> np.uint64(16)).view(np.int64)


def _tally_grams(batches: Iterator[pa.RecordBatch], d: int, known: KeyFilter, part_bits: int) -> Iterator[pa.RecordBatch]:
    """Short hashes and counts (``LEAST`` at most) of the (d + 1)-grams whose first and last d words pass, by their leading bits."""
    tally = Tally(1)

    def sent() -> Iterator[pa.RecordBatch]:
        (keys,), n = tally.sum()
        bounds = np.searchsorted(keys, np.arange((1 << part_bits) + 1) << (48 - part_bits))
        low, high, n = keys.astype(np.uint32), (keys >> 32 & 255).astype(np.uint8), np.minimum(n, LEAST).astype(np.uint8)
        cut = lambda v: pa.array([v[a:b].tobytes() for a, b in pairwise(bounds.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << part_bits), pa.int32()), cut(low), cut(high), cut(n)], ["part", "low", "high", "n"])

    for batch in batches:
        for _, part in _texts(batch, 0):
            grams, left = _grams(part, d)
            ok = known.passes(grams[0] if d == 1 else _short(grams[d - 1]))
            tally.add(_short(grams[d][np.flatnonzero(ok[:-1] & ok[1:] & (left[:-1] > d))])[None])
            if tally.size > SENT:
                yield from sent()
    yield from sent()


def _frequent(sent: DataFrame, part_bits: int) -> DataFrame:
    """(key): short hashes that all tasks together have ``LEAST`` times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, Tally] = {}
        for batch in batches:
            for part, low, high, n in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                low, high, n = np.frombuffer(low.as_buffer(), np.uint32), np.frombuffer(high.as_buffer(), np.uint8), np.frombuffer(n.as_buffer(), np.uint8)
                tallies.setdefault(part, Tally(1)).add((np.int64(part) << (48 - part_bits) | high.astype(np.int64) << 32 | low)[None], n.astype(np.int64))
        for part in list(tallies):
            rows, n = tallies.pop(part).sum()
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][n >= LEAST])], ["key"])

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "part").mapInArrow(tidy(merge), "key long")


_COUNTED = "part int, level byte, gram binary, context binary, shorter binary, n binary"


def _planes(v: np.ndarray) -> bytes:
    """The bytes of some numbers, the lowest of all first: high bytes of small numbers then compress to nothing."""
    return v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes()


def _unplanes(raw: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _steps(ascending: np.ndarray) -> bytes:
    """Unsigned keys as steps from one to the next."""
    return _planes(np.diff(ascending, prepend=np.uint64(0)))


def _unsteps(raw: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _unsigned(ascending: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Keys ascending as unsigned numbers, and what belongs to them: of signed ones the upper half comes before."""
    first = int(np.searchsorted(ascending, 0))
    return [np.roll(v, -first) for v in (ascending.view(np.uint64), *others)]


def _cuts(ascending: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Parts by the leading bits of unsigned keys that are not empty: number, first and last place."""
    bounds = np.append(np.searchsorted(ascending, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(ascending)).tolist()
    return [(part, a, b) for part, (a, b) in enumerate(pairwise(bounds)) if b > a]


def _count_grams(batches: Iterator[pa.RecordBatch], known: list[KeyFilter], part_bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the (d + 1)-grams, d from 1, that pass their filter and whose parts do, with their first and last d words.

    A task sends them in parts by their leading bits, ascending, as steps from one to the next.
    """
    names = [x.split()[0] for x in _COUNTED.split(", ")]
    tallies = [Tally(3) for _ in known[1:]]

    def rows(d: int) -> Iterator[pa.RecordBatch]:
        (gram, *ends), n = tallies[d - 1].sum()
        gram, n, *ends = _unsigned(gram, n.astype(np.uint32), *ends)
        full = _cuts(gram, part_bits)
        for at in range(0, len(full), 64):
            some = full[at : at + 64]
            cut = lambda v: pa.array([_planes(v[a:b]) for _, a, b in some], pa.binary())  # noqa: B023, E731
            steps = pa.array([_steps(gram[a:b]) for _, a, b in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int32()), pa.array([d] * len(some), pa.int8()), steps, *map(cut, ends), cut(n)], names)

    for batch in batches:
        for _, part in _texts(batch, 0):
            grams, left = _grams(part)
            ok = known[0].passes(grams[0])
            for d, mine in enumerate(known[1:], 1):
                i = np.flatnonzero(ok & np.append(ok[1:], False) & (left > d))
                i = i[mine.passes(_short(grams[d][i]))]
                ok = np.zeros(len(left), bool)
                ok[i] = True
                tallies[d - 1].add(np.stack([grams[d][i], grams[d - 1][i], grams[d - 1][i + 1]]))
                if tallies[d - 1].size > SENT // 3:
                    yield from rows(d)
    for d in range(1, len(known)):
        yield from rows(d)


def _counted(sent: DataFrame) -> DataFrame:
    """(level, gram, n, context, shorter) of the n-grams that all tasks together have ``LEAST`` times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[tuple[int, int], Tally] = {}
        for batch in batches:
            for part, level, gram, context, shorter, n in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
                keys = _unsteps(gram).view(np.int64)
                tallies.setdefault((part, level), Tally(3)).add(np.stack([keys, _unplanes(context, np.int64), _unplanes(shorter, np.int64)]), _unplanes(n, np.uint32).astype(np.int64))
        for part, level in sorted(tallies):
            (gram, context, shorter), n = tallies.pop((part, level)).sum()
            often = n >= LEAST
            for cols in _in_parts(100_000, gram[often], n[often], context[often], shorter[often]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), level, np.int8)), *cols], ["level", "gram", "n", "context", "shorter"])

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "part").mapInArrow(tidy(merge), "level byte, gram long, n long, context long, shorter long")


def _states(train: DataFrame, words: DataFrame, divisor: float) -> DataFrame:
    """(gram, value, rest): log10 probability of each stored transition of a retained state, and
    log10 factor of each retained state on its parent's probability of all other tokens."""
    part_bits = min(16, max(8, (4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    lower = stored(words.where(F.col("n") >= LEAST).select("gram", "n", F.log10((F.col("n") + 0.1) / divisor).alias("lp")))
    known = [KeyFilter(lower.select(F.col("gram").alias("key")))]
    for d in range(1, DEPTH + 1):
        sent = train.mapInArrow(tidy(lambda b, d=d, mine=known[-1]: _tally_grams(b, d, mine, part_bits)), _SENT)
        frequent = stored(_frequent(sent, part_bits))
        known.append(KeyFilter(frequent))
        forget(frequent)
    counted = stored(_counted(train.mapInArrow(tidy(lambda b: _count_grams(b, known, part_bits)), _COUNTED)))
    found, kept = None, [lower]
    for d in range(1, DEPTH + 1):
        # whatever occurs LEAST times has parts that do, so both joins find every row
        rows = counted.where(F.col("level") == d).join(lower.select(F.col("gram").alias("shorter"), F.col("lp").alias("parent")), "shorter")
        sums = rows.groupBy("context").agg(F.count("*").alias("size"), F.sum("n").alias("stored"), F.sum(F.pow(F.lit(10.0), "parent")).alias("under"), F.sum(F.expr("n * (ln(n) - parent * ln(10D))")).alias("gain"))
        sums = sums.join(lower.select(F.col("gram").alias("context"), F.col("n").alias("total")), "context")
        of_all = sums.withColumn("rest", F.expr("greatest(1 - stored / (total + size), 1e-9D) / greatest(1 - under, 1e-9D)"))
        gain = F.expr("gain - stored * ln(total + size) + greatest(total - stored, 0) * ln(rest)")
        states = stored(of_all.where(gain > PER_SYMBOL * (F.col("size") + 1)).select("context", (F.col("total") + F.col("size")).alias("all"), F.log10("rest").alias("rest")))
        value = F.log10(F.col("n") / F.col("all"))
        lower = stored(rows.join(states.select("context", "all"), "context", "left").select("gram", "n", value.alias("value"), F.coalesce(value, "parent").alias("lp")))
        level = lower.where("value is not null").select("gram", "value", F.lit(None).cast("double").alias("rest")).unionByName(states.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("value"), "rest"))
        found = level if found is None else found.unionByName(level)
        kept.append(lower)
    found = stored(found.groupBy("gram").agg(F.max("value").cast("float").alias("value"), F.max("rest").cast("float").alias("rest")))
    forget(counted, *kept)
    return found


def _wanted(grams: list[np.ndarray], left: np.ndarray, contexts: KeyFilter, followed: KeyFilter) -> list[np.ndarray]:
    """Which n-grams to look up: all words, retained contexts, and what follows these; filters let some others through."""
    masks, context = [np.ones(len(left), bool)], contexts.passes(grams[0])
    for k in range(1, len(grams)):
        here, wanted = left > k, np.zeros(len(left), bool)
        i = np.flatnonzero(here & context)
        wanted[i[followed.passes(grams[k][i])]] = True
        if k < len(grams) - 1:
            context = contexts.passes(grams[k])
            wanted |= here & context
        masks.append(wanted)
    return masks


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about a third of ``SENT`` rows in all."""
    some, rows = [], 0
    for batch in batches:
        some.append(batch)
        rows += batch.num_rows
        if rows >= SENT // 3:
            yield some
            some, rows = [], 0
    if some:
        yield some


class Answers:
    """What the tables told a block: training counts of its words, values and factors of its n-grams.

    Keys ascend as unsigned numbers; what a table does not have is nan.  One more row answers for keys that are not there.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, value: np.ndarray, rest: np.ndarray):
        self.none = len(keys)
        self.keys = np.append(keys, np.uint64((1 << 64) - 1))
        self.n, self.value, self.rest = (np.append(v, v.dtype.type(np.nan)) for v in (n, value, rest))
        self.bits = max(1, len(keys).bit_length())
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))

    @classmethod
    def of_tables(cls, model: pa.Table) -> Answers:
        """Of rows of both tables, words with n."""
        is_word = model.column("n").is_valid()
        tables = [model.filter(m) for m in (is_word, pc.invert(is_word))]
        grams = [t.column("gram").to_numpy().view(np.uint64) for t in tables]
        keys = np.unique(np.concatenate(grams))
        words, states = (np.searchsorted(keys, g) for g in grams)
        n = np.full(len(keys), np.nan)
        n[words] = tables[0].column("n").to_numpy()
        value, rest = np.full((2, len(keys)), np.nan, np.float32)
        value[states], rest[states] = (tables[1].column(c).to_numpy() for c in ("value", "rest"))
        return cls(keys, n, value, rest)

    @classmethod
    def of_rows(cls, rows: pa.Table) -> Answers:
        """Of what ``sent`` made for one block or shard; a key may come twice, with its count and with the rest."""
        unzip = zstandard.ZstdDecompressor().decompress
        column = lambda name: (pa.scalar(unzip(x.as_buffer()), pa.binary()) for x in rows.column(name))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        keys = join(map(_unsteps, column("keys")), np.uint64)
        has = join((np.frombuffer(x.as_buffer(), np.uint8) for x in column("has")), np.uint8)
        cols = []
        for bit, name, kind in ((1, "n", np.int64), (2, "value", np.float32), (4, "rest", np.float32)):
            col = np.full(len(keys), np.nan, np.float64 if name == "n" else np.float32)
            col[has & bit != 0] = join((_unplanes(x, kind) for x in column(name)), kind)
            cols.append(col)
        every, place = np.unique(keys, return_inverse=True)
        merged = [np.full(len(every), np.nan, c.dtype) for c in cols]
        for to, c in zip(merged, cols, strict=True):
            there = ~np.isnan(c)
            to[place[there]] = c[there]
        return cls(every, *merged)

    def sent(self, keys: np.ndarray) -> list[bytes]:
        """Keys of those asked for (ascending) that are there, what each has, and that."""
        at = np.searchsorted(self.keys[:-1], keys)
        at = at[self.keys.take(at) == keys]
        at = at[at < self.none]
        n, value, rest = (v.take(at) for v in (self.n, self.value, self.rest))
        there = [~np.isnan(v) for v in (n, value, rest)]
        has = there[0] | there[1].astype(np.uint8) << 1 | there[2].astype(np.uint8) << 2
        packed = [_steps(self.keys.take(at)), has.astype(np.uint8).tobytes(), _planes(n[there[0]].astype(np.int64)), _planes(value[there[1]]), _planes(rest[there[2]])]
        return list(map(zstandard.ZstdCompressor(level=1).compress, packed))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each key: hashes are spread evenly, so few share their leading bits."""
        key = grams.view(np.uint64)
        at = self.first.take((key >> np.uint64(64 - self.bits)).view(np.int64))
        on = np.flatnonzero(self.keys.take(at) < key)
        while len(on):
            at[on] += 1
            on = on[self.keys.take(at.take(on)) < key.take(on)]
        return np.where(self.keys.take(at) == key, at, self.none)

    def score(self, grams: list[np.ndarray], wanted: list[np.ndarray], left: np.ndarray, words: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 probability of each token by its longest retained context; ``words``: their rows."""
        out, at = base.copy(), words
        for d in range(1, DEPTH + 1):
            factor = self.rest.take(at)
            i = np.flatnonzero((left > d) & ~np.isnan(factor))  # the token d places on is in the same text
            out[i + d] += factor[i]
            i = np.flatnonzero(wanted[d])
            at = np.full(len(left), self.none)
            at[i] = self.find(grams[d][i])
            value = self.value.take(at)
            i = np.flatnonzero(~np.isnan(value))
            out[i + d] = value[i]
        return out


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    flagged = docs.select("doc_id", "text", _train_flag(docs["doc_id"]).alias("train"))
    train = flagged.where("train").select("text")
    words = stored(train.mapInArrow(tidy(_count_words), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    divisor = n_all + 0.1 * (n_distinct + 1)
    states = _states(train, words, divisor)
    contexts, followed = (KeyFilter(states.where(f"{c} is not null").select(F.col("gram").alias("key"))) for c in ("rest", "value"))
    blocks = max(1, -(-n_all // BLOCK))
    shard_bits = min(16, max(3, (8 * blocks - 1).bit_length()))
    forget_shuffles(spark)
    none = F.lit(None).cast("float")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in map(pa.Table.from_batches, _together(batches)):
            found = Answers.of_tables(table)
            keys = found.keys[:-1]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (shard, *found.sent(keys[a:b])), strict=True)) for shard, a, b in _cuts(keys, shard_bits)], schema)

    names = ["shard", "keys", "has", "n", "value", "rest"]
    schema = pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in names[1:])])
    binaries = ", ".join(f"{x} binary" for x in names[1:])
    model = words.select("gram", "n", none.alias("value"), none.alias("rest")).unionByName(states.select("gram", F.lit(None).cast("long").alias("n"), "value", "rest"))
    model = model.mapInArrow(tidy(pack), f"shard int, {binaries}")
    dealt = flagged.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Distinct] = {}
        for batch in batches:
            blocks_of = np.asarray(batch.column(3))
            for at, part in _texts(batch, 1):
                grams, left = _grams(part)
                owner = np.repeat(blocks_of[at : at + len(part)], np.diff(np.append(np.flatnonzero(np.concatenate([np.ones(1, bool), left[:-1] == 1])), len(left))))
                wanted = _wanted(grams, left, contexts, followed)
                for block in np.unique(owner):
                    mine = owner == block
                    keys = np.concatenate([g[w & mine] for g, w in zip(grams, wanted, strict=True)])
                    keys.sort()
                    asked.setdefault(int(block), Distinct()).add(keys[_firsts(keys)])
        for block in list(asked):
            (keys,) = _unsigned(asked.pop(block).all())
            full = _cuts(keys, shard_bits)
            for at in range(0, len(full), 64):
                some = full[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int32()), pa.array([k for k, _, _ in some], pa.int32()), pa.array([_steps(keys[a:b]) for _, a, b in some], pa.binary())], ["block", "shard", "keys"])

    def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
        found = Answers.of_rows(model)
        rows = [(block, shard, *found.sent(_unsteps(keys))) for block, shard, keys in zip(asked.column("block").to_pylist(), asked.column("shard").to_pylist(), asked.column("keys"), strict=True)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 5))], ["block", "shard", "keys", "has", "n", "value", "rest"])

    asked = dealt.mapInArrow(tidy(ask), "block int, shard int, keys binary")
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(answer, f"block int, shard int, {binaries}")
    answers = stored(answers)  # so what they were made of goes before texts are scored
    forget(words, states)
    forget_shuffles(spark)

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        model = Answers.of_rows(answered)
        known_of = ~np.isnan(model.n)
        base_of = np.log10((np.where(known_of, model.n, 0) + 0.1) / divisor)
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for part in slices(texts.column("text")):
            grams, left = _grams(part)
            at = model.find(grams[0])
            known, base = known_of[at], base_of[at]
            full = model.score(grams, _wanted(grams, left, contexts, followed), left, at, base)
            starts = np.flatnonzero(np.concatenate([np.ones(1, bool), left[:-1] == 1]))
            for col, v in zip(cols, (left[starts], np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(full, starts)), strict=True):
                col.append(v)
        held = [not t for t in texts.column("train").to_pylist()]
        n_tokens, n_known, base_score, full = (pa.array(np.concatenate(c)) for c in cols)
        arrays = [texts.column("doc_id"), pa.array(held, pa.bool_()), n_tokens, n_known, pa.array([n_all] * len(held), pa.int64()), base_score, full]
        return pa.Table.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)

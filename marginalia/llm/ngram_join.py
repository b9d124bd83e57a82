"""Operator 10: documents linked by the Jaccard similarity of their n-gram sets.

The document by n-gram incidence matrix is multiplied by its transpose in blocks of n-grams,
but only over each set's prefix: with all n-grams in one order, two sets that reach the
bound share one of their first ``size - ceil(bound * size) + 1``.  The order puts n-grams
that many documents share last, so shared passages seldom are in a prefix.  N-grams of one
set alone are dropped as soon as they are sorted.

First each set is compared with one other: the least set (a hash) that most of its n-grams
have.  The links found join most near copies into components.  Links between sets of one
component change nothing, so afterwards only n-grams that several components have take part:
the overlaps of their pairs are summed over the blocks, and a pair is dropped when its count
stays below the overlap that its sizes demand, less what can lie behind the prefixes.  An
n-gram that more than ``BIG`` sets have gives no pairs one by one: its sets meet in chunks,
whose product is an array of bounded size.  What is left is checked on the whole sets.

Equal sets are one node from the start.  N-grams and sets are known by 64-bit hashes.  Null
and empty texts have empty sets and no links; an empty table gives an empty one.  Each row is
a document of its own; rows that share a doc_id keep their own sets.  A null doc_id takes
part, but names no component: one of null doc_ids alone has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.components import connected
from marginalia.llm.shared import KeyFilter, forget, stored, tidy
from marginalia.llm.units import picked, slices
from marginalia.llm.words import P, Recent, Words, mix

N = 5
SIMILAR = 75  # percent
BIG = 64  # nodes of an n-gram that are paired at once
HOT_LOCAL = 3  # documents of one task that make an n-gram known as shared
HOT = 48  # documents, so counted, from which it is ordered last
HOT_MOST = 200_000  # n-grams that are ordered last, at most: what is sent to all workers
CHUNK = 2048  # nodes of one side when the nodes of a large n-gram are multiplied
CHUNK_GRAMS = 1 << 22  # n-grams of all their sets, whose sketches have two bytes each
ROWS, COLUMNS = 512, 2048  # of a block of their incidence


class Sets:
    """The shingle sets of some texts: ``grams[bounds[t] : bounds[t + 1]]`` are those of text t, ascending; ``node`` names a set."""

    def __init__(self, texts: list[str | None], n: int = N):
        found = Words(texts, lower=True)
        w, size = found.hash, np.diff(found.bounds)
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for k in range(n):
            h = (h ^ w[k : k + len(h)]) * P
            h ^= h >> np.uint64(29)
        parts, sizes, nodes = [], [], []
        for low, words in zip(found.bounds[:-1].tolist(), size.tolist(), strict=True):
            if words >= n:
                grams = np.sort(h[low : low + words - n + 1])
                new = np.empty(len(grams), bool)
                new[:1] = True
                np.not_equal(grams[1:], grams[:-1], out=new[1:])
                grams = grams[new]
            elif words:  # the whole sequence is one shingle, unlike any of n words
                whole = np.full(1, words, np.uint64)
                for x in w[low : low + words]:
                    whole = mix(whole ^ x, n)
                grams = whole
            else:
                grams = np.zeros(0, np.uint64)
            parts.append(grams)
            sizes.append(len(grams))
            nodes.append(xxhash.xxh3_64_intdigest(grams) - (1 << 63))
        self.grams = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.size = np.array(sizes, np.int64)
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size)])
        self.node = np.array(nodes, np.int64)

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of the texts ``some``, one after the other, and the place in ``some`` each belongs to."""
        size = self.size[some]
        return picked(self.grams, self.size, some), np.repeat(np.arange(len(some)), size)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Hashes of the distinct n-word shingles, ascending; of the whole sequence if it is shorter."""
    return Sets([text], n).grams


def prefix_size(size):
    return size - (SIMILAR * size + 99) // 100 + 1


def needed(a, b):
    """Least overlap of sets of sizes a and b that reach the bound: 100 i >= 75 (a + b - i)."""
    return (SIMILAR * (a + b) + 100 + SIMILAR - 1) // (100 + SIMILAR)


# the same in SQL: the overlap that sizes n and m demand beyond what can lie behind the prefixes
_NEEDED = f"div({SIMILAR} * (n + m) + {100 + SIMILAR - 1}, {100 + SIMILAR})"
_REST = f"greatest(div({SIMILAR} * n + 99, 100), div({SIMILAR} * m + 99, 100)) - 1"
_SIZES = f"100 * least(n, m) >= {SIMILAR} * greatest(n, m)"


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, Sets]]:
    at = 0
    for part in slices(batch.column(column)):
        yield at, Sets(part)
        at += len(part)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n) of each text, then (gram, count) of n-grams that the task's nodes share."""
    held: list[np.ndarray] = []
    names, size, recent = ["doc_id", "node", "n", "gram"], 0, Recent()

    def shared() -> pa.RecordBatch:
        grams = np.sort(np.concatenate([*held, np.zeros(0, np.uint64)]))
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(grams)))
        some = n >= HOT_LOCAL
        g = grams[first[some]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.nulls(len(g), pa.int64()), pa.nulls(len(g), pa.int64()), pa.array(n[some]), pa.array(g)], names)

    for batch in batches:
        for at, x in _sets(batch, 1):
            fresh = np.flatnonzero(recent.new(x.node.view(np.uint64)))
            held.append(x.of(fresh)[0])
            size += len(held[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x.node)), pa.array(x.node), pa.array(x.size), pa.nulls(len(x.node), pa.int64())], names)
            if size > 2_500_000:
                yield shared()
                held, size = [], 0
    yield shared()


def _prefixes(batches: Iterator[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(gram, node, n) of each distinct set's prefix; a set that came lately is left out."""
    known, rank = hot
    recent = Recent()
    for batch in batches:
        for _, x in _sets(batch, 0):
            some = np.flatnonzero(recent.new(x.node.view(np.uint64)) & (x.size > 0))
            grams, owner = x.of(some)
            if len(known):
                k = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                late = np.where(known[k] == grams, rank[k], 0)
                order = np.lexsort((late, owner))  # stable: within one rank grams stay in their order
                grams, owner = grams[order], owner[order]
            size = x.size[some]
            place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
            first = place < prefix_size(size)[owner]
            grams, owner = grams[first], owner[first]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(x.node[some][owner]), pa.array(size[owner].astype(np.int32))], ["gram", "node", "n"])


_STAR = "gram long, node long, n int, pivot long, m int"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by gram and node: those of grams that several nodes have, each with the gram's least node."""
    names = [x.split()[0] for x in _STAR.split(", ")]
    carry = [np.zeros(0, np.int64)] * 3  # the last row so far, which may be alone
    pivot: tuple[int, int, int] | None = None  # gram, node and size of the run it belongs to, if that has come out in part
    for batch in batches:
        gram, node, n = (np.concatenate([c, np.asarray(x).astype(np.int64)]) for c, x in zip(carry, batch.columns, strict=True))
        if not len(gram):
            continue
        same = (gram[1:] == gram[:-1]) & (node[1:] == node[:-1])
        keep = np.concatenate([np.ones(1, bool), ~same])
        gram, node, n = gram[keep], node[keep], n[keep]
        start = np.concatenate([np.ones(1, bool), gram[1:] != gram[:-1]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(gram)), 0))
        least, size = node[first], n[first]
        more = np.concatenate([gram[1:] == gram[:-1], np.zeros(1, bool)])
        goes = ~start | more
        if pivot is not None and pivot[0] == gram[0]:
            run = gram == gram[0]
            least, size = np.where(run, pivot[1], least), np.where(run, pivot[2], size)
            goes |= run
        goes[-1] = False  # waits for what follows
        carry = [gram[-1:], node[-1:], n[-1:]]
        pivot = (int(gram[-1]), int(least[-1]), int(size[-1])) if len(gram) > 1 and gram[-2] == gram[-1] or pivot is not None and pivot[0] == gram[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(gram[goes]), pa.array(node[goes]), pa.array(n[goes].astype(np.int32)), pa.array(least[goes]), pa.array(size[goes].astype(np.int32))], names)
    if pivot is not None:
        yield pa.RecordBatch.from_arrays([pa.array(carry[0]), pa.array(carry[1]), pa.array(carry[2].astype(np.int32)), pa.array([pivot[1]], pa.int64()), pa.array([pivot[2]], pa.int32())], names)


def _verified(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a, b) whose whole sets reach the bound.  Sets are made anew for the nodes of edges only."""
    keys = stored(edges.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    wanted = KeyFilter(keys)
    forget(keys)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, x in _sets(batch, 0):
                some = np.flatnonzero(wanted.passes(x.node))
                some = some[recent.new(x.node[some].view(np.uint64))]
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(x.size[some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.node[some]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.of(some)[0].view(np.int64)))], ["node", "grams"])

    sets = docs.select("text").mapInArrow(tidy(make), "node long, grams array<long>").dropDuplicates(["node"])
    left = edges.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.where((100 + SIMILAR) * common >= SIMILAR * (F.size("ga") + F.size("gb"))).select("a", "b")


def _first_edges(shared: DataFrame) -> DataFrame:
    """Each node with the pivot that most of its grams have, if that many may do: one edge for a node at most."""
    votes = shared.where("node <> pivot").groupBy("node", "n", "pivot", "m").agg(F.count("*").alias("votes"))
    likely = votes.where(_SIZES).where(f"votes + {_REST} >= {_NEEDED}")
    best = likely.groupBy("node").agg(F.max(F.struct("votes", "pivot")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.pivot").alias("b"))


_PAIR = "a long, b long, n int, m int, shared int"


def _small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the nodes of each small gram: pairs of nodes of different components, with the number of grams that brought them."""
    names = [x.split()[0] for x in _PAIR.split(", ")]
    held: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        a, b, n, m, k = np.concatenate([*held, np.zeros((5, 0), np.int64)], 1)
        order = np.lexsort((b, a))
        a, b, n, m, k = a[order], b[order], n[order], m[order], k[order]
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        count = np.add.reduceat(k, first) if len(first) else k
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), *(pa.array(v.astype(np.int32)) for v in (n[first], m[first], count))], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.column(0).slice(at, 2000)  # (node, n, c) of each gram
            flat, f = part.flatten(), np.diff(np.asarray(part.offsets))
            node, n, c = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            starts = np.cumsum(f) - f
            for size in np.unique(f[f > 1]):
                i, j = np.triu_indices(size, 1)
                x, y = ((starts[f == size][:, None] + v).ravel() for v in (i, j))
                ok = (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= SIMILAR * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
                held.append(np.stack([node[x], node[y], n[x], n[y], np.ones(len(x), np.int64)]))
            if sum(h.shape[1] for h in held) > 500_000:
                out = summed()
                held = [np.stack([np.asarray(v).astype(np.int64) for v in out.columns])]
                if out.num_rows > 250_000:
                    yield out
                    held = []
    yield summed()


def _sketches(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sketch) of the nodes (and of some others): 16 bits of each gram of the whole set, ascending."""
    wanted = KeyFilter(nodes.select(F.col("node").alias("key")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, x in _sets(batch, 0):
                some = np.flatnonzero(wanted.passes(x.node))
                some = some[recent.new(x.node[some].view(np.uint64))]
                short = (x.grams >> np.uint64(48)).astype("<u2")  # grams ascend, so these do
                found = [short[x.bounds[k] : x.bounds[k + 1]].tobytes() for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x.node[some]), pa.array(found, pa.binary())], ["node", "sketch"])

    return docs.select("text").mapInArrow(tidy(make), "node long, sketch binary").groupBy("node").agg(F.min("sketch").alias("sketch"))


def _codes(sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches of several nodes with equal values of one node made unlike: the k-th one is k * 2 ** 16 more."""
    owner = np.repeat(np.arange(len(size)), size)
    same = np.concatenate([np.zeros(1, bool), (sketch[1:] == sketch[:-1]) & (owner[1:] == owner[:-1])]) if len(sketch) else np.zeros(0, bool)
    at = np.arange(len(sketch))
    return sketch.astype(np.int64) + (at - np.maximum.accumulate(np.where(same, 0, at))) * 65536


def _open_pairs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that share large grams of their prefixes and may reach the bound.

    ``rows`` (gram, node, n, c) are those of large grams that several components have.  Pairs that
    also share a small gram are settled elsewhere.  Rows of one gram are dealt to chunks of about
    ``CHUNK`` nodes (fewer where their sets are large) and every two chunks meet in one task, which multiplies the node by gram
    incidence of the two, some columns at a time.  Pairs that can reach the bound by their
    prefixes are then counted in the sketches of the whole sets, which never show less than the
    sets share; so hardly any pair leaves the task that is no link.
    """
    lists = rows.groupBy("node").agg(F.sort_array(F.collect_set("gram")).alias("large"))  # a prefix at most
    chunks = rows.groupBy("gram").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    dealt = rows.join(chunks, "gram").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).join(lists, "node")
    nodes = stored(lists.select("node"))
    dealt = dealt.join(_sketches(docs, nodes), "node")
    forget(nodes)
    meeting = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))

    def multiply(table: pa.Table) -> pa.Table:
        node, n, c, chunk = (table.column(k).to_numpy().astype(np.int64) for k in ("node", "n", "c", "chunk"))
        low, high, gram = table.column("low")[0].as_py(), table.column("high")[0].as_py(), table.column("gram")[0].as_py()
        large = table.column("large").combine_chunks()
        values = np.asarray(large.flatten())
        owner = np.repeat(np.arange(len(node)), np.asarray(large.value_lengths()))
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        known, column = np.unique(values, return_inverse=True)
        both = np.bincount(column, minlength=len(known)) > 1  # a gram of one node alone adds nothing
        rest = n - prefix_size(n)
        codes = _codes(np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2"), n)
        mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
        first = np.cumsum(n) - n
        found = []
        for at in range(0, len(left), ROWS):
            i = left[at : at + ROWS]
            mine = np.zeros(len(node), bool)
            mine[i] = True
            overlap, earlier = np.zeros((len(i), len(right)), np.float32), np.zeros((len(i), len(right)), bool)
            here = np.flatnonzero(both & (np.bincount(column[mine[owner]], minlength=len(known)) > 0))
            for k in range(0, len(here), COLUMNS):
                cols = here[k : k + COLUMNS]
                place = np.full(len(known), -1)
                place[cols] = np.arange(len(cols))
                on = place[column] >= 0
                incidence = np.zeros((len(node), len(cols)), np.float32)
                incidence[owner[on], place[column[on]]] = 1
                before = int(np.searchsorted(known[cols], gram))
                earlier |= incidence[i, :before] @ incidence[right, :before].T > 0
                overlap += incidence[i] @ incidence[right].T
            # a pair comes out at the first gram it shares
            ok = (overlap + np.maximum(rest[i][:, None], rest[right]) >= needed(n[i][:, None], n[right])) & (c[i][:, None] != c[right]) & ~earlier
            x, y = np.nonzero(ok & (100 * np.minimum(n[i][:, None], n[right]) >= SIMILAR * np.maximum(n[i][:, None], n[right])))
            for k in np.unique(x).tolist():
                a, others = i[k], right[y[x == k]]
                mine = codes[first[a] : first[a] + n[a]]
                mark[mine] = True
                common = np.add.reduceat(mark[picked(codes, n, others)].astype(np.int64), np.cumsum(n[others]) - n[others])
                mark[mine] = False
                others = others[common >= needed(n[a], n[others])]
                found.append(np.stack([np.full(len(others), node[a]), node[others]], 1))
        pairs = np.concatenate([*found, np.zeros((0, 2), np.int64)])
        return pa.table({"a": pairs.min(1) if len(pairs) else pairs[:, 0], "b": pairs.max(1) if len(pairs) else pairs[:, 1]})

    return meeting.select("gram", "node", "n", "c", "chunk", "low", "high", "large", "sketch").groupBy("gram", "low", "high").applyInArrow(multiply, "a long, b long").distinct()


def _later_edges(docs: DataFrame, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs of nodes in different components that may reach the bound, already written.

    Only grams that several components have take part: all that such a pair shares are among them.
    """
    placed = shared.select("gram", "node", "n").join(labels, "node", "left").select("gram", "node", "n", F.coalesce("label", "node").alias("c"))
    mixed = placed.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("f")).where("low < high").select("gram", "f")
    rows = stored(placed.join(mixed, "gram"))
    groups = rows.where(F.col("f") <= BIG).groupBy("gram").agg(F.collect_list(F.struct("node", "n", "c")).alias("nodes"))  # BIG at most
    pairs = groups.select("nodes").mapInArrow(tidy(_small_pairs), _PAIR)
    summed = pairs.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    # what a pair shares of large grams is at most what the one with fewer of them has
    many = rows.where(F.col("f") > BIG).groupBy("node").agg(F.count("*").alias("large"))
    for side in ("a", "b"):
        summed = summed.join(many.select(F.col("node").alias(side), F.col("large").alias(f"large_{side}")), side, "left")
    summed = summed.withColumn("most", F.col("shared") + F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0))))
    close = summed.where(f"most + {_REST} >= {_NEEDED}").select("a", "b")
    large = rows.where(F.col("f") > BIG)
    edges = stored((close if large.isEmpty() else close.unionByName(_open_pairs(docs, large))).distinct())
    forget(rows)
    return edges


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of every document, and (node, label) of every node with links."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    first = stored(rows.mapInArrow(tidy(_names), "doc_id long, node long, n long, gram long"))
    named = first.where("node is not null").select("doc_id", "node", "n")
    common = first.where("node is null").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    hot = common.orderBy(F.desc("n"), "gram").limit(HOT_MOST).toArrow().sort_by("n")
    grams = hot.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    sent = spark.sparkContext.broadcast((grams[order], (np.arange(len(grams)) + 1)[order]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = rows.select("text").mapInArrow(tidy(lambda b: _prefixes(b, sent.value)), "gram long, node long, n int")
    shared = stored(prefixes.repartition(parts, "gram").sortWithinPartitions("gram", "node").mapInArrow(tidy(_stars), _STAR))
    first_edges = stored(_first_edges(shared))
    links = stored(_verified(rows, first_edges))
    labels = connected(links)
    later_edges = _later_edges(rows, shared, labels)
    more = stored(_verified(rows, later_edges))
    forget(shared, first_edges, later_edges)
    return named, connected(links.unionByName(more))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every document."""
    named, labels = link(docs)
    nodes = named.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "label").select("node", "component_id")
    return named.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

"""Operator 11: a Merkle manifest of a table, folded again from kept hash states.

Rows are leaves of one tree for each source, and the sources' roots are leaves of the tree
of the whole dataset; every ``FANOUT`` consecutive nodes are one parent.  A child's digest
is hex text of 64 bytes, and a parent's hash reads its children in order.  So the state of
that hash before each child slot is all that is needed to put another child there: a parent
keeps a copy of the state before every slot, and folding goes on from the copy with the
replacement and the right siblings only.

A tree is built in rounds.  In a round a task gets ``SPAN`` consecutive nodes and lifts them
by as many levels, so a source of any size is dealt out in small blocks, and the nodes that
are left for the next round are 1/``SPAN`` as many.  On the way down every block learns the
siblings on its way to the root, for which the states before its slots are made once; all
leaves of the block copy them.  Nothing passes through the driver but the size of the
largest tree.

Ties and odd rows: leaves of a source are in the order of doc_id, null first, equal ones by
leaf and then by replacement; a null source is a source of its own and the first.  An empty
table has no rows.  Other columns than those of ``FIELDS`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import stored

FANOUT = 16
SPAN = FANOUT**2  # nodes that a task lifts together
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5  # what divides the checksum of a tampered document's id
_PATH = "array<struct<left:string,right:string>>"


def leaf_of(**changed: Column) -> Column:
    """Digest of a row's fields, each as its length in bytes and its value; ``changed`` gives fields other values."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)).cast("binary"), 256)


def levels_above(n: int) -> int:
    """Levels between ``n`` nodes and their root."""
    found = 0
    while n > 1:
        n, found = -(-n // FANOUT), found + 1
    return found


def parents(children: list[bytes]) -> tuple[list[bytes], list]:
    """Digests of the parents of a level, and the state before each child's slot."""
    found, states = [], []
    for at in range(0, len(children), FANOUT):
        h = hashlib.sha256()
        for child in children[at : at + FANOUT]:
            states.append(h.copy())
            h.update(child)
        found.append(h.hexdigest().encode())
    return found, states


def siblings(children: list[bytes], i: int) -> tuple[bytes, bytes]:
    """Those of a child's run on its left, and on its right."""
    at = i // FANOUT * FANOUT
    return b"".join(children[at:i]), b"".join(children[i + 1 : at + FANOUT])


def _numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Rows with ``pos``, their place from 0 in their tree, and ``n``, the size of it.

    Sorted by ranges, so a tree may lie over many tasks; a row's place is its place in its
    part plus the rows of its tree in the parts before.
    """
    ordered = [F.col(tree).asc(), *order]
    sorted_ = stored(rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # the number of the task that wrote the row
    runs = sorted_.groupBy(tree, part.alias("part")).agg(F.count("*").alias("n_run"), F.min("at").alias("first"))
    whole = Window.partitionBy(tree)
    bases = runs.select(tree, "part", (F.sum("n_run").over(whole.orderBy("part")) - F.col("n_run") - F.col("first")).alias("base"), F.sum("n_run").over(whole).alias("n"))
    return sorted_.withColumn("part", part).join(bases, [tree, "part"]).withColumn("pos", F.col("at") + F.col("base")).drop("part", "at", "base")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each block; rows come sorted by (tree, block), their first two columns."""
    held: list[tuple] = []
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for key, group in groupby(rows, key=lambda r: r[:2]):
            if held and held[0][:2] != key:
                yield held
                held = []
            held.extend(group)
    if held:
        yield held


def _lifts(n: int) -> int:
    """How many levels a round lifts the nodes of a tree that has ``n`` of them."""
    return min(levels_above(SPAN), levels_above(n))


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, block, ...) with each block together and in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _raised(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) of the nodes that a round makes of (tree, pos, n, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in _blocks(batches):
            level, n = [r[3].encode() for r in block], block[0][4]
            for _ in range(_lifts(n)):
                level = parents(level)[0]
            out.append((block[0][0], block[0][1], -(-n // SPAN), level[0].decode()))
            if len(out) == 4096:
                yield _batch(out, "tree string, pos long, n long, digest string")
                out = []
        yield _batch(out, "tree string, pos long, n long, digest string")

    rows = nodes.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "digest", "n")
    return _by_block(rows, "pos").mapInArrow(run, "tree string, pos long, n long, digest string")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), _PATH: pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes after each round, one at least, until every tree has one."""
    found = []
    while not found or (most := found[-1].agg(F.max("n")).first()[0]) is not None and most > 1:
        found.append(stored(_raised((found or [nodes])[-1])))
    return found


def _walked(members: DataFrame, above: DataFrame, schema: str, emit: Callable[[list[tuple], int, list, str, str], Iterator[tuple]]) -> DataFrame:
    """What ``emit`` makes of each block's ``members`` (tree, pos, n, digest, doc_id, replacement).

    ``above`` is (tree, block, path, subroot, root), one row for each block, which comes
    before its members: one row for many, so nothing is copied to every leaf.
    """
    none = F.lit(None)
    rows = members.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "n", "digest", "doc_id", "replacement", none.cast(_PATH).alias("path"), none.cast("string").alias("subroot"), none.cast("string").alias("root"))
    heads = above.select("tree", "block", F.lit(-1).cast("long").alias("pos"), none.cast("long").alias("n"), none.cast("string").alias("digest"), none.cast("long").alias("doc_id"), none.cast("string").alias("replacement"), "path", "subroot", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, *block in _blocks(batches):
            out.extend(emit(block, _lifts(block[0][3]), head[7], head[8], head[9]))
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return _by_block(rows.unionByName(heads), "pos").mapInArrow(run, schema)


def _paths(block: list[tuple], lifts: int, path: list[dict], subroot: str, root: str) -> Iterator[tuple]:
    """(tree, block, path, subroot, root) of each node: its siblings on the way up, then those of its block."""
    levels = [[r[4].encode() for r in block]]
    for _ in range(lifts):
        levels.append(parents(levels[-1])[0])
    for i, r in enumerate(block):
        own = []
        for k in range(lifts):
            left, right = siblings(levels[k], i // FANOUT**k)
            own.append({"left": left.decode(), "right": right.decode()})
        yield r[0], r[2], own + path, subroot, root


_ABOVE = f"tree string, block long, path {_PATH}, subroot string, root string"


def _folded(block: list[tuple], lifts: int, path: list[dict], subroot: str, root: str) -> Iterator[tuple]:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of each leaf.

    The states before all slots of the block's parents are kept; those of the path are made once.
    """
    levels, states = [[r[4].encode() for r in block]], []
    for _ in range(lifts):
        up, kept = parents(levels[-1])
        states.append(kept)
        levels.append(up)
    rights = [[siblings(level, i) for i in range(len(level))] for level in levels[:lifts]]
    way = [(hashlib.sha256(p["left"].encode()), p["right"].encode()) for p in path]
    rest = b"".join((p["left"] + p["right"]).encode() for p in path)
    over: dict[int, bytes] = {}  # what all leaves of a parent have behind their own siblings
    for i, r in enumerate(block):
        at = i // FANOUT
        if at not in over:
            over[at] = b"".join(b"".join(rights[k][i // FANOUT**k]) for k in range(1, lifts)) + rest
        proof = hashlib.sha256(b"".join(rights[0][i]) if lifts else b"")
        proof.update(over[at])
        node = (r[6] or r[4]).encode()
        steps = [(states[k][i // FANOUT**k], rights[k][i // FANOUT**k][1]) for k in range(lifts)]
        for state, right in (*steps, *way):
            h = state.copy()
            h.update(node + right)
            node = h.hexdigest().encode()
        yield r[5], r[4], subroot, root, proof.hexdigest(), node.decode()


def fold(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of (source, doc_id, leaf, replacement).

    ``leaf`` is a row's digest, from which the trees are made; ``replacement`` is another one
    to fold in its place among the original siblings, null for the leaf itself.  The result
    has the leaves' order within blocks only; files of the trees stay in the shared folder.
    """
    # one text for each source that keeps their order and is never null
    keyed = leaves.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), "replacement")
    members = _numbered(keyed, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc(), F.col("replacement").asc_nulls_first()])
    rounds = _rounds(members.select("tree", "pos", "n", "digest"))
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    sources = _numbered(subroots, "tree", [F.col("of").asc()])
    tops = _rounds(sources.select("tree", "pos", "n", "digest"))
    unnamed = {"doc_id": F.lit(None).cast("long"), "replacement": F.lit(None).cast("string")}

    def down(above: DataFrame, nodes: list[DataFrame]) -> DataFrame:
        """From the last round of a forest to what each block of its first one has above it."""
        for level in nodes[-2::-1]:
            above = _walked(level.withColumns(unnamed), above, _ABOVE, _paths)
        return above

    root = tops[-1].select("tree", F.col("pos").alias("block"), F.expr(f"cast(array() as {_PATH})").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    found = _walked(sources.withColumns(unnamed), down(root, tops), _ABOVE, _paths).select(F.col("block").alias("pos"), "path", "root")
    named = sources.select("pos", F.col("of").alias("tree"), F.col("digest").alias("subroot")).join(found, "pos").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    above = down(named, rounds)
    return _walked(members, above, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string", _folded)


def manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, roots and proof, and what folding a tampered copy of it gives.

    Tampering makes ASCII capitals of the text small where ``TAMPERED`` divides the checksum
    of the id; texts without capitals, null texts and null ids stay as they are and are
    verified.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    leaves = docs.select("source", "doc_id", leaf_of().alias("leaf"), F.when(hit, leaf_of(text=lowered)).alias("replacement"))
    return fold(leaves).withColumn("verified", F.col("folded_root") == F.col("root"))

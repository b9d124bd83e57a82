"""Operator 5: byte-level BPE by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one encoding, hence one last token.  An automaton
over the vocabulary lists, at each byte, the tokens that end there (longest first); the last
token of the prefix is the one whose predecessor prefix ends in a compatible token.  Two
neighbouring tokens are compatible if no merge across their seam would have been applied
before the pieces beside the seam were merged away.  Back-pointers give the ids.

Ids equal those of the ``tokenizers`` library with ``add_special_tokens=False``: strings of
added tokens that occur in a text become those tokens.  A null text counts as empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from marginalia.llm.shared import release, tidy
from marginalia.llm.units import UnitCache, UnitTable, picked, slices

# The byte-level pre-token pattern and the printable stand-ins of bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

NEVER = 1 << 60
START = 1 << 17  # stands before every pre-token; above all ids
CELLS = 1 << 20  # prefixes that are looked at together
LONG = 400  # bytes from which a pre-token goes alone
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_of_char() -> dict[str, int]:
    """Stand-in character -> byte: printable bytes stand for themselves, the others for 256, 257, ..."""
    kept = set(PRINTABLE)
    others = (b for b in range(256) if b not in kept)
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


class Memo:
    """Integer answers by integer key, one key for each slot: it only saves time."""

    def __init__(self, answer: Callable[[np.ndarray], np.ndarray], bits: int):
        self.answer, self.shift = answer, np.uint64(64 - bits)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != keys)
        if len(miss):
            new, place = np.unique(keys[miss], return_inverse=True)
            found = self.answer(new)
            slot = self._slot(new)
            self.key[slot], self.value[slot] = new, found
            out[miss] = found[place]
        return out


class PrefixEncoder:
    """The vocabulary of one tokenizer file, its automaton and the seam test.

    Many pre-tokens advance together, one byte a step, so that each step is a few array
    operations; a long one goes through the same tables alone.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without prefix space and normalizer are supported")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        to_byte = str.maketrans({c: chr(b) for c, b in byte_of_char().items()})
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids = {s: i for s, i in model["vocab"].items() if s not in self.added}
        self.token = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for s, i in ids.items():
            self.token[i] = s.translate(to_byte).encode("latin-1")
        self.size = np.array(list(map(len, self.token)), np.int64)
        own = {self.token[i]: i for i in ids.values()}
        for s, i in self.added.items():
            self.token[i] = s.encode()
        self._merges(ids, model["merges"])
        self._automaton(own)
        self.pattern = regex.compile(PRE_TOKEN)
        self.moves, self.seams = Memo(self._follow, 18), Memo(self._holds_pair, 19)

    def _merges(self, ids: dict[str, int], merges: list) -> None:
        """Rank of each pair; for each token the two halves it is made of and the rank of that merge (-1: a byte)."""
        pairs = np.array([[ids[x] for x in (m.split(" ") if isinstance(m, str) else m)] for m in merges], np.int64).reshape(-1, 2)
        whole = np.array([ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges], np.int64)
        keys = pairs[:, 0] << 17 | pairs[:, 1]
        order = np.argsort(keys)
        self.pair, self.rank = keys[order], order.astype(np.int64)
        self.born = np.full(len(self.token), -1, np.int64)
        self.left, self.right = np.zeros(len(self.token), np.int64), np.zeros(len(self.token), np.int64)
        made, first = np.unique(whole, return_index=True)  # the merge that comes first makes a token
        self.born[made], self.left[made], self.right[made] = first, pairs[first, 0], pairs[first, 1]
        holds = self._holds(pairs[first, 0], pairs[first, 1], first)
        sound = np.ones(len(self.token), bool)
        for k in np.argsort(first).tolist():  # halves come before the whole
            sound[made[k]] = holds[k] and sound[self.left[made[k]]] and sound[self.right[made[k]]]
        self.sound = sound  # tokens whose own bytes are encoded as this one token

    def _automaton(self, own: dict[bytes, int]) -> None:
        """Trie of the sound tokens by levels, with failure links.

        ``longest`` is the longest token that ends at a state, ``shorter`` the next one below a token.
        """
        words = sorted((w for w, i in own.items() if self.sound[i]), key=len, reverse=True)
        token = np.array([own[w] for w in words], np.int64)
        size = self.size[token]
        flat, start = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(size) - size
        at = np.zeros(len(words), np.int64)
        self.edge, self.child, states = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        levels = []
        for depth in range(int(size.max(initial=0))):
            m = int(np.count_nonzero(size > depth))  # a prefix, as the longest come first
            keys, place = np.unique(at[:m] << 8 | flat[start[:m] + depth], return_inverse=True)
            levels.append((states, keys, np.flatnonzero(size[:m] == depth + 1)))
            at[:m] = states + place
            self.edge, self.child = np.concatenate([self.edge, keys]), np.concatenate([self.child, np.arange(states, states + len(keys))])
            states += len(keys)
        order = np.argsort(self.edge)
        self.edge, self.child = self.edge[order], self.child[order]
        self.fail, self.longest = np.zeros(states, np.int64), np.full(states, -1, np.int64)
        self.shorter = np.full(len(self.token), -1, np.int64)
        for depth, (low, keys, ending) in enumerate(levels):
            here = np.arange(low, low + len(keys))
            if depth:
                self.fail[here] = self._follow(self.fail[keys >> 8] << 8 | keys & 255)
            below = self.longest[self.fail[here]]
            self.longest[here] = below
            self.longest[at[ending]] = token[ending]
            self.shorter[token[ending]] = below[at[ending] - low]

    def _follow(self, keys: np.ndarray) -> np.ndarray:
        """State after each (state, byte)."""
        at, byte, out = keys >> 8, keys & 255, np.zeros(len(keys), np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            wanted = at[rest] << 8 | byte[rest]
            k = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
            there = self.edge[k] == wanted
            out[rest[there]] = self.child[k[there]]
            rest = rest[~there & (at[rest] > 0)]
            at[rest] = self.fail[at[rest]]
        return out

    def _holds(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank below ``limit`` crosses the seam between two tokens.

        The pieces beside the seam are taken apart in the opposite order of their merges, so
        the two looked at are those that stand beside each other at one time.  Of two equal
        merges the left one is applied first.
        """
        x, y, a, b = left.copy(), right.copy(), limit.copy(), limit.copy()
        holds, rest = np.ones(len(x), bool), np.arange(len(x))
        while len(rest):
            p, q = x[rest], y[rest]
            wanted = p << 17 | q
            k = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
            rank = np.where(self.pair[k] == wanted, self.rank[k], NEVER)
            crossed = (rank < a[rest]) & (rank <= b[rest])
            holds[rest[crossed]] = False
            u, v = self.born[p], self.born[q]
            first = u > v
            some = rest[first]
            a[some], x[some] = u[first], self.right[p[first]]
            second = ~first & (v >= 0)
            some = rest[second]
            b[some], y[some] = v[second], self.left[q[second]]
            rest = rest[~crossed & (first | second)]
        return holds

    def _holds_pair(self, keys: np.ndarray) -> np.ndarray:
        left, out = keys >> 17, np.ones(len(keys), np.int32)
        inner = np.flatnonzero(left != START)
        out[inner] = self._holds(left[inner], keys[inner] & (START - 1), np.full(len(inner), NEVER))
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one array, and how many each has."""
        coded = [p.encode() for p in pieces]
        size = np.array(list(map(len, coded)), np.int64)
        order = np.argsort(-size, kind="stable")
        parts, counts, at = [], [np.zeros(0, np.int64)], 0
        while at < len(order):
            longest = int(size[order[at]])
            if longest > LONG:
                parts.append(self._alone(coded[order[at]]))
                counts.append(np.array([len(parts[-1])]))
                at += 1
                continue
            some = [coded[k] for k in order[at : at + max(1, CELLS // (longest + 1))].tolist()]
            ids, n = self._together(some)
            parts.append(ids)
            counts.append(n)
            at += len(some)
        ids, counted = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(counts)
        back = np.argsort(order, kind="stable")
        return picked(ids, counted, back), counted[back]

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The last token of every prefix of all pieces (longest first), then back-pointers."""
        n, size = len(pieces), np.array(list(map(len, pieces)), np.int64)
        flat, start = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(size) - size
        last = np.full((int(size.max(initial=0)) + 1, n), START, np.int64)
        at = np.zeros(n, np.int64)
        for k in range(len(last) - 1):
            m = int(np.count_nonzero(size > k))
            at = self.moves(at[:m] << 8 | flat[start[:m] + k]).astype(np.int64)
            token, rows = self.longest[at], np.arange(m)
            while len(rows):
                before = last[k + 1 - self.size[token[rows]], rows]
                rows = rows[self.seams(before << 17 | token[rows]) == 0]
                token[rows] = self.shorter[token[rows]]
            last[k + 1, :m] = token
        left, rows, found = size.copy(), np.flatnonzero(size), []
        count = np.zeros(n, np.int64)
        while len(rows):
            token = last[left[rows], rows]
            found.append((rows, token))
            count[rows] += 1
            left[rows] -= self.size[token]
            rows = rows[left[rows] > 0]
        ends = np.cumsum(count)
        ids = np.zeros(int(count.sum()), np.uint32)
        for k, (rows, token) in enumerate(found):
            ids[ends[rows] - 1 - k] = token
        return ids, count

    def _alone(self, piece: bytes) -> np.ndarray:
        """The same for one long pre-token."""
        move = UnitCache(lambda key: int(self._follow(np.array([key]))[0]), 20_000)
        seam = UnitCache(lambda key: bool(self._holds_pair(np.array([key]))[0]), 20_000)
        longest, shorter, size = self.longest, self.shorter, self.size
        last, at, n = [START], 0, 0
        for b in piece:
            n += 1
            at = move[at << 8 | b]
            t = int(longest[at])
            while not seam[last[n - int(size[t])] << 17 | t]:
                t = int(shorter[t])
            last.append(t)
        out = []
        while n:
            out.append(last[n])
            n -= int(size[last[n]])
        return np.array(out[::-1], np.uint32)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens in one array, and how many each has."""
        split = list(map(self.pattern.findall, units))
        pieces: dict[str, int] = {}
        place = [pieces.setdefault(p, len(pieces)) for found in split for p in found]
        ids, counts = self.encode_pieces(list(pieces))
        place, pieces_of = np.array(place, np.int64), np.array(list(map(len, split)), np.int64)
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[place])])
        return picked(ids, counts, place), np.diff(before[np.concatenate([np.zeros(1, np.int64), np.cumsum(pieces_of)])])

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", errors="replace")


class TextEncoder:
    """Encodes and decodes whole texts; units seen lately are looked up."""

    def __init__(self, path: str, limit: int = 200_000):
        self.core = PrefixEncoder(path)
        self.table = UnitTable(self.core.encode_units, self.core.added, limit)

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive slices of the texts, and the bounds of each text's ids; a null text has none."""
        return map(self.table.encode_texts, slices(texts))

    def encode(self, text: str | None) -> np.ndarray:
        return self.table.encode_texts([text or ""])[0]

    def decode(self, ids) -> str | None:
        return None if ids is None else self.core.decode(ids)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and the text decoded from them.

    Columns named ``ids_col`` or ``decoded_col`` are replaced, all others kept.  Null and
    empty texts give no ids and an empty text; an empty table gives an empty table.  Each
    row stands alone: no shuffle, and a lost task is redone from its own rows.  Results
    leave the worker in small slices, so its memory does not grow with Arrow's batches.
    """
    kept = docs.drop(ids_col, decoded_col)
    place, names = kept.columns.index(text_col), [*kept.columns, ids_col, decoded_col]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TextEncoder(path)  # for this task only: tasks take turns over all idle workers, which would each keep one
        for batch in batches:
            at = 0
            for values, bounds in enc.encode_all(batch.column(place)):
                part = batch.slice(at, len(bounds) - 1)
                at += len(bounds) - 1
                listed = values.tolist()
                decoded = [enc.decode(listed[a:b]) for a, b in pairwise(bounds.tolist())]
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(decoded, pa.string())], names)
            release()

    schema = StructType([*kept.schema.fields, StructField(ids_col, ArrayType(IntegerType())), StructField(decoded_col, StringType())])
    return kept.mapInArrow(tidy(coded), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = encode_decode(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

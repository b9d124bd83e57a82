"""Cutting texts into units whose byte-level BPE encodings stand alone.

A byte-level pre-tokenizer attaches a single space to the word behind it, so a text may be
cut before every space that has a non-space character on both sides: no token crosses such
a cut and nothing before it changes what follows.  Texts repeat their units often, so a
worker keeps the encodings of recent units and encodes a slice of texts by looking its units
up, all together: units are intervals of the slice's bytes, known by a hash and compared byte
for byte with what the table holds.  The table is bounded and only saves time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 400_000  # characters that are looked up together, about
_END = 0xFF  # between stretches; no byte of UTF-8
_FIRST, _INNER, _SPECIAL = 0, 1, 2
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def slices(texts: list[str | None] | pa.Array) -> Iterator[list[str]]:
    """Consecutive parts of about ``SLICE`` characters, one text at least; null texts are empty.

    Of an Arrow array only a few texts are Python strings at one time.
    """
    part: list[str] = []
    size = 0
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        for text in some if isinstance(some, list) else some.to_pylist():
            part.append(text or "")
            size += len(part[-1])
            if size >= SLICE:
                yield part
                part, size = [], 0
    if part:
        yield part


def picked(ids: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Ids of the items ``which``, one after the other, of ids that lie item after item."""
    each = counts[which]
    start, ends = (np.cumsum(counts) - counts)[which], np.cumsum(each)
    return ids[np.repeat(start - ends + each, each) + np.arange(int(each.sum()))]


def _gaps(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space or end a stretch."""
    gap = _GAP[raw]
    lead = np.flatnonzero(_LEAD[raw])
    if len(lead):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.int32)
        two = padded[lead] << 8 | padded[lead + 1]
        three = two << 8 | padded[lead + 2]
        for found, size in ((lead[np.isin(two, _SPACES[2])], 2), (lead[np.isin(three, _SPACES[3])], 3)):
            for k in range(size):
                gap[found + k] = True
    return gap


# White space as str.isspace() has it, by the length of its UTF-8.
_SPACES = {n: np.array([int.from_bytes(chr(c).encode(), "big") for c in range(1 << 16) if chr(c).isspace() and len(chr(c).encode()) == n]) for n in (1, 2, 3)}
_GAP, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_GAP[_SPACES[1]] = _GAP[_END] = True
_LEAD[_SPACES[2] >> 8] = _LEAD[_SPACES[3] >> 16] = True


class UnitTable:
    """Encodings of the units seen lately, at most ``limit`` and those of one slice.

    ``encode(units)`` gives the ids of all units in one array, and how many each has.
    ``added`` are special tokens' strings and ids: each becomes its id wherever it occurs.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int], limit: int):
        self.encode, self.added, self.limit = encode, added, limit
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.base = 0x9E3779B97F4A7C15
        self.bits = (2 * limit).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.at = np.zeros(1 << self.bits, np.int32)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.ids_end, self.raw_end = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.up, self.down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _grow(self) -> None:
        held = np.flatnonzero(self.key)
        key, at = self.key[held], self.at[held]
        self.bits += 1
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self._insert(key, at)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, key: np.ndarray) -> np.ndarray:
        """Number of each unit in the table, -1 if it has none; slots are probed one after the other."""
        out, slot, rest, mask = np.full(len(key), -1, np.int64), self._slot(key), np.arange(len(key)), len(self.key) - 1
        while len(rest):
            here = self.key[slot]
            same = here == key[rest]
            out[rest[same]] = self.at[slot[same]]
            on = ~same & (here != 0)
            rest, slot = rest[on], slot[on] + 1 & mask
        return out

    def _insert(self, key: np.ndarray, at: np.ndarray) -> None:
        slot, mask = self._slot(key), len(self.key) - 1
        while len(key):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[free]
            won = self.key[slot] == key
            self.at[slot[won]] = at[won]
            key, at, slot = key[~won], at[~won], slot[~won] + 1 & mask

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                table = np.full(max(n, SLICE + SLICE // 4), base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text's."""
        stretches, kinds, first_of = [], [], []
        for text in texts:
            first_of.append(len(stretches))
            if self.special is None or not self.special.search(text):
                stretches.append(text.encode())
                kinds.append(_FIRST)
                continue
            for k, x in enumerate(self.special.split(text)):
                if x or not k:
                    stretches.append(x.encode())
                    kinds.append(_SPECIAL if k % 2 else _FIRST)
        while True:  # until no two units share a hash
            found = self._numbers(stretches, np.array(kinds, np.int64))
            if found is not None:
                break
            self.base = self.base * 5 + 2 & (1 << 64) - 1 | 1
            self._clear()
        number, unit_of = found
        counts = np.diff(self.ids_end)
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[number])])
        return picked(self.ids, counts, number), before[np.append(unit_of[first_of], len(number)) if first_of else np.zeros(1, np.int64)]

    def _numbers(self, stretches: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Table numbers of all units in order, and the first unit of each stretch; None if a hash stands for two units."""
        joined = b"\xff".join([*stretches, b""])
        raw = np.frombuffer(joined, np.uint8)
        size = np.array(list(map(len, stretches)), np.int64)
        start_of = np.cumsum(size + 1) - size - 1
        gap = _gaps(raw)
        space = np.flatnonzero(raw == 0x20)
        space = space[~(gap[space - 1] | gap[space + 1])]
        if (kinds == _SPECIAL).any():
            space = space[kinds[np.searchsorted(start_of, space, side="right") - 1] != _SPECIAL]
        start = np.concatenate([start_of, space])
        order = np.argsort(start, kind="stable")
        start, kind = start[order], np.concatenate([kinds, np.full(len(space), _INNER)])[order]
        end = np.append(start[1:], len(raw))
        end[np.append(kind[1:], _FIRST) != _INNER] -= 1
        self._powers(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64)])
        key = (sums[end] - sums[start]) * self.down[np.minimum(start, len(raw) - 1)]
        key = (key ^ ((end - start) * 4 + kind).astype(np.uint64) * _Q) * np.uint64(self.base)
        key ^= key >> np.uint64(32)
        key = np.maximum(key * _Q, np.uint64(1))
        if len(self.ids_end) > self.limit:
            self._clear()
            self._powers(len(raw))
        number = self._look(key)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, one = np.unique(key[miss], return_index=True)
            one = miss[one]
            self._add(new, [joined[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)], kind[one] == _SPECIAL)
            number[miss] = self._look(key[miss])
        length = end - start
        if not np.array_equal(length, self.raw_end[number + 1] - self.raw_end[number]):
            return None
        held = np.flatnonzero(raw != _END)
        if not np.array_equal(self.raw[held + np.repeat(self.raw_end[number] - start, length)], raw[held]):
            return None
        return number, np.flatnonzero(kind != _INNER)

    def _add(self, key: np.ndarray, units: list[bytes], special: np.ndarray) -> None:
        ids, counts = self.encode([u.decode() for u, s in zip(units, special.tolist(), strict=True) if not s])
        if special.any():
            all_counts, out = np.ones(len(units), np.int64), np.zeros(len(ids) + int(special.sum()), np.uint32)
            all_counts[~special] = counts
            ends = np.cumsum(all_counts)
            mine = np.zeros(len(out), bool)
            mine[ends[special] - 1] = True
            out[mine], out[~mine] = [self.added[units[k].decode()] for k in np.flatnonzero(special)], ids
            ids, counts = out, all_counts
        first = len(self.ids_end) - 1
        while 2 * (first + len(key)) > len(self.key):
            self._grow()
        self._insert(key, np.arange(first, first + len(key), dtype=np.int32))
        self.ids_end = np.concatenate([self.ids_end, self.ids_end[-1] + np.cumsum(counts)])
        self.raw_end = np.concatenate([self.raw_end, self.raw_end[-1] + np.cumsum(np.array(list(map(len, units)), np.int64))])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(units), np.uint8)])


class UnitCache(dict):
    """Word -> value, at most ``2 * limit`` words: when the young half is full it becomes the old half."""

    def __init__(self, encode: Callable[[str], object], limit: int = 100_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, unit: str):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(unit)
        if found is None:
            found = self.encode(unit)
        self[unit] = found
        return found

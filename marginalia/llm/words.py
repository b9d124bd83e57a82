"""Words of many texts at once, as arrays: where they are and a 64-bit hash of each.

A word is a run of bytes other than ASCII white space (space, tab to carriage return), which
is ``[^\\x20\\x09-\\x0D]+`` of the text.  A word's hash is a polynomial of its bytes, taken from
running sums over all texts, and so needs no work for each word in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... (n of them, one at least), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray, salt) -> np.ndarray:
    """Spread the bits of hashes, together with a small number."""
    h = (h ^ (np.asarray(salt).astype(np.uint64) * Q)) * P
    h ^= h >> np.uint64(31)
    h *= Q
    return h ^ (h >> np.uint64(29))


_HELD: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _byte_powers(n: int) -> list[np.ndarray]:
    """Powers of ``P`` and of its inverse; those of usual slices stay in the worker."""
    if len(_HELD[0]) >= n:
        return _HELD
    made = [powers(P, max(n, 1 << 19)), powers(P_INV, max(n, 1 << 19))]
    if n <= 1 << 20:
        _HELD[:] = made
    return made


class Words:
    """``raw`` has the bytes of all texts, a line break after each; word k is raw[start[k]:end[k]].

    ``text`` is the number of a word's text, ``hash`` its 64-bit hash, never 0; ``bounds[t]``
    is the first word of text t.  With ``lower`` A-Z count as a-z.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        coded = [(t or "").encode() for t in texts]
        self.joined = b"\n".join([*coded, b""])
        if lower:
            self.joined = self.joined.lower()
        self.raw = np.frombuffer(self.joined, np.uint8)
        size = np.array(list(map(len, coded)), np.int64) + 1
        self.text_end = np.cumsum(size)
        space = _SPACE[self.raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte is a space
        self.bounds = np.searchsorted(self.start, np.concatenate([np.zeros(1, np.int64), self.text_end]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        up, down = _byte_powers(len(self.raw))
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=sums[1:])
        self.hash = np.maximum(mix((sums[self.end] - sums[self.start]) * down[self.start], self.end - self.start), np.uint64(1))

    def word(self, k: int) -> bytes:
        return self.joined[self.start[k] : self.end[k]]


class WordMemo:
    """An answer for each word: words seen lately are looked up by their hash, others asked for."""

    def __init__(self, answer: Callable[[bytes], float], bits: int = 19, kind=np.float64):
        self.answer, self.shift = answer, np.uint64(64 - bits)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, kind)

    def of(self, words: Words) -> np.ndarray:
        slot = (words.hash * P >> self.shift).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != words.hash)
        if len(miss):
            new, first, place = np.unique(words.hash[miss], return_index=True, return_inverse=True)
            spans = zip(words.start[miss[first]].tolist(), words.end[miss[first]].tolist(), strict=True)
            found = np.array([self.answer(words.joined[a:b]) for a, b in spans], self.value.dtype)
            slot = (new * P >> self.shift).astype(np.int64)
            self.key[slot], self.value[slot] = new, found
            out[miss] = found[place]
        return out


class Recent:
    """Which hashes came lately: one for each slot, so it may forget but never errs."""

    def __init__(self, bits: int = 17):
        self.shift, self.held = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Mask of the first of each distinct hash that is not held; all are held from now on."""
        if not len(h):
            return np.zeros(0, bool)
        first = np.zeros(len(h), bool)
        first[np.unique(h, return_index=True)[1]] = True
        slot = (h * P >> self.shift).astype(np.int64)
        first &= self.held[slot] != h
        self.held[slot] = h
        return first

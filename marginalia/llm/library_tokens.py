"""Texts encoded by the ``tokenizers`` library, unit by unit.

The library is asked only for units that a worker has not seen lately.  Many such units go
to it as one text: each starts with the only space it has, so the tokens that start with a
space show where units begin.  The ids of a text are its units' joined.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from marginalia.llm.units import UnitTable, picked, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

JOINED = 40  # units of one text that the library gets


class LibraryEncoder:
    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        names = dict(spec["model"]["vocab"])  # one stand-in character for each byte
        self.size = np.zeros(1 + max([*names.values(), *self.added.values()]), np.int64)
        self.size[list(names.values())] = list(map(len, names))
        self.leads = np.zeros(len(self.size), bool)
        self.leads[[i for name, i in names.items() if name[0] == "\u0120"]] = True
        for name, i in self.added.items():
            self.size[i], self.leads[i] = len(name.encode()), False
        self.joins = not any(" " in name for name in self.added)  # else two units may make a special token
        self.table = UnitTable(self._ids, self.added, limit)

    def _ask(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and how many each has."""
        joins = np.array([self.joins and u[:1] == " " and " " not in u[1:] and not u[-1].isspace() for u in units], bool)
        plain, other = np.flatnonzero(joins), np.flatnonzero(~joins)
        parts = [np.zeros(0, np.uint32)]
        for at in range(0, len(plain), 20_000):
            some = [units[k] for k in plain[at : at + 20_000].tolist()]
            parts.extend(self._ask(["".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)]))
        ids = np.concatenate(parts)
        counts = np.diff(np.append(np.flatnonzero(self.leads[ids]), len(ids)))
        apart = self._ask([units[k] for k in other.tolist()])
        ids, counts = np.concatenate([ids, *apart]), np.concatenate([counts, np.array(list(map(len, apart)), np.int64)])
        back = np.argsort(np.concatenate([plain, other]))
        return picked(ids, counts, back), counts[back]

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive slices of the texts, and the bounds of each text's ids; a null text has none."""
        return map(self.table.encode_texts, slices(texts))

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Character span of each token of a text: one (start, end) row for each.

        A token that starts or ends inside a character has that whole character.
        """
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        if text.isascii():
            return np.stack([starts, ends], 1)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum(raw & 0xC0 != 0x80) - 1  # of each byte
        return np.stack([char[starts], char[ends - 1] + 1], 1)


@lru_cache(2)
def library(path: str) -> LibraryEncoder:
    """One encoder for each tokenizer file and Python worker."""
    return LibraryEncoder(path)

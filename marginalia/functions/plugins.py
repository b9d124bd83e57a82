"""Points where a user's own models are put in: registries of providers, embedders as columns, readers.

A provider is any object with an id and the methods of ``Provider``; its calls run inside
Arrow batches of the tasks, so it must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Provider(Protocol):
    id: str

    def chat(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Registry:
    """Providers by id; the first one registered is active until another is chosen."""

    def __init__(self):
        self._found: dict[str, Provider] = {}
        self._active: str | None = None

    def register(self, provider: Provider, activate: bool = False) -> None:
        self._found[provider.id] = provider
        if activate or self._active is None:
            self._active = provider.id

    def set_active(self, id_: str) -> None:
        if id_ not in self._found:
            raise KeyError(f"no provider {id_}")
        self._active = id_

    @property
    def active(self) -> Provider:
        if self._active is None:
            raise LookupError("no provider is registered")
        return self._found[self._active]

    def ids(self) -> list[str]:
        return list(self._found)


def answers(prompt: Column, provider: Provider) -> Column:
    """What a provider says to each prompt; null for null, and for a batch that fails each prompt alone is tried once more."""

    @F.arrow_udf("string")
    def said(prompts: pa.Array) -> pa.Array:
        return pa.array(_mapped(prompts.to_pylist(), provider.chat), pa.string())

    return said(prompt)


def _mapped(items: list, call: Callable[[list], Iterable]) -> list:
    there = [x for x in items if x is not None]
    try:
        found = list(call(there)) if there else []
    except Exception:  # one bad item shall not lose its batch
        found = []
        for x in there:
            try:
                found.extend(call([x]))
            except Exception:
                found.append(None)
    given = iter(found)
    return [None if x is None else next(given) for x in items]


def embeddings(text: Column, role: str, embed: Callable[[list[str]], list[list[float]]]) -> Column:
    """array<double> of unit length from a model: texts get the prefix of their role (query or passage).

    A model that gives a vector without numbers raises; null texts give null.
    """
    if role not in ("query", "passage"):
        raise ValueError(role)

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        found = iter(embed([f"{role}: {t}" for t in texts.to_pylist() if t is not None]))
        out = []
        for t in texts.to_pylist():
            v = None if t is None else np.asarray(next(found), float)
            if v is not None and not v.size:
                raise ValueError("the model gave an empty vector")
            norm = 0.0 if v is None else float(np.sqrt(v @ v))
            out.append(None if v is None else (v / norm if norm else v).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return vectors(text)


def tried_embeddings(text: Column, role: str, embed: Callable[[list[str]], list[list[float]]]) -> Column:
    """``embeddings``, but null where the model fails: a batch that fails is tried text by text."""
    if role not in ("query", "passage"):
        raise ValueError(role)

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        out = []
        for v in _mapped([None if t is None else f"{role}: {t}" for t in texts.to_pylist()], embed):
            v = np.asarray([] if v is None else v, float)
            norm = float(np.sqrt(v @ v))
            out.append((v / norm if norm else v).tolist() if v.size else None)
        return pa.array(out, pa.list_(pa.float64()))

    return vectors(text)

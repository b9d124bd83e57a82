"""Operator 2: tokens of whole documents attributed to their sections by character spans.

A document is encoded once, so its tokens are those a model would see.  Sections are given
as character intervals; by default the lines of the text, each with its line break.  A token
belongs to the section that holds most of its characters, to the earlier one on a tie.  A
token without characters of its own (a byte inside a character) has that character's span.
Every token goes to exactly one section of a partition of the text, so counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.library_tokens import library


def line_starts(text: str) -> np.ndarray:
    """First characters of the lines of a text; a break at the very end starts no further line."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return np.array(starts, np.int64)


def attribute(spans: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of each section; sections cover [0, length) and ``starts`` ascend from 0."""
    k = len(starts)
    if not len(spans):
        return np.zeros(k, np.int64), np.zeros(k, np.int64)
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    owner, ends = first.copy(), np.append(starts[1:], length)
    across = np.flatnonzero(first != last)
    for t in across:  # few: only tokens of line breaks and the like
        s, e = spans[t]
        sections = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[sections], e) - np.maximum(starts[sections], s)
        owner[t] = sections[int(np.argmax(share))]
    return np.bincount(owner, minlength=k), np.bincount(owner[across], minlength=k)


def count_by_section(docs: DataFrame, path: str) -> DataFrame:
    """One row for each line of each document: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing, doc_tokens.

    A null or empty text has one empty section without tokens.  Rows with equal or null
    doc_ids are counted each for itself; other columns are not read.  No shuffle: both sides
    of the interval join come from the same row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library(path)
        for batch in batches:
            at = 0
            for flat, bounds in enc.encode_all(batch.column(1)):
                some = batch.slice(at, len(bounds) - 1)
                at += len(bounds) - 1
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                texts = [t or "" for t in some.column(1).to_pylist()]
                for text, ids in zip(texts, np.split(flat, bounds[1:-1]), strict=True):
                    spans = enc.spans(text, ids)
                    starts = line_starts(text)
                    n, crossing = attribute(spans, starts, len(text))
                    k = len(starts)
                    for c, v in zip(cols, (np.arange(k), starts, np.append(starts[1:], len(text)), n, crossing, np.full(k, len(spans))), strict=True):
                        c.append(v)
                ids = some.column(0).take(pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in cols[0]])))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.concatenate(cols[0]).astype(np.int32)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols[1:])],
                    ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long")

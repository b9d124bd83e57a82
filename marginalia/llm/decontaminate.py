"""Operator 4: documents that hold test items, by common n-grams and local alignment.

Items and documents are sequences of lower-cased words without outer punctuation.  Seeds are
every n-gram of an item and every n-gram with a gap in it (``SEEDS``), however many documents
have them: copies of an item make all of its n-grams frequent, and an edited copy may have any
of them left.  An item of fewer words than a seed is one seed itself.  Where a document has a
seed, its words around the seed's diagonal are aligned with the item (Smith-Waterman on
words: ``MATCH``, ``MISMATCH``, ``GAP``), unless they have too few of the item's words for the
score that it takes.  The alignment's score over that of the whole item is 1 for an exact copy
and falls with every edit; a document holds an item from ``SIMILAR`` on.

Texts are cut into words once for each block of items: documents that have any seed are kept
in the shared directory as word numbers (0: a word of no item), and the search reads only
these.  Items are taken in blocks of about ``BLOCK`` against all documents, so what is sent to
the workers is bounded; how many blocks there are changes nothing.  Null and empty items and
texts match nothing; an item given twice under one id counts once, with its best score.  Rows
that share a doc_id, or have none, are matched each for itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import stored, tidy
from marginalia.llm.units import slices
from marginalia.llm.words import WordMemo, Words, mix

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SIMILAR = 0.5
SEEDS = ((0, 1, 2), (0, 1, 3))  # the second also fits where every third word is edited
BLOCK = 20_000  # items
_EDGE = ".,;:!?\"'()[]{}«»“”„‘’…–—-".encode()


def words(text: str | None) -> list[bytes]:
    """Words without outer punctuation; those of punctuation alone are left out."""
    return [s for w in (text or "").encode().lower().split() if (s := w.strip(_EDGE))]


class Items:
    """One block of items: word numbers from 1, and the places of each seed."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in rows:
            found = words(text)
            if found:
                self.items.append((item, np.array([self.number.setdefault(w, len(self.number) + 1) for w in found], np.int64)))
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, seq) in enumerate(self.items):
            for seed in SEEDS if len(seq) >= N else [tuple(range(len(seq)))]:
                found = codes(seq, seed)
                for at, code in enumerate(found.tolist()):
                    self.places[code].append((k, at))
        self.known = np.array(sorted(self.places), np.int64)
        self.seeds = [*SEEDS, *{tuple(range(len(seq))) for _, seq in self.items if len(seq) < N}]


def codes(seq: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at a seed's places from each word on; 0 where one is not of the items."""
    n = max(0, len(seq) - seed[-1])
    out, good = np.full(n, len(seed), np.uint64), np.ones(n, bool)
    for k in seed:
        part = seq[k : k + n]
        out = mix(out ^ part.astype(np.uint64), k)
        good &= part > 0
    return np.where(good, out.view(np.int64), 0)


def hits(seq: np.ndarray, items: Items) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seed the places where a known one starts, and their codes."""
    out = []
    for seed in items.seeds:
        found = codes(seq, seed)
        at = np.flatnonzero(found)
        if len(at) and len(items.known):
            k = np.minimum(np.searchsorted(items.known, found[at]), len(items.known) - 1)
            at = at[items.known[k] == found[at]]
            out.append((at, found[at]))
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local alignment of an item in a window: share of the item's full score, and the place where it ends."""
    step = np.arange(len(window) + 1) * GAP
    row = np.zeros(len(window) + 1)
    best, end = 0.0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, row[:-1] + np.where(window == w, MATCH, MISMATCH))
        new[1:] = np.maximum(new[1:], row[1:] + GAP)
        row = np.maximum.accumulate(new - step) + step  # gaps along the window
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best / (MATCH * len(item)), end


def matches(seq: np.ndarray, items: Items) -> list[tuple[int, float, int]]:
    """(item, score, word after the alignment's end) of the items that the document holds."""
    diagonals: dict[int, list[int]] = defaultdict(list)
    for places, found in hits(seq, items):
        for at, code in zip(places.tolist(), found.tolist(), strict=True):
            for k, place in items.places[code]:
                diagonals[k].append(at - place)
    out: dict[int, tuple[float, int]] = {}
    here = np.zeros(len(items.number) + 1, bool)
    here[seq] = True
    for k, starts in diagonals.items():
        item, item_words = items.items[k]
        least = SIMILAR * len(item_words)  # matches that the score takes without any penalty
        if np.count_nonzero(here[item_words]) < least:
            continue
        pad = len(item_words) // 2 + 2
        starts.sort()
        group = [starts[0]]
        for d in [*starts[1:], None]:
            if d is not None and d - group[-1] <= pad:
                group.append(d)
                continue
            low, high = max(0, group[0] - pad), group[-1] + len(item_words) + pad
            near = set(seq[low:high].tolist())
            if sum(map(near.__contains__, item_words.tolist())) >= least:
                score, end = align(item_words, seq[low:high])
                if score >= SIMILAR and score > out.get(item, (0.0, 0))[0]:
                    out[item] = (score, low + end)
            group = [d] if d is not None else []
    return [(i, s, e) for i, (s, e) in out.items()]


def _memo(items: Items) -> WordMemo:
    """Numbers of words; -1 for tokens that are punctuation alone and are taken out."""

    def number(token: bytes) -> int:
        w = token.strip(_EDGE)
        return items.number.get(w, 0) if w else -1

    return WordMemo(number, kind=np.int64)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score and end_word of every document that holds a test item: a row for each row of ``docs`` and item."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    tests = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-tests.count() // BLOCK))
    out = None
    for k in range(blocks):  # all texts of an item are in one block, so blocks do not meet
        part = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()  # about BLOCK rows
        found = _find_block(spark, rows, [(r.item_id, r.text) for r in part])
        out = found if out is None else out.unionByName(found)
    return out


def _find_block(spark, docs: DataFrame, tests: list[tuple[int, str]]) -> DataFrame:
    items = Items(tests)
    sent = spark.sparkContext.broadcast(items)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word numbers of documents with known seeds."""
        memo = _memo(sent.value)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                found = Words(part, lower=True)
                seq = memo.of(found)
                kept = seq >= 0
                seq, text = seq[kept], found.text[kept]
                # a seed may reach into the next text here; the search looks at each text alone
                some = np.unique(np.concatenate([text[places] for places, _ in hits(seq, sent.value)] or [text[:0]]))
                low, high = np.searchsorted(text, some), np.searchsorted(text, some, side="right")
                raw = [seq[a:b].astype("<i4").tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + at)), pa.array(raw, pa.binary())], ["doc_id", "words"])
                at += len(part)

    numbered = stored(docs.mapInArrow(tidy(number), "doc_id long, words binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i, raw in enumerate(batch.column(1)):
                for m in matches(np.frombuffer(raw.as_buffer(), "<i4").astype(np.int64), sent.value):
                    owner.append(i)
                    found.append(m)
            if found:
                item, score, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "end_word"])

    return numbered.mapInArrow(tidy(search), "doc_id long, item_id long, score double, end_word long")

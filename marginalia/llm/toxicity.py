"""Operator 3: toxicity by Levenshtein automata over a trie of learned terms.

Fit, on a bounded sample of labelled rows (``SAMPLE``): terms are words, and stems that
start several different words, which toxic documents hold and others hardly ever do.  They
form one trie.  The automaton of a word accepts what is within one edit of it; walked
together with the trie it finds the terms that the word may be a misspelling of.  A window
around each find tells quotation (quotation marks, words of reporting or naming) from abuse
and lowers its weight.  A logistic curve over the summed weights, fitted on the same sample,
is the score.  Only texts are inputs of a score.

Null and empty texts have no finds and get the score of such texts.  Without labelled rows
there are no terms and every score is 0.  Rows that share a doc_id, or have none, are scored
each for itself; a null or repeated doc_id among the labels counts for no row or once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marginalia.llm.shared import stored, tidy
from marginalia.llm.units import slices
from marginalia.llm.words import WordMemo, Words

SAMPLE = 20_000  # labelled rows that the terms and the curve are fitted on, at most
MIN_DOCS = 6  # toxic sample documents that hold a term, at least
RATIO = 25.0  # times that a term is more frequent in toxic documents, at least
FUZZY_FROM = 5  # letters from which a term also matches with one edit
STEMS = (4, 5, 6, 7)  # lengths of stems
CROWD = 3  # innocent neighbours from which a term matches without edits only
WINDOW = 4  # tokens beside a find
W_FUZZY, W_QUOTED = 0.8, 0.25

_PIECE = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = re.compile(r"^[\"“«„‘'‹(\[]*[\"“«„‘'‹]"), re.compile(r"[\"”»“’'›][.,;:!?)\]]*$")
# Words that report or name what others say (English, German, French, Spanish).
REPORTING = frozenset("said says called calls quote quoted quotes word words term wrote insult reported sagte genannt wort zitat nannte dit appelé mot cité citation dijo llamó palabra cita".split())


@dataclass(frozen=True)
class ToxicityModel:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    fuzzy: tuple[str, ...]  # words that also match with one edit
    innocent: frozenset[str]  # words within an edit of a term that other documents use
    bias: float
    slope: float


class Trie:
    """Terms by letters; ``end`` marks a word's last node, ``stem`` a stem's, ``soft`` that of a word open to edits."""

    def __init__(self, words, stems, fuzzy):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.soft: list[bool] = [False]
        for term, marks in [*((w, self.end) for w in words), *((s, self.stem) for s in stems), *((w, self.soft) for w in fuzzy)]:
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(False)
                    self.stem.append(False)
                    self.soft.append(False)
                at = self.next[at][c]
            marks[at] = True

    def exact(self, word: str) -> bool:
        at = 0
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                return False
            if self.stem[at]:
                return True
        return self.end[at]

    def near(self, word: str) -> bool:
        """Whether a word open to edits is one edit away: automaton and trie are walked together.

        Bit i of a state set: i letters of ``word`` are read; ``clean`` without, ``one`` with one edit.
        """
        if len(word) < FUZZY_FROM - 1:
            return False
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        final = 1 << len(word)
        stack = [(0, 1, 2)]  # an edit may drop the first letter of the word
        while stack:
            at, clean, one = stack.pop()
            for c, child in self.next[at].items():
                here = places.get(c, 0)
                clean2 = (clean & here) << 1
                one2 = (one & here) << 1 | clean | clean << 1 | clean2 << 1
                if self.soft[child] and one2 & final:
                    return True
                if clean2 or one2:
                    stack.append((child, clean2, one2))
        return False


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.trie = model, Trie(model.words, model.stems, model.fuzzy)
        self.memo = WordMemo(lambda word: self.weight(word.decode()))

    def weight(self, token: str) -> float:
        best = 0.0
        for piece in _PIECE.findall(token.lower()):
            if self.trie.exact(piece):
                return 1.0
            if piece not in self.model.innocent and self.trie.near(piece):
                best = W_FUZZY
        return best

    def evidences(self, texts: list[str | None]) -> np.ndarray:
        """Summed weights of the finds of each text; quoted ones count less."""
        words = Words(texts)
        weights = self.memo.of(words)
        total = np.zeros(len(texts))
        for k in np.flatnonzero(weights).tolist():
            t = words.text[k]
            low, high = max(words.bounds[t], k - WINDOW), min(words.bounds[t + 1], k + WINDOW + 1)
            window = [words.word(i).decode() for i in range(low, high)]
            total[t] += weights[k] * (W_QUOTED if quoted(window, k - low) else 1.0)
        return total

    def evidence(self, text: str | None) -> float:
        return float(self.evidences([text])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.words and not self.model.stems:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.model.bias + self.model.slope * np.log1p(self.evidences(texts)))))


def quoted(window: list[str], k: int) -> bool:
    """Whether the window shows its token k as quotation: marks around it, or a reporting word near it with a mark."""
    opened = any(_OPEN.search(t) for t in window[: k + 1])
    closed = any(_CLOSE.search(t) for t in window[k:])
    reported = any(t.lower().strip(".,;:!?\"'") in REPORTING for t in window)
    return (opened and closed) or (reported and (opened or closed))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most ``SAMPLE`` training rows: those least in the order of a hash of doc_id."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most SAMPLE rows


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each word, stem (marked by *) and any (the empty form)."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pieces = set(_PIECE.findall((text or "").lower()))
            forms = pieces | {p[:n] + "*" for p in pieces for n in STEMS if len(p) > n}
            seen[1 if toxic else 0].update(forms)
            seen[1 if toxic else 0][""] += 1
    forms = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(forms), 50_000):
        part = forms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())], ["form", "toxic", "other"])


def _contexts(batches: Iterator[pa.RecordBatch], forms: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Neighbouring words of each form in toxic documents: copies of one document show a form in one context only."""
    for batch in batches:
        seen = set()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pieces = ["", *_PIECE.findall((text or "").lower()), ""] if toxic else []
            for before, p, after in zip(pieces, pieces[1:], pieces[2:], strict=False):
                for f in (p, *(p[:n] + "*" for n in STEMS if len(p) > n)):
                    if f in forms:
                        seen.add((f, f"{before} {after}"))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], ["form", "context"])


def _terms(forms: list[tuple[str, int, int]], n_toxic: int, n_other: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and stems that are ``RATIO`` times as frequent in toxic documents."""
    telling = {f: t for f, t, o in forms if f and t >= MIN_DOCS and t * (n_other + 1.0) >= RATIO * (o + 0.5) * n_toxic}
    stems = {f[:-1]: t for f, t in telling.items() if f[-1] == "*"}
    words = {f: t for f, t in telling.items() if f[-1] != "*"}
    # a stem must say more than the words that begin with it, and more than its own longer form
    stems = {s: t for s, t in stems.items() if all(w_t < 0.7 * t for w, w_t in words.items() if w.startswith(s))}
    stems = {s: t for s, t in stems.items() if not any(x != s and x.startswith(s) and x_t >= 0.9 * t for x, x_t in stems.items())}
    stems = {s: t for s, t in stems.items() if not any(x != s and s.startswith(x) for x in stems)}
    return tuple(sorted(w for w in words if not any(w.startswith(s) for s in stems))), tuple(sorted(stems))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn terms and curve; what reaches the driver is bounded by ``SAMPLE``."""
    sample = stored(_sample(docs, labels))  # read four times
    counts = sample.mapInArrow(tidy(_count_forms), "form string, toxic long, other long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # the empty form comes along: it has the numbers of documents
    found = [tuple(r) for r in counts.where((F.col("form") == "") | ((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") * 4 >= F.col("other")))).collect()]
    n_toxic, n_other = next(((t, o) for f, t, o in found if f == ""), (0, 0))
    if not n_toxic or not n_other:
        return ToxicityModel((), (), (), frozenset(), 0.0, 0.0)
    forms = frozenset(f for f, t, o in found if f and t * (n_other + 1.0) >= RATIO * (o + 0.5) * n_toxic)
    contexts = sample.mapInArrow(tidy(lambda b: _contexts(b, forms)), "form string, context string").distinct().groupBy("form").count()
    varied = {r.form for r in contexts.where(F.col("count") >= MIN_DOCS).collect()}
    words, stems = _terms([x for x in found if x[0] in varied], n_toxic, n_other)
    fuzzy = tuple(w for w in words if len(w) >= FUZZY_FROM)
    trial = ToxicityModel(words, stems, fuzzy, frozenset(), 0.0, 1.0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(trial)
        for batch in batches:
            near: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not toxic:
                    near.update({p for t in set((text or "").split()) if 0 < scorer.weight(t) < 1 for p in _PIECE.findall(t.lower())})
            yield pa.RecordBatch.from_arrays([pa.array(list(near), pa.string()), pa.array(list(near.values()), pa.int64())], ["word", "n"])

    near = sample.mapInArrow(tidy(gather), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    innocent = frozenset(r.word for r in near.collect())
    # a term with several innocent neighbours lies among ordinary words: its edits say nothing
    single = {w: Trie((), (), (w,)) for w in fuzzy}
    fuzzy = tuple(w for w in fuzzy if sum(single[w].near(x) for x in innocent) < CROWD)
    model = ToxicityModel(words, stems, fuzzy, innocent, 0.0, 1.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.evidences(part).round(6) for part in slices(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0)])), batch.column(1)], ["x", "toxic"])

    rows = sample.mapInArrow(tidy(weigh), "x double, toxic int").groupBy("x", "toxic").count().collect()
    bias, slope = _curve([(np.log1p(r.x), r.toxic, r["count"]) for r in rows])
    return ToxicityModel(words, stems, fuzzy, innocent, bias, slope)


def _curve(rows: list[tuple[float, int, int]], ridge: float = 2.0) -> tuple[float, float]:
    """Logistic fit of one input by Newton steps; equal total weight for both classes, labels may be noisy."""
    x, y, n = (np.array(c, float) for c in zip(*sorted(rows), strict=True))
    n = n * np.where(y > 0, 0.5 / max(n[y > 0].sum(), 1), 0.5 / max(n[y <= 0].sum(), 1)) * 1000
    a = np.stack([np.ones_like(x), x], 1)
    w, hold = np.zeros(2), np.diag([1e-3, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + hold, a.T @ (n * (y - p)) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def with_scores(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1; a column of that name is replaced."""
    kept = docs.drop(name)
    place, names = kept.columns.index("text"), [*kept.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.scores(part) for part in slices(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*found, np.zeros(0)]))], names)

    return kept.mapInArrow(tidy(run), StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return with_scores(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

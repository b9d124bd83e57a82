"""Operator 8: quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a document when one measure lies beyond a cutoff.  The cutoffs form one path
from loose to strict: each step lowers the cutoff of one rule.  The path is grown on a bounded
sample of labelled rows (``SAMPLE`` rows of the ``FIT`` tenths of doc_ids), so that each step
rejects as many bad documents for each good one as can be.  All other labelled rows are the
holdout.  In every stratum (the language) the steps are tested one after the other: step k is
certified if an exact binomial test shows, on the good documents of the holdout, that all
steps up to k together falsely reject at most ``ALPHA`` of them.  Testing stops at the first
step that fails, so the steps share one error without a correction; strata share ``DELTA``
(Bonferroni).  With confidence 1 - DELTA every stratum loses at most ``ALPHA`` of its good
documents to its certified steps.

A language whose holdout is too small for any certificate is pooled with the others of that
kind; the bound then holds for the pool.  If the pool is too small as well, or a language has
no labels, nothing is rejected there beyond the base rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import stored, tidy
from marginalia.llm.units import slices

ALPHA = 0.01  # good documents that the rules of a stratum may reject
DELTA = 0.05  # chance that any certificate is wrong
FIT = 3  # tenths of doc_ids whose labels the path is grown on
SAMPLE = 20_000  # of their rows, at most
STEPS = 40  # of the path, at most
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
# rule -> measure; every rule rejects above its cutoff.
RULES = {
    "symbols": "n_symbols / n_words",
    "capitals": "n_upper / word_chars",
    "marks": "n_marks / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words / 100",
}
GRID = [k / 100 for k in range(1, 10)] + [k / 20 for k in range(2, 20)]

_MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def measure(text: str | None) -> tuple[int, ...]:
    """The eight counts of one whole text; all 0 for a null or empty one."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counted = Counter(windows)
    repeated, covered = 0, 0
    if len(counted) < len(windows):
        for k, w in enumerate(windows):
            if counted[w] > 1:
                repeated += k + 3 - max(k, covered)
                covered = k + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), len(UPPER.findall(text)), text.count("!") + text.count("?")


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every document, row by row; a lang that is null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for part in slices(batch.column(2)) for t in part]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], [x.split()[0] for x in _MEASURES.split(", ")])

    return docs.select("doc_id", "lang", "text").mapInArrow(tidy(run), _MEASURES)


def of_rule(rule: str) -> Column:
    """Measure of a rule; 0 where its divisor is."""
    top, *under = RULES[rule].split(" / ")
    return F.expr(f"coalesce(try_divide({top}, {under[0]}), 0D)") / (float(under[1]) if under[1:] else 1.0)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial, summed from its largest term."""
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k, -1, -1)]
    return terms[0] + log(sum(exp(t - terms[0]) for t in terms)) if terms[0] > -1e9 else -1e9


def certified(k: int, n: int, rate: float, error: float) -> bool:
    """Whether k of n false rejections show, at this error, that the true rate is at most ``rate``."""
    return n > 0 and k < n * rate and log_binomial_cdf(k, n, rate) <= log(error)


def grow_path(good: np.ndarray, bad: np.ndarray) -> list[tuple[str, float]]:
    """Steps (rule, cutoff): each adds most bad documents for each good one; the looser cutoff on a tie."""
    names, path = list(RULES), []
    left_good, left_bad = np.ones(len(good), bool), np.ones(len(bad), bool)
    cutoff = {r: GRID[-1] + 1 for r in names}
    while len(path) < STEPS:
        best = (0.0, 0.0, "", 0)
        for k, r in enumerate(names):
            for g in reversed(GRID):
                if g < cutoff[r]:
                    more, lost = int((left_bad & (bad[:, k] > g)).sum()), int((left_good & (good[:, k] > g)).sum())
                    if more and (more / (lost + 0.5), g) > best[:2]:
                        best = (more / (lost + 0.5), g, r, k)
        if not best[2]:
            break
        _, g, r, k = best
        cutoff[r] = g
        left_good &= good[:, k] <= g
        left_bad &= bad[:, k] <= g
        path.append((r, g))
    return path


def steps_certified(rejected: list[int], n: int, error: float) -> int:
    """How many steps hold: ``rejected[k]`` of n good documents are rejected by the first k + 1 steps."""
    return next((k for k, x in enumerate(rejected) if not certified(x, n, ALPHA, error)), len(rejected))


def _rejected_at(path: list[tuple[str, float]]) -> Column:
    """Number of the first step, from 1, that rejects a row; null if none does."""
    return F.coalesce(*[F.when(of_rule(r) > g, k) for k, (r, g) in enumerate(path, 1)], F.lit(None).cast("int"))


def cutoffs(counts: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, float]], dict[str | None, int]]:
    """The path and, for each language that has any, how many of its steps are certified.

    The driver gets ``SAMPLE`` rows of measures, and one count for each language and step.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    rows = counts.where(~F.col("base_failed")).join(known, "doc_id")
    fit = F.crc32(F.col("doc_id").cast("string")) % 10 < FIT
    sample = rows.where(fit).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("quality", *(of_rule(r).alias(r) for r in RULES)).toArrow()
    of = lambda y: np.stack([sample.column(r).to_numpy()[sample.column("quality").to_numpy() == y] for r in RULES], 1)
    path = grow_path(of(1), of(0))
    if not path:
        return [], {}
    table = rows.where(~fit & (F.col("quality") == 1)).groupBy("lang", _rejected_at(path).alias("step")).count().collect()
    totals: Counter = Counter()
    at: dict[str | None, list[int]] = {}
    for r in table:
        totals[r.lang] += r["count"]
        at.setdefault(r.lang, [0] * len(path))
        if r.step is not None:
            at[r.lang][r.step - 1] += r["count"]
    # strata are formed from the numbers of labels alone, before anything is tested
    enough = lambda n, strata: certified(0, n, ALPHA, DELTA / strata)
    alone = [x for x in totals if enough(totals[x], len(totals))]
    pool = [x for x in totals if x not in alone]
    strata = [[x] for x in alone] + ([pool] if pool else [])
    held: dict[str | None, int] = {}
    for group in strata:
        n = sum(totals[x] for x in group)
        rejected = np.cumsum(np.sum([at[x] for x in group], 0)).tolist()
        held |= dict.fromkeys(group, steps_certified(rejected, n, DELTA / len(strata)))
    return path, held


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document.

    Empty and null texts fail the base rules.  A null doc_id is judged like any other row
    but never matches a label; of repeated labels the worse counts.  A null language is a
    language of its own.  Rows that share a doc_id are judged each for itself; an empty
    table gives an empty one, and without labels only the base rules reject.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = stored(measures(docs).withColumn("base_failed", base))
    path, held = cutoffs(counts, labels)
    reject = F.lit(False)
    for lang, steps in held.items():  # languages with labels
        if steps:
            reject = reject | (F.col("lang").eqNullSafe(F.lit(lang)) & F.coalesce(_rejected_at(path[:steps]).isNotNull(), F.lit(False)))
    return counts.withColumn("kept", ~F.col("base_failed") & ~reject)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

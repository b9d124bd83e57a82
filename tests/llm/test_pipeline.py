"""Every stage on a small directory against a plain model of what it must keep."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import decontaminate, line_dedup, ngram_join, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Rows (doc_id -> text) before the first stage and after each but the last, and the last's rows."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = corpus_pipeline.stored(docs)
    return [*found, docs.collect()]


def test_clean_documents_stay(spark, tables):
    """These 87 labels are too few to learn terms from (``MIN_DOCS``), so nothing may go wrongly; the next test has enough."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in tables[1] for i in tables[0] if labels.get(i) == 0)
    assert all(tables[1][i] == tables[0][i] for i in tables[1])


def test_toxic_documents_are_found(spark):
    """On documents whose labels the model has not seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    seen = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("rejected")).collect()
    rejected = {r.toxic: r.rejected for r in seen}
    assert rejected[1] >= 0.9 and rejected[0] <= 0.02


def test_lines_against_all_pairs(tables):
    lines = [(i, k, x.encode().split()) for i in sorted(tables[1]) for k, x in enumerate((tables[1][i] or "").split("\n"))]
    long = [x for x in lines if len(x[2]) >= line_dedup.LEAST]
    seen: set[tuple[bytes, ...]] = set()
    earlier: dict[int, list] = {}
    gone = set()
    for i, k, words in long:
        near = len(words) >= line_dedup.FUZZY and any(line_dedup.within_one(words, x) for n in (-1, 0, 1) for x in earlier.get(len(words) + n, ()) if len(x) >= line_dedup.FUZZY)
        if tuple(words) in seen or near:
            gone.add((i, k))
        if tuple(words) not in seen:
            seen.add(tuple(words))
            earlier.setdefault(len(words), []).append(words)
    want = {}
    for i, text in tables[1].items():
        kept = text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if kept == text or kept.split():
            want[i] = kept
    assert tables[2] == want


def test_near_copies_against_all_pairs(tables):
    ids = sorted(tables[2])
    sets = {i: frozenset(ngram_join.shingles(tables[2][i]).tolist()) for i in ids}
    label = {i: i for i in ids}

    def least(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((least(a), least(b)))
                label[y] = x
    assert set(tables[3]) == {i for i in ids if least(i) == i}


def test_items_against_every_alignment(spark, tables):
    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    holds = set()
    for i, text in tables[3].items():
        seq = np.array([items.number.get(w, 0) for w in decontaminate.words(text)], np.int64)
        if any(decontaminate.align(item, seq)[0] >= decontaminate.SIMILAR for _, item in items.items):
            holds.add(i)
    assert set(tables[4]) == set(tables[3]) - holds


def test_ids_against_the_library(tables):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in tables[4].items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tables[5]} == want
    assert len(want) > 100


def test_rows_that_share_an_id_are_judged_apart(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    rows = [(None, f"{text('a')} {item}"), (None, text("b")), (1, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (4, f"{text('e')} {item}"), (4, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    of = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    assert of(corpus_pipeline.drop_contaminated(spark, docs, SF)) == {x for x in rows if item not in x[1]}
    assert of(corpus_pipeline.drop_near_copies(spark, docs, SF)) == {x for k, x in enumerate(rows) if k not in (1, 4)}


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns; and no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, n string, node string, score string, n_removed string, page string"
    text = " ".join(f"w{j}" for j in range(60))
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, text, None, "s", None), (2, text, None, "s", None), (None, text, "en", "s", 5), (3, "long " * 40_000, "en", "s", None)]
    docs = spark.createDataFrame([(*r, *"abcde") for r in rows], kind)
    counts = []
    for some in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            some = stage(spark, some, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert some.columns == list(corpus_pipeline.COLUMNS)
                some = corpus_pipeline.stored(some)
            counts.append(some.count())
    # line dedup leaves the first row with the text, the one without doc_id; what stays is it, the long, the empty and the null text
    assert counts[0] == 6 and counts[1:5] == [4, 4, 4, 4] and counts[5:] == [0] * 5

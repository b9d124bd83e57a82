"""The store's buckets, its index, its marks, and work that is cut off."""

import glob
import math
import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginalia.config import MODEL_REINDEXING, MODEL_VERSION
from marginalia.operators import catalog, chunking, keyword
from marginalia.plans.queries import queries
from marginalia.sources.scratch import clear, forget, kept
from marginalia.sources.store import Store, export_markdown

PAGES = "doc_id string, pages array<struct<page:int,text:string>>"


def files_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_its_bucket_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    rows = spark.range(10_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.lit(1.0).alias("v"))
    assert store.put("vector", rows, "source_id").count() == 10_000
    before = files_of(tmp_path / "s" / "vector")
    assert len(before) == 16
    changed = spark.createDataFrame([("c7", "s7", 2.0), ("c7b", "s7", 3.0)], "id string, source_id string, v double")
    assert store.put("vector", changed, "source_id").count() == 10_001
    after = files_of(tmp_path / "s" / "vector")
    assert len(after) == 16 and sum(before.get(f) == t for f, t in after.items()) == 15  # old files are gone, the others untouched
    assert sorted(r.v for r in store.read("vector").where("source_id = 's7'").collect()) == [2.0, 3.0]
    store.put("vector", changed, "source_id")
    assert store.read("vector").count() == 10_001  # given again, nothing doubles
    assert store.delete("vector", spark.createDataFrame([("c7",)], "id string"), "id").count() == 10_000  # by another column than the key
    assert store.delete("vector", changed, "source_id").count() == 9_999


def test_buckets_without_rows_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    store.put("t", rows, "id")
    assert store.delete("t", rows.where("id is not null"), "id").collect() == [(None, 3)]
    store.create("t", rows.schema, "n")  # one that exists stays
    assert store.key("t") == "id" and store.read("t").columns == ["id", "n"]
    store.drop("t")
    assert not store.has("t")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.create("t", rows.schema, "id")
    assert store.read("t").collect() == [] and store.delete("t", rows, "id").collect() == []


def text_chunks(spark, rows):
    pages = spark.createDataFrame([(d, [(None, t)]) for d, t, _ in rows], PAGES)
    return chunking.chunk_pages(pages).join(spark.createDataFrame([(d, n) for d, _, n in rows], "doc_id string, notebook_id string"), "doc_id")


def test_index_follows_the_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    rows = [(f"d{k}", f"common word{k % 7} Café {'x ' * (k % 5)}", f"n{k % 3}") for k in range(60)]
    store.add_chunks(text_chunks(spark, rows))
    asked = spark.createDataFrame([(1, "word3 cafe", "n0"), (2, "common", None), (3, "word5", "n9"), (4, "", "n0"), (5, None, None)], "qid int, question string, scope string")

    def same():
        chunks = store.read("chunk").select(F.col("chunk_id").alias("id"), "text", F.col("notebook_id").alias("scope"))
        stored = sorted(map(tuple, keyword.search(store.index(), asked, 5).collect()))
        assert stored == sorted(map(tuple, keyword.bm25(chunks, asked, 5).collect()))
        return stored

    assert {r[0] for r in same()} == {1, 2}
    store.add_chunks(text_chunks(spark, [("d3", "something else", "n0"), ("d99", "word3 word3", "n0")]))
    assert ("d99-0" in {r[1] for r in same() if r[0] == 1}) and "d3-0" not in {r[1] for r in same()}
    store.delete_chunks(spark.createDataFrame([(f"d{k}",) for k in range(59)], "doc_id string"))
    assert {r[1] for r in same()} == {"d59-0", "d99-0"}


def test_index_is_made_for_chunks_of_an_older_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.put("chunk", text_chunks(spark, [("a", "red rose", "n"), ("b", "blue sky", "n")]).drop("notebook_id"), "doc_id")

    def with_notebook(s):
        s.rebuild("chunk", lambda old: old.withColumn("notebook_id", F.lit("n1")))

    assert store.migrate([with_notebook, Store.index_buckets]) == 2 == store.migrate([with_notebook, Store.index_buckets])
    asked = spark.createDataFrame([(1, "rose", "n1")], "qid int, question string, scope string")
    assert [r.id for r in keyword.search(store.index(), asked, 5).collect()] == ["a-0"]
    with pytest.raises(ValueError):
        store.migrate([None])


def test_blocks_of_an_index(spark, monkeypatch):
    """Ranking does not depend on how units are dealt to blocks; bounds leave out blocks, never hits."""
    rows = [(k, " ".join(f"t{(k * j) % 23}" for j in range(1, 2 + k % 9))) for k in range(400)] + [(400, None), (401, "")]
    units = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(q, f"t{q} t{q * 2 % 23} t1 t1 zzz") for q in range(20)], "qid long, question string")
    want = sorted(map(tuple, keyword.bm25(units, asked, 7).collect()))
    for name, value in (("BLOCK", 16), ("BLOCK_TOKENS", 40), ("CELLS", 100), ("TERMS", 10)):
        monkeypatch.setattr(keyword, name, value)
        assert sorted(map(tuple, keyword.bm25(units, asked, 7).collect())) == want, name
    assert len(want) == 140
    n, mean = keyword.statistics(keyword.index(units))
    assert n == 402 and abs(mean - sum(len(t.split()) for _, t in rows if t is not None) / 401) < 1e-12
    assert keyword.bm25(units.where("id < 0"), asked, 3).collect() == [] and keyword.bm25(units, asked.where("qid < 0"), 3).collect() == []


def test_common_and_rare_tokens_add_up_alike(spark, monkeypatch):
    """F2 to F4: postings pass the JVM as bytes; tokens are multiplied or added up, whatever is cheaper."""
    rows = [(k, " ".join(["all"] * (1 + k % 3) + [f"t{(k * j) % 97}" for j in range(1, 2 + k % 30)])) for k in range(300)]
    units = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(q, f"all all t{q} t{q * 2 % 97} t1 zzz") for q in range(90)], "qid long, question string")
    assert {k: v for k, v in keyword.index(units).dtypes if k in ("places", "counts", "tokens")} == {"places": "binary", "counts": "binary", "tokens": "string"}
    found = []
    for full, wide in ((0, 3), (1 / 128, 1024), (0.1, 5), (2, 1)):  # all multiplied, ..., none
        monkeypatch.setattr(keyword, "FULL", full)
        monkeypatch.setattr(keyword, "WIDE", wide)
        found.append(sorted(map(tuple, keyword.bm25(units, asked, 9).collect())))
    texts, mean = [(k, t.split()) for k, t in rows], sum(len(t.split()) for _, t in rows) / len(rows)
    df = Counter(x for _, t in texts for x in set(t))
    idf = {x: max(math.log((len(rows) - n + 0.5) / (n + 0.5)), 0) or 1e-6 for x, n in df.items()}
    for q in (0, 7, 89):
        share = lambda t, x: t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean))  # noqa: B023, E731
        want = sorted((-round(sum(idf[x] * share(t, x) for x in ("all", "all", f"t{q}", f"t{q * 2 % 97}", "t1") if x in idf), 6) + 0.0, k) for k, t in texts)[:9]
        got = [(round(s, 6), i) for qid, i, s, _ in sorted(found[0], key=lambda r: (r[0], r[3])) if qid == q]
        assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want, strict=True))
    assert found[1:] == found[:1] * 3


def test_questions_and_blocks_of_a_kind_meet(spark, monkeypatch):
    """blocks and groups of questions hold one language as far as they can; results are those of every pair."""
    word = lambda k, j: f"{'abc'[k % 3]}{(k * 7 + j * j) % 60}"  # noqa: E731  three languages without a common word
    rows = [(k, " ".join([f"the{k % 3}"] * 3 + [word(k, j) for j in range(5 + k % 30)])) for k in range(900)] + [(900, None), (901, "")]
    monkeypatch.setattr(keyword, "BLOCK", 40)
    monkeypatch.setattr(keyword, "GATHERED", 30)
    units = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    kinds = [{i % 3 for i in r.ids if i < 900} for r in keyword.index(units).collect()]
    assert len(kinds) == 23 and sum(len(k) > 1 for k in kinds) <= 3
    monkeypatch.setattr(keyword, "GROUP", 50)
    asked = units.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("text").alias("question"))
    found = keyword.bm25(units, asked, 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {}
    for qid, i, s, r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(qid, []).append((s, i, r))
    texts, n = [(k, (t or "").split()) for k, t in rows], len(rows)
    mean = sum(len(t) for _, t in texts) / (n - 1)
    idf = {x: max(math.log((n - d + 0.5) / (d + 0.5)), 0) or 1e-6 for x, d in Counter(x for _, t in texts for x in set(t)).items()}
    bags = [(k, Counter(t), len(t)) for k, t in texts]
    for q in range(0, 900, 4):
        scores = [(-round(sum(c * idf[x] * b[x] * 2.2 / (b[x] + 1.2 * (0.25 + 0.75 * size / mean)) for x, c in bags[q][1].items() if x in b), 6), k) for k, b, size in bags if not b.keys().isdisjoint(bags[q][1])]
        assert [(i, r) for _, i, r in got[q]] == [(k, r) for r, (_, k) in enumerate(sorted(scores)[:5])]
        assert all(abs(a - b) < 2e-6 for (a, *_), (b, _) in zip(got[q], sorted(scores), strict=False))
    monkeypatch.setattr(keyword, "TRIED", 0)  # with scores that units must reach, from half of the blocks
    monkeypatch.setattr(keyword, "TRY", 2)
    assert sorted(map(tuple, keyword.bm25(units, asked, 5).collect())) == sorted(map(tuple, found.collect()))
    group = [{int(q) % 3 for q in found} for found in _groups(keyword._Asked(_weighted(bags)))]
    assert len(group) == 5 and sum(len(g) > 1 for g in group) <= 3


def _weighted(bags):
    """Rows (qid, token, weight) of every fourth bag, no two alike."""
    rows = [(k, t, 1.0 + k) for k, b, _ in bags[:900:4] for t in b]
    return pa.table({"qid": [r[0] for r in rows], "token": [r[1] for r in rows], "weight": [r[2] for r in rows]})


def _groups(asked):
    return [asked.qids[a:z].to_pylist() for groups in asked.groups.values() for a, z, *_ in groups]


def test_equal_questions_are_one_row(spark, monkeypatch):
    """questions of the same tokens and scope meet the blocks once and all get the result, in whatever part they go."""
    rows = [(q, f"w{j}", 0.5 + j, s) for q, s in ((1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, None)) for j in range(3 if q != 5 else 2)]
    asked = keyword._Asked(pa.table({c: [r[i] for r in rows] for i, c in enumerate(("qid", "token", "weight", "scope"))}))
    assert len(asked.wrong) == 4 and sorted(map(sorted, ([q for q, r in zip(asked.qids.to_pylist(), asked.row.tolist(), strict=True) if r == k] for k in range(4)))) == [[1, 2], [3], [4, 6], [5]]
    units = spark.createDataFrame([(k, f"red{k % 4} rose{k % 3} green", "ab"[k % 2]) for k in range(40)], "id long, text string, scope string")
    told = spark.createDataFrame([(q, ["rose1 red2", "red2 rose1", "green"][q % 3], ["a", "b", None][q % 4 % 3]) for q in range(36)], "qid long, question string, scope string")
    want = None
    for terms in (1 << 21, 8):
        monkeypatch.setattr(keyword, "TERMS", terms)
        got = sorted(map(tuple, keyword.bm25(units, told, 3).collect()))
        want = want or got
        alone = sorted(tuple(r) for q in (0, 1, 2, 7, 33) for r in keyword.bm25(units, told.where(f"qid = {q}"), 3).collect())
        assert got == want and [r for r in got if r[0] in (0, 1, 2, 7, 33)] == alone


def test_many_questions_go_in_few_passes(spark):
    """each pass reads the whole index, so a pass takes thousands of questions."""
    units = spark.range(50).select("id", F.lit("some words").alias("text"))
    asked = spark.range(6000).select(F.col("id").alias("qid"), F.lit("words").alias("question"))
    found = keyword.bm25(units, asked, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.groupBy("id").count().collect() == [(0, 6000)]


def test_chunks_are_not_shuffled_to_their_hits(spark):
    """hits are kept, so that Spark knows how few they are and sends them to the chunks."""
    plan = queries()["content_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "MapInArrow" not in plan
    clear(spark)


def test_blocks_and_what_is_read_at_once_are_bounded(spark):
    """F1 to F5: a reader unpacks all blocks of a row group together."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda k: F.concat(F.lit("w"), (k * 31 + F.col("id")).cast("string"))), " ")
    units = spark.range(0, 24, 1, 1).select("id", words.alias("text"))
    blocks = kept(keyword.index(units), **keyword.WRITTEN)
    sizes = [r.n_tokens for r in blocks.select("n_tokens").collect()]
    assert sum(sizes) == 2_400_000 and max(sizes) <= 1 << 17
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{blocks._kept_in}/*.parquet")]
    assert sum(m.num_row_groups for m in files) > 2 and max(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)) < 20 << 20
    forget(blocks)


def test_a_common_token_sends_k_rows_a_task(spark):
    """No plan of a search has a row for each pair of question and unit."""
    units = spark.range(3000).select("id", F.lit("the same words").alias("text"))
    asked = spark.range(50).select(F.col("id").alias("qid"), F.lit("the words").alias("question"))
    found = keyword.bm25(units, asked, 2)
    assert [(r.id, r["rank"]) for r in found.where("qid = 0").orderBy("rank").collect()] == [(0, 0), (1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_reindex_goes_on_where_it_was_cut_off(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    refs = spark.createDataFrame([(f"c{k:03d}", f"s{k % 5}", "n" if k < 70 else "m") for k in range(100)], "chunk_id string, source_id string, notebook_id string")
    made, broken = [], True

    def embed(plan):
        ids = sorted(r.chunk_id for r in plan.collect())
        if broken and len(made) == 1:
            raise RuntimeError("the model is gone")
        made.append(ids)
        return plan.select(F.col("chunk_id").alias("id"), "source_id", "notebook_id", F.array(F.lit(1.0)).alias("vector"))

    store.put("vector", spark.createDataFrame([("old", "s", "n", [2.0])], "id string, source_id string, notebook_id string, vector array<double>"), "source_id")
    with pytest.raises(RuntimeError):
        store.reindex(refs, embed, MODEL_VERSION, MODEL_REINDEXING)
    first = {r.id for r in store.read("vector").collect()}  # what was done counts at once, the other model's vectors are gone
    assert first == set(made[0]) and len(first) == 32 + 30
    broken = False
    assert store.reindex(refs, embed, MODEL_VERSION, MODEL_REINDEXING).count() == 100
    assert not first & {c for ids in made[1:] for c in ids} and sum(map(len, made)) == 100
    assert store.reindex(refs, embed, MODEL_VERSION, MODEL_REINDEXING).count() == 100 and sum(map(len, made)) == 100
    with pytest.raises(ValueError):
        catalog.reindex_plan(refs, refs, F.lit(None), 0)


def test_reindex_without_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], "chunk_id string, source_id string, notebook_id string")
    assert store.reindex(none, None, MODEL_VERSION, MODEL_REINDEXING).count() == 0 and store.marked("index-version") == MODEL_VERSION


def test_export_gives_one_file_a_result(spark, tmp_path):
    rows = [("Tóm tắt a+b=c", "# text\n\nmore\n"), ("x", "one"), ("x", "two"), ("y", "")]
    out = tmp_path / "out"
    for _ in range(2):  # again over the first
        export_markdown(spark.createDataFrame(rows, "name string, content string"), str(out))
        found = {f.name: f.read_text().removesuffix("\n") for f in out.iterdir() if f.suffix == ".md"}
        assert found == {"Tóm tắt a+b=c.md": "# text\n\nmore\n", "x.md": "one", "x (2).md": "two", "y.md": ""}

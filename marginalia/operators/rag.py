"""Whole question answering over a notebook's chunks, and results made from all its sources.

Everything is a plan over tables of questions; the model is a provider (``functions.plugins``)
whose calls run inside the tasks.  Chunks are (chunk_id, doc_id, ordinal, page, text,
notebook_id), vectors (id, vector, notebook_id), titles (doc_id, title).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import BRANCH_TOP_K, CONTEXT_BUDGET, DEFAULT_TITLE, MAX_DISTANCE, RETRIEVAL_TOP_K, STUDIO_BUDGET
from marginalia.functions import answers as A
from marginalia.functions import plugins
from marginalia.operators import catalog, keyword, packing, retrieval, vectors
from marginalia.sources.scratch import kept


def retrieve(questions: DataFrame, chunks: DataFrame, known: DataFrame, embed, k: int = RETRIEVAL_TOP_K, index: Callable[[], DataFrame] | None = None) -> DataFrame:
    """qid, n, place, id, score and the chunk of the best ``k`` chunks of each question's notebook.

    ``questions`` is (qid, question, notebook_id) and may have ``rewritten``, what a model made
    of a follow-up question; a blank one counts as none.  Both branches look within the
    notebook; chunks that are gone since the index was made drop out.  ``index`` gives the
    stored keyword index (``Store.index``); where it is missing the vector branch answers
    alone, and without ``index`` one is made of the chunks.
    """
    text = A.rewritten(F.col("question"), F.col("rewritten")) if "rewritten" in questions.columns else F.col("question")
    asked = questions.select("qid", text.alias("question"), F.col("notebook_id").alias("scope"))
    asked = asked.withColumn("q", plugins.embeddings(F.col("question"), "query", embed))
    near = vectors.top_k(known.select("id", "vector", F.col("notebook_id").alias("scope")), asked.select("qid", "q", "scope"), BRANCH_TOP_K).where(F.col("distance") <= MAX_DISTANCE)
    told = asked.select("qid", "question", "scope")
    if index is None:
        words = keyword.bm25(chunks.select(F.col("chunk_id").alias("id"), "text", F.col("notebook_id").alias("scope")), told, BRANCH_TOP_K)
    else:
        try:
            words = keyword.search(index(), told, BRANCH_TOP_K)
        except FileNotFoundError:
            words = None
    best = retrieval.retrieve(near, words, known.select("id", "vector"), asked.select("qid", "q"), k)
    return retrieval.ordered_fetch(best, chunks.withColumnRenamed("chunk_id", "id"))


def context(found: DataFrame, titles: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """qid, text, context (citations in order of n), truncated: chunks of each question packed in order of n."""
    named = found.join(titles.select("doc_id", "title"), "doc_id", "left").withColumn("title", F.coalesce("title", F.lit(DEFAULT_TITLE)))
    return _packed(named.withColumn("force", F.lit(False)), "qid", ["n"], budget)


def _packed(rows: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """key, text, context, truncated of rows (key, order, force, id, title, page, text, doc_id); texts are fetched of what is taken."""
    rows = kept(rows)
    sized = rows.withColumn("size", packing.size_of(F.col("title"), F.col("page"), F.col("text")))
    taken, stats = packing.pack(sized, key, order, budget)
    told = taken.join(rows.select(key, F.col("id").cast("string").alias("id"), "title", F.col("page").cast("int").alias("page"), "text", F.col("doc_id").cast("string").alias("source_id")), [key, "id"])
    citation = F.struct(F.col("n").cast("int").alias("n"), F.col("id").alias("chunk_id"), "source_id", "title", "page")
    part = F.struct("n", packing.block(F.col("n"), F.col("title"), F.col("page"), F.col("text")).alias("block"), citation.alias("c"))
    listed = told.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return listed.join(stats.select(key, "truncated"), key).select(key, F.array_join("p.block", "\n\n").alias("text"), F.col("p.c").alias("context"), "truncated")


def answer(questions: DataFrame, found: DataFrame, titles: DataFrame, provider: plugins.Provider) -> DataFrame:
    """qid, decision, answer, citations of (qid, question, mode, reindexing); questions without chunks get an answer too.

    With a column ``history`` (role, content) the model is told the last turns before the question.
    """
    empty = F.expr(A._NONE)
    said_before = F.array_join(F.transform(A.last_turns(F.col("history")), lambda t: F.concat(t["role"], F.lit(": "), t["content"], F.lit("\n\n"))), "") if "history" in questions.columns else F.lit("")
    with_context = questions.join(context(found, titles), "qid", "left").withColumns({"context": F.coalesce("context", empty), "text": F.coalesce("text", F.lit(""))})
    asks = ~F.col("reindexing") & ((F.col("mode") == "open") | (F.size("context") > 0))  # else no model is asked
    prompt = F.when(asks, F.concat(A.system_prompt(F.col("mode"), F.col("text")), F.lit("\n\n"), F.coalesce(said_before, F.lit("")), "question"))
    said = with_context.withColumn("said", F.coalesce(plugins.answers(prompt, provider), F.lit("")))
    return said.select("qid", A.decided(F.col("said"), F.col("mode"), F.col("context"), F.col("reindexing")).alias("a")).select("qid", "a.decision", "a.answer", "a.citations")


def studio(chunks: DataFrame, sources: DataFrame, task: Column, provider: plugins.Provider, now: Column, old: DataFrame | None = None) -> DataFrame:
    """notebook_id, kind, id, created_at, updated_at, content, citations_json, truncated: one result for each notebook.

    Chunks of the sources that are ready are packed in rounds, the first of each source in any
    case; an answer without citations gets all of the context.  ``old`` rows keep their id and
    time of making.
    """
    ready = catalog.ready(sources).select(F.col("id").alias("doc_id"), "title", "notebook_id")
    mine = chunks.drop("notebook_id").join(ready, "doc_id").withColumn("title", F.coalesce("title", F.lit(DEFAULT_TITLE)))
    packed = _packed(mine.select("notebook_id", "ordinal", "doc_id", F.col("chunk_id").alias("id"), "title", "page", "text", (F.col("ordinal") == 0).alias("force")), "notebook_id", ["ordinal", "doc_id"], STUDIO_BUDGET)
    said = packed.withColumn("said", F.coalesce(plugins.answers(F.concat(task, F.lit("\n\n"), "text"), provider), F.lit("")))
    done = said.withColumn("p", A.postprocessed(F.col("said"), F.col("context")))
    cited = A.citations_json(A.with_fallback(F.col("p.citations"), F.col("context")))
    new = done.select("notebook_id", task.alias("kind"), F.concat_ws("/", "notebook_id", task).alias("id"), now.alias("created_at"), now.alias("updated_at"), F.col("p.answer").alias("content"), cited.alias("citations_json"), "truncated")
    return new if old is None else catalog.upserted(old.unionByName(new), ["notebook_id", "kind"], "updated_at")

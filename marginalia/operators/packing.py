"""Context packing within a character budget.

Packing needs the sizes of chunks and not their texts, so it works on ids and sizes and
leaves it to the caller to fetch the texts of what is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered
from marginalia.sources.scratch import kept

ROUND = 1000  # candidates of a group that are looked at together


def block(n: Column, title: Column, page: Column, text: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] (Nguồn: "), title, F.lit(", trang "), F.coalesce(page.cast("string"), F.lit("—")), F.lit(")\n"), text)


def size_of(title: Column, page: Column, text: Column) -> Column:
    """Characters of a chunk's block and of what is between blocks, without the digits of its number."""
    return F.length(block(F.lit(""), title, page, F.lit(""))) + F.length(text) + 2


def packed(chunks: Column, budget: int) -> Column:
    """struct<used,n,ids,parts> of array<struct<force,id,title,page,text>> in order, for the few chunks of one question.

    A chunk that does not fit is skipped and later ones are still tried; chunks with
    ``force`` are taken in any case, and so is the first.  Large groups go through ``pack``.
    """

    def add(state: Column, c: Column) -> Column:
        b = block(state["n"] + 1, c["title"], c["page"], c["text"])
        fits = c["force"] | (state["n"] == 0) | (state["used"] + F.length(b) + 2 <= budget)
        more = F.struct((state["used"] + F.length(b) + 2).alias("used"), (state["n"] + 1).alias("n"), F.concat(state["ids"], F.array(c["id"])).alias("ids"), F.concat(state["parts"], F.array(b)).alias("parts"))
        return F.when(fits, more).otherwise(state)

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("ids"), F.expr("cast(array() as array<string>)").alias("parts"))
    return F.aggregate(chunks, start, add)


def _digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def _fold(items: Column, used: Column, n: Column, budget: int) -> Column:
    """struct<used,n,taken> after array<struct<o,id,size>> in order; a first item of all is taken in any case."""

    def add(s: Column, x: Column) -> Column:
        size = (x["size"] + _digits(s["n"] + 1)).cast("long")
        more = F.struct((s["used"] + size).alias("used"), (s["n"] + 1).alias("n"), F.concat(s["taken"], F.array(F.struct((s["n"] + 1).alias("n"), x["id"].alias("id")))).alias("taken"))
        return F.when((s["n"] == 0) | (s["used"] + size <= budget), more).otherwise(s)

    none = F.expr("cast(array() as array<struct<n:bigint,id:string>>)")
    return F.aggregate(items, F.struct(used.alias("used"), n.alias("n"), none.alias("taken")), add)


def pack(rows: DataFrame, key: str, order: list[str], budget: int) -> tuple[DataFrame, DataFrame]:
    """What each group takes of its rows (key, order, force, id, size): (key, n, id), and (key, n, used, truncated).

    In order a row is taken if what is used and its block stay within the budget; one that
    does not fit is left out and later ones are still tried.  Rows with ``force`` are taken
    in any case and come before all others of their group, and so is a group's first row.
    Forced rows are numbered without gathering them.  Of the others only those that what is
    left of the budget still reaches are looked at, ``ROUND`` of a group at a time; each
    round takes one at least, so rounds end, mostly with the first, and no task ever holds a
    group.
    """
    o = F.struct(*order)
    rows = kept(rows.select(F.col(key).alias("key"), o.alias("o"), F.col("force"), F.col("id").cast("string").alias("id"), F.col("size").cast("long").alias("size")))
    total = rows.groupBy("key").agg(F.count("*").alias("total"))
    forced = numbered(rows.where("force").select("key", "o", "id", "size"), "key", [F.col("o")], "n")
    state = total.join(forced.groupBy("key").agg(F.sum(F.col("size") + _digits(F.col("n"))).alias("used"), F.count("*").alias("n")), "key", "left")
    state = kept(state.select("key", "total", F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    taken = [forced.select("key", F.col("n").cast("long").alias("n"), "id")]
    left = rows.where("not force").select("key", "o", "id", "size")
    reach = (F.col("n") == 0) | (F.col("used") + F.col("size") + _digits(F.col("n") + 1) <= budget)  # the very first has any size
    while True:
        near = left.join(state.select("key", "used", "n"), "key").where(reach)
        at = F.row_number().over(Window.partitionBy("key").orderBy("o"))
        some = near.withColumn("_at", at).where(F.col("_at") <= ROUND)
        lists = some.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "id", "size"))).alias("items"), F.first("used").alias("used"), F.first("n").alias("n"))
        done = kept(lists.select("key", _fold(F.col("items"), F.col("used"), F.col("n"), budget).alias("s"), F.element_at("items", -1)["o"].alias("last"), F.size("items").alias("looked")))
        taken.append(done.select("key", F.inline("s.taken")))
        new = done.select("key", F.col("s.used").alias("used2"), F.col("s.n").alias("n2"))
        state_ = state.join(new, "key", "left").select("key", "total", F.coalesce("used2", "used").alias("used"), F.coalesce("n2", "n").alias("n"))
        more = done.where(F.col("looked") == ROUND).select("key", "last")
        if more.isEmpty():
            state = state_
            break
        state = kept(state_)
        left = left.join(more, "key").where(F.col("o") > F.col("last")).drop("last")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    stats = state.select(F.col("key").alias(key), "n", "used", (F.col("n") < F.col("total")).alias("truncated"))
    return out.withColumnRenamed("key", key), stats

"""Places of rows in the order of their group, for groups that no single task should sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import kept


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in their group.

    Rows are sorted by ranges of (group, order), so a large group lies over many tasks; a
    row's place is its place in its part and what its group has in the parts before.  Only
    one row for each group and part goes through a window.  Rows equal in all of ``order``
    get places in any order; nulls come as the order says, and null is a group like another.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    sorted_ = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = sorted_.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    bases = runs.select("_group", "_part", (F.sum("n").over(Window.partitionBy("_group").orderBy("_part")) - F.col("n") - F.col("first") + 1).alias("_base"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part"))
    return sorted_.join(bases, same).withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_base", "_part", "_group")

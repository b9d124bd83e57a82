"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import forget, stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the least node of its component.

    Every round, a node takes the least label around it and then its label's own label, so
    the rounds grow with the logarithm of a component's width.  Each round is written to the
    shared directory; nothing but the number of changes reaches the driver.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    last = labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")))
        forget(last)
        last, labels = new, new.select("node", "label")
        if new.where("was <> label").isEmpty():
            forget(both)
            return labels

"""Joins of overlapping intervals against plain loops."""

import random

from pyspark.sql import functions as F

from marginalia.operators import intervals


def test_uneven_and_nested_intervals(spark):
    r = random.Random(4)

    def some(n):
        out = []
        for k in range(n):
            start, size = r.randint(-300, 5000), r.choice([0, 1, 2, 3, 7, 40, 64, 65, 900, 6000])
            out.append((k, r.choice(["a", "a", "a", "b", "c", None]), start, start + size))
        return [*out, (n, "a", 5, 3), (n + 1, "a", None, 9), (n + 2, "a", 4, None), (n + 3, "lonely", 1, 2)]

    a, b = some(150), some(130)
    left = spark.createDataFrame(a, "i long, key string, start int, end int").withColumn("other_name", F.lit(1))
    right = spark.createDataFrame(b, "j long, key string, start long, end long")
    got = sorted((x.i, x.other.j) for x in intervals.overlapping(left, right, "key").collect())
    ok = lambda x: None not in x[1:] and x[2] <= x[3]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(got) > 1000


def test_spans_of_nothing_are_null(spark):
    chunks = spark.createDataFrame([("c1", "d", 0, 100), ("c2", "d", 100, 200), ("c3", "e", 0, 5), ("c4", None, 0, 5)], "chunk_id string, doc_id string, start int, end int")
    parts = spark.createDataFrame([("d", 0, 30, 0.0, 1.0), ("d", 30, 101, 1.0, 4.5)], "doc_id string, start int, end int, t_start double, t_end double")
    got = {r.chunk_id: (r.t_start, r.t_end) for r in intervals.timed(chunks, parts).collect()}
    assert got == {"c1": (0.0, 4.5), "c2": (1.0, 4.5), "c3": (None, None), "c4": (None, None)}
    assert intervals.timed(chunks, parts.where("start > 1000")).where("t_start is null").count() == 4
    boxes = spark.createDataFrame([("d", 0, 5, 1.0, 1.0, 2.0, 2.0), ("d", 6, 9, 0.0, 2.0, 1.0, 5.0)], "doc_id string, start int, end int, x double, y double, w double, h double")
    r = intervals.boxed(chunks, boxes).where("chunk_id = 'c1'").first()
    assert (r.x, r.y, r.w, r.h) == (0.0, 1.0, 3.0, 6.0)


def test_an_interval_makes_few_rows(spark):
    """F7 and F8: levels are powers of 16, so partners of twelve lengths mean a few bins and not two dozen."""
    sizes = spark.range(12).select(F.lit("k").alias("key"), F.lit(5).cast("long").alias("start"), F.expr("5L + shiftleft(1L, cast(id as int))").alias("end"))
    levels = [r[0] for r in sizes.select(intervals._level(F.col("end") - F.col("start"))).distinct().collect()]
    assert sorted(levels) == [0, 4, 8, 12]
    one = sizes.where("end - start = 32")
    assert intervals._binned(one, "_a", levels).count() <= 4
    assert intervals.overlapping(one, sizes, "key").count() == 12

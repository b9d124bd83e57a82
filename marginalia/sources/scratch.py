"""Intermediate tables in the folder that driver and executors share, and their end.

A kept table cuts the plan: later jobs and lost tasks start from its files.  They stay until
``forget`` or ``clear`` is called, as a result that was not yet written may read them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []  # the folder of local runs
_MADE: list[str] = []  # folders of this process
#: For tables of texts: a task holds a row group when it writes one, and its texts when it reads one.
TEXTS = {"parquet.block.size": 16 << 20}


def folder(spark: SparkSession) -> str:
    """A new name below ``spark.checkpoint.dir``; only where that is unset on a local master, below a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="marginalia-"))
        found = _LOCAL[0]
    return f"{found.rstrip('/')}/marginalia-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than the cluster runs at once, as of one small file, dealt out; any other as it is.

    Cutting, folding and hashing texts cost far more than moving them, and one row group is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame, **options: int | str) -> DataFrame:
    """``df`` written once, with options of the writer, and read back."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.options(**options).parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_in = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of kept tables that no plan reads any more."""
    for df in tables:
        _MADE.remove(df._kept_in)
        delete(df.sparkSession, df._kept_in)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has kept; for when every result is written."""
    while _MADE:
        delete(spark, _MADE.pop())

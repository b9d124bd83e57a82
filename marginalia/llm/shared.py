"""What jobs of this subpackage share: the folder where they cut their lineage, key filters, workers that let go of memory."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: list[str] = []  # the folder of local runs


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset (local runs), a new folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="marginalia-"))
        found = _LOCAL[0]
    return found


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared directory, not yet made."""
    return f"{checkpoint_dir(spark).rstrip('/')}/marginalia-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared directory and read back: later jobs and lost tasks start from the files.

    Spark removes the shuffle files of plans that nobody refers to when the driver collects
    its garbage, which it is asked for here: the files behind one table need not lie beside
    those of the next.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    found = spark.read.schema(df.schema).parquet(folder)
    found._stored_in = folder
    forget_shuffles(spark)
    return found


def forget_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, and with it the shuffle files of plans that nobody refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` made and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_in)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at its end the Python worker, which may stay idle long, gives its memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    """Give memory that is not in use back to the system, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


class KeyFilter:
    """Bits that say which 64-bit keys may be among the rows of ``keys`` (one column, key).

    There are about 16 bits for each key and ``MOST_BITS`` at most, which bounds what the
    driver gets and sends.  Beyond that more and more other keys pass, so it only spares
    work: whoever must be exact joins with ``keys`` afterwards.
    """

    MOST_BITS = 1 << 26

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(self.MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
        slot = F.expr(f"pmod(key, {self.bits})")
        words = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {self.bits}) & 63 as int))").alias("bit"))
        found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows
        table = np.zeros(self.bits // 64, np.int64)
        table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(table)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Mask of signed keys that may be among those given."""
        slot = keys & (self.bits - 1)
        return (self.sent.value[slot >> 6] >> (slot & 63) & 1).astype(bool)

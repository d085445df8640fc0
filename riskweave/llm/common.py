"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space that splits words and is stripped from lines.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
# One Arrow batch: a worker holds few at a time, so that even very long texts stay within memory.
BATCH_ROWS, BATCH_BYTES = 2048, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def uniform_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A stable number in [0, 1) from the columns' values (independent of partitioning)."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def crc_fold(id_col: str, folds: int) -> Column:
    """The fold of an id: crc32 of its decimal text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def parallelism(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
               df.sparkSession.sparkContext.defaultParallelism)


def give_back_memory():
    """Return memory that a worker has freed, but Arrow and the C library keep for later, to the system: workers live on
    from task to task, so what each keeps at its peak would stay."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def scan_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of the table's own rows: as many as its scan has, or more."""
    return max(parallelism(df), df.rdd.getNumPartitions())


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, one after another, and where each starts (one more than texts)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, ends - ends[0]

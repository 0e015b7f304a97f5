"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import scratch_path, shared_dir

#: Rows of one Arrow batch; its bytes are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
ARROW_ROWS = 512
#: Whether Spark deletes a query's shuffle files when it has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; the checkpoint folder is the cluster's own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class _Scopes(threading.local):
    """Folders written by this thread, by open scope; the first list is of no scope."""

    def __init__(self) -> None:
        self.written: list[list[str]] = [[]]


_scopes = _Scopes()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back (cuts lineage); its shuffle files are deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    _scopes.written[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``; nothing may read it, or frames made of it, afterwards."""
    _delete(df.sparkSession, df.scratch)
    for written in _scopes.written:
        if df.scratch in written:
            written.remove(df.scratch)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all that ``stored`` has written in this thread's innermost scope and not discarded; how many folders it was.

    For the end of a job, when the results of the operators have been written elsewhere.
    """
    written = _scopes.written[-1]
    count = len(written)
    while written:
        _delete(spark, written.pop())
    return count


def stored_alone(make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """The stored result of ``make``; all else that it stored on the way is deleted."""
    _scopes.written.append([])
    try:
        result = stored(make(), purpose)
        _scopes.written[-1].remove(result.scratch)
        _scopes.written[-2].append(result.scratch)
        clear_scratch(result.sparkSession)
    finally:
        _scopes.written[-2].extend(_scopes.written.pop())
    return result


def numbered(docs: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``docs`` stored with a row number, and the name of that column (none of its own)."""
    name = "row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), purpose), name


def only(rows: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """The numbered rows whose number is in the only column of ``kept``, without the number."""
    kept = kept.toDF(name)
    return rows.join(kept, name, "left_semi").drop(name)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def array_sums(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """Sums of the ``width`` elements of an array column over all rows; zeros without rows. One row reaches the driver."""
    found = rows.agg(F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(width)]).alias("sums")).first()["sums"]
    return np.array([x or 0.0 for x in found])


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus`` (null for null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def give_back() -> None:
    """Return freed memory to the machine at the end of a task; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


#: Text of one slice that a worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of ``column`` in one hold at most ``most`` bytes; a longer value is alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(at, end - at)
            at, done = end, int(sizes[end - 1])


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)

"""What the operators share: column selection that survives clashing names, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import checkpoint, ship, table

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_KEYS", "HOT_ROWS", "SALTS", "checkpoint", "few", "join_hot", "prepare", "slices", "table", "text_or_empty", "texts", "tidy", "trim"]

#: Rows and bytes of an Arrow batch sent to Python at most; texts may be long.
BATCH_ROWS, BATCH_BYTES = 8192, 16 << 20


#: Rows of one key that may meet in a task of a join, and keys, or rows of a few numbers, that may be broadcast once counted.
HOT_ROWS, BROADCAST_KEYS, SALTS = 10_000, 200_000, 32


def few(rows: DataFrame, most: int = BROADCAST_KEYS) -> bool:
    """Whether rows of a few numbers are proven to be few enough to be broadcast."""
    return rows.limit(most + 1).count() <= most


def join_hot(big: DataFrame, small: DataFrame, key: str, hot: int = HOT_ROWS) -> DataFrame:
    """big joined with small, which has a row per key. Rows of crowded keys are never gathered.

    What is crowded is known from partial counts; their rows of small are broadcast, if they are few, and else copied to
    ``SALTS`` parts of big's rows.
    """
    crowded = checkpoint(big.groupBy(key).count().where(F.col("count") > hot).select(key))
    if crowded.isEmpty():
        return big.join(small, key)
    if few(crowded):
        return big.join(F.broadcast(crowded), key, "left_anti").join(small, key).unionByName(big.join(F.broadcast(checkpoint(small.join(F.broadcast(crowded), key))), key))
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in big.columns)), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", salt).join(copies, [key, "__salt"]).drop("__salt")


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small. Both are idempotent."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def texts(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_bytes, or of one row."""
    for b in batches:
        n = max(1, -(-b.nbytes // max_bytes))
        step = max(1, b.num_rows // n)
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: others can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def trim() -> None:
    """Give memory that a task freed back to the system; workers are reused, and their neighbours need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with a worker's spare memory returned when its partition is done."""

    @functools.wraps(run)
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return kept

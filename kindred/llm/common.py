"""What the corpus operators share: the shared folder, table reading, Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kindred.sources.scratch import scratch

#: Bytes of text that a Python worker handles at a time (one longer text is handled alone).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, cut from its lineage by a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that Spark sends to a worker; Spark's own default lets whole partitions through.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded size (where the session has not chosen one), and a worker that gives its memory back.

    Spark reads the size from the session when the plan runs, so that it stays set there.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Returns freed memory to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the string column holds about `most` bytes in each."""
    for batch in batches:
        sizes = np.cumsum(lengths(batch.column(column)))
        start, n = 0, batch.num_rows
        while start < n:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value; null counts as empty."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values joined, and where each begins (one more offset at the end). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]

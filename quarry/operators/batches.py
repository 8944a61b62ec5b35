"""Batches between Spark and Python, bounded by their bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The setting that bounds a batch sent to Python by its bytes, and its value here: by rows alone, long
#: texts make batches of any size, held by the JVM and by the worker.
BATCH_BYTES, BATCH_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches to Python have about BATCH_MOST bytes, unless the session sets their size itself."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH_MOST))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow in `bounded` batches."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives what is free back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def runs(batch: pa.RecordBatch, texts: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have about `most` bytes together; a longer row comes alone."""
    start = size = 0
    lengths = (pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in texts)
    for i, n in enumerate(map(sum, zip(*lengths, strict=True))):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows whose texts have about `most` bytes together, with those texts, which become
    Python's a run at a time; a longer text comes alone."""
    for batch in batches:
        for part in runs(batch, [text], most):
            yield part, part.column(text).to_pylist()
    release()

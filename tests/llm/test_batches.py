"""Batches sent to Python are bounded by their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from quarry.llm import common


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])


def test_long_texts_come_in_small_batches(spark: SparkSession) -> None:
    texts = spark.range(300).selectExpr("repeat('word ', 20000) text").coalesce(1)
    got = common.in_arrow(texts, _sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 300 and max(r["size"] for r in got) < 2 * common.BATCH_MOST


def test_a_batch_size_of_the_session_stays(spark: SparkSession) -> None:
    before = spark.conf.get(common.BATCH_BYTES, None)
    try:
        spark.conf.set(common.BATCH_BYTES, "1000")
        common.in_arrow(spark.range(1), _sizes, "n long, size long").collect()
        assert spark.conf.get(common.BATCH_BYTES) == "1000"
    finally:
        spark.conf.set(common.BATCH_BYTES, before) if before else spark.conf.unset(common.BATCH_BYTES)

"""Iterations end when nothing is new, and never silently before."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from quarry.llm import common
from quarry.operators import graph


def test_no_round_is_left_out_in_silence(spark: SparkSession) -> None:
    chain = spark.createDataFrame([(i + 1, i) for i in range(6)], "src long, dst long").coalesce(1)
    start = spark.createDataFrame([(0,)], "id long")
    assert {r.id for r in graph.dependents(chain, start).collect()} == {1, 2, 3, 4, 5, 6}
    assert graph.dependents(chain, start, most=6).count() == 6
    with pytest.raises(RuntimeError):
        graph.dependents(chain, start, most=3)
    with pytest.raises(RuntimeError):
        common.components(chain.toDF("a", "b"), most_rounds=1)

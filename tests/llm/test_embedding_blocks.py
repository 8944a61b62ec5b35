"""Recall by the number of blocks, which grows with the table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry.llm import embeddings


def test_blocks_and_tables_grow_with_the_table() -> None:
    chosen = [embeddings.blocks_for(n) for n in (0, 10**4, 10**6, 10**8, 10**10)]
    assert chosen == sorted(chosen) and chosen[0] == 2 and chosen[-1] > chosen[1]
    assert all(n * embeddings.PASS ** embeddings.blocks_for(n) <= embeddings.UNLIKE for n in (10**4, 10**6, 10**8, 10**10))
    assert embeddings.tables_for(2) < embeddings.tables_for(3) < embeddings.tables_for(4)


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_recall_at_the_limit(spark: SparkSession, blocks: int) -> None:
    rng = np.random.default_rng(blocks)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * r
    v = np.concatenate([a, b])
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(rows, blocks=blocks).collect()}
    assert max(got.values()) == 1 and sum(got.values()) >= 0.985 * 800

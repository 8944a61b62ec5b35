"""Diffs and merges leave Python a bounded run of texts at a time, however many rows a task has."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from quarry.operators import batches, diffs


@pytest.mark.parametrize("name", ["diff", "merge", "ranges"])
def test_results_come_in_bounded_runs(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, name: str) -> None:
    caught = []
    monkeypatch.setattr(diffs, "in_arrow", lambda df, run, schema: (caught.append((run, schema)), batches.in_arrow(df, run, schema))[1])
    words = " ".join(f"w{i}" for i in range(500))
    rows = [(i, words, None if i == 3 else f"{words} {i}", words) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, base string, local string, remote string").coalesce(1)
    out = {"diff": lambda: diffs.diff_texts(df, "base", "local", ["id"]), "merge": lambda: diffs.merge_texts(df, ["id"]), "ranges": lambda: diffs.byte_diffs(df, "base", "local", ["id"])}[name]()
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=df.columns)
    made = list(caught[0][0](iter([batch])))
    assert sum(b.num_rows for b in made) == 2000 and [k for b in made for k in b.column("id").to_pylist()] == list(range(2000))
    size = sum(len(x or "") for r in rows for x in r[1 : (4 if name == "merge" else 3)])
    assert len(made) >= size // diffs.RUN_BYTES and max(b.num_rows for b in made) < 200
    assert out.count() == 2000
    if name == "diff":
        n = {r.id: (r.n_same, r.n_removed, r.n_added) for r in out.where("id in (3, 4)").collect()}
        assert n == {3: (0, 500, 1), 4: (500, 0, 1)}


def test_null_keys_and_long_texts(spark: SparkSession) -> None:
    df = spark.createDataFrame([(None, "a b", "a c"), (2, "x " * 100_000, "x " * 100_000 + "y")], "k long, a string, b string")
    got = {r.k: (r.n_same, r.n_removed, r.n_added) for r in diffs.diff_texts(df, "a", "b", ["k"]).collect()}
    assert got == {None: (1, 1, 1), 2: (100_000, 1, 1)}

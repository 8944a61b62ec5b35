"""Shared pieces of the training-data operators: tables, cut points, size-checked
broadcasts, Arrow batch helpers and distributed connected components."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.batches import BATCH_BYTES, BATCH_MOST, in_arrow, pieces, release
from quarry.operators.tables import drop_table, settled, spread, written

__all__ = ["BATCH_BYTES", "BATCH_MOST", "Lookup", "components", "drop_table", "in_arrow", "in_fold", "keep_columns", "pieces", "release", "renamed", "settled", "small", "spread", "table", "written"]

#: Rows of a table of a few numbers that may be broadcast (some 32 MB).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def renamed(df: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """df with the columns that aren't `own` renamed to c0, c1, ..., so that none clashes with an
    operator's own; and what selects the old names."""
    names = [c if c in own else f"c{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have `rows` rows at most; else as it is,
    so that a join with it shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_fold(doc_id: str | Column = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Held out: crc32 of the id as text, modulo `folds`, is `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False)) if isinstance(doc_id, str) else F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_columns(batch: pa.RecordBatch, names: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(more.values()), names=[*names, *more])


class Lookup:
    """An open-addressed table of nonzero uint64 keys that grows: one gather finds most keys of
    a batch."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.n, self.keys = 0, np.zeros(0, np.uint64)
        self.values = np.zeros(0, values.dtype)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes distinct keys that are not in the table."""
        self.n += len(keys)
        if self.n * 2 > len(self.keys) or not len(self.keys):
            old = self.keys != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            bits = max(10, int(self.n * 3).bit_length())
            self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which keys are there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        value = np.where(hit, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~hit & (found != 0))
        at = slot[left]
        while len(left):
            at = (at + 1) & self.last
            got = self.keys[at]
            same = got == keys[left]
            value[left[same]], hit[left[same]] = self.values[at[same]], True
            more = ~same & (got != 0)
            left, at = left[more], at[more]
        return value, hit


def _round(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    e = written(large.distinct())
    low = written(e.groupBy("a").agg(F.min("b").alias("m")))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest
    node reachable, for each node with an edge.

    Alternating large-star and small-star rounds; a round is two joins whose both sides are
    exchanged (so that hubs can be split) with written tables in between, and the number of
    rounds grows with the logarithm of the longest path. `edges` has columns a and b; self
    links are allowed, nulls are not. More than `most_rounds` rounds, where given, are an error."""
    e, seen = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for n in itertools.count():
        if n == most_rounds:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
        before, e = e, settled(lambda e=e: _round(e))
        drop_table(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))

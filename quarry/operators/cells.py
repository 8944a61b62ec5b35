"""Versioned wide-column cells: rows (row, col, ts, data, deleted), any number of versions a cell.

A write or delete is a new version. Reads are as of a time: the newest version not after it, which
counts as absent if it is a tombstone. All reads are one aggregation with map-side maxima, after
filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["row", "col"]


def upsert(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Appends versions; of the same (row, col, ts) the change wins."""
    both = cells.withColumn("_layer", F.lit(0)).unionByName(changes.withColumn("_layer", F.lit(1)))
    newest = both.groupBy(*KEY, "ts").agg(F.max_by(F.struct("data", "deleted"), "_layer").alias("v"))
    return newest.select(*KEY, "ts", "v.data", "v.deleted")


def tombstones(keys: DataFrame, ts: Column | int, like: DataFrame) -> DataFrame:
    """Delete versions of (row, col) keys at a time."""
    ts = F.lit(ts) if isinstance(ts, int) else ts
    return keys.select(*KEY, ts.cast("long").alias("ts"), F.lit(None).cast(like.schema["data"].dataType).alias("data"), F.lit(True).alias("deleted"))


def as_of(cells: DataFrame, at: int | None = None) -> DataFrame:
    """row, col, ts, data of every cell at a time (0 or None: the newest)."""
    seen = cells.where(F.col("ts") <= at) if at else cells
    newest = seen.groupBy(*KEY).agg(F.max_by(F.struct("ts", "data", "deleted"), "ts").alias("v"))
    return newest.where("not v.deleted").select(*KEY, "v.ts", "v.data")


def scoped(cells: DataFrame, row: str | None = None, prefix: str = "", least: str | None = None, below: str | None = None) -> DataFrame:
    """Cells of a row whose column has the prefix and lies in [least, below)."""
    out = cells if row is None else cells.where(F.col("row") == row)
    out = out.where(F.col("col").startswith(prefix)) if prefix else out
    out = out.where(F.col("col") >= least) if least is not None else out
    return out.where(F.col("col") < below) if below is not None else out


def read_range(cells: DataFrame, row: str | None, at: int | None = None, limit: int = 0, **scope: str) -> DataFrame:
    """An as-of scan of a row in column order; tombstones go before the limit (0: none)."""
    out = as_of(scoped(cells, row, **scope), at).orderBy("row", "col")
    return out.limit(limit) if limit else out


def read_batch(cells: DataFrame, keys: DataFrame, at: int | None = None) -> DataFrame:
    """As-of reads of many (row, col) keys; the keys are joined before the newest is taken."""
    return as_of(cells.join(keys.select(*KEY).distinct(), KEY, "left_semi"), at)


def read_batch_each(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """As-of reads of (row, col, at) keys, each at its own time."""
    seen = keys.join(cells, KEY).where(F.col("ts") <= F.col("at"))
    newest = seen.groupBy(*KEY, "at").agg(F.max_by(F.struct("ts", "data", "deleted"), "ts").alias("v"))
    return newest.where("not v.deleted").select(*KEY, "at", "v.ts", "v.data")


def newest_versions(cells: DataFrame, n: int) -> DataFrame:
    """The newest n versions of each cell."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ts"))
    return cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_policy(cells: DataFrame, policies: DataFrame) -> DataFrame:
    """cells with history and ttl of the policy of the same row that has the longest scope at the
    beginning of the column; 0 where there is none. Policies are few for each row: the cells'
    distinct (row, col) are matched, by row, not every version."""
    names = cells.select(*KEY).distinct()
    fits = names.join(policies, "row").where(F.col("col").startswith(F.col("scope")))
    best = fits.groupBy(*KEY).agg(F.max_by(F.struct("ttl", "history"), F.length("scope")).alias("p"))
    return cells.join(best, KEY, "left").select(*cells.columns, F.coalesce("p.ttl", F.lit(0)).alias("ttl"), F.coalesce("p.history", F.lit(0)).alias("history"))


def compact(cells: DataFrame, policies: DataFrame, now: int) -> DataFrame:
    """Keeps the newest `history` versions (0: all) of each cell, then drops those older than
    `ttl` before now (0: none). Tombstones stay."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ts"))
    ranked = with_policy(cells, policies).withColumn("_n", F.row_number().over(w))
    kept = ranked.where((F.col("history") == 0) | (F.col("_n") <= F.col("history")))
    return kept.where((F.col("ttl") == 0) | (F.col("ts") >= F.lit(now) - F.col("ttl"))).select(*cells.columns)


def next_id(ids: DataFrame, groups: list[str], column: str) -> DataFrame:
    """The id to give next in each group; a single writer has to use it."""
    return ids.groupBy(*groups).agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """base with rows of changes in place of those of the same key; deleted ones go."""
    out = changes.unionByName(base.join(changes.select(*keys).distinct(), keys, "left_anti"))
    return out.where(~F.col(deleted)) if deleted else out


def shard_hints(cells: DataFrame, n: int) -> DataFrame:
    """Where each of about n equal runs of the cells begins (row, col), by Spark's range sampler."""
    dealt = cells.select(*KEY).repartitionByRange(n, *KEY)
    return dealt.groupBy(F.spark_partition_id().alias("shard")).agg(F.min(F.struct(*KEY)).alias("k"), F.count("*").alias("cells")).select("shard", "k.row", "k.col", "cells")

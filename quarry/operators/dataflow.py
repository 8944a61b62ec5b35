"""Batch dataflow: flat-map, keys, grouping, cogroups, side inputs, concatenation, sorted output.

Each operator takes and returns DataFrames; keyed tables have a column `key`. Forms that name what
they compute (sums, folds, first matches) stay in the JVM; those that take a Python function are
Arrow batches and are for what no expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(spark: SparkSession, rows: list, schema: Any) -> DataFrame:
    """A small in-memory collection."""
    return spark.createDataFrame(rows, schema)


def from_shards(spark: SparkSession, shards: list[list], schema: Any) -> DataFrame:
    """An in-memory collection of several lists."""
    return reduce(DataFrame.unionByName, (spark.createDataFrame(rows, schema) for rows in shards))


def flat_map(df: DataFrame, f: Callable[[Any], Iterator[Any]], schema: str) -> DataFrame:
    """f: a row (named tuple) to any number of tuples. For logic no expression can say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split()[0] for p in schema.split(",")]
        for pdf in batches:
            yield pd.DataFrame([out for row in pdf.itertuples(index=False) for out in f(row)], columns=names)

    return df.mapInPandas(run, schema)


def key_by(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("key", key.cast("string"))


def group_apply(df: DataFrame, f: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f(key, rows) for each key. Holds one key's rows; prefer an aggregate where there is one."""
    return df.groupBy("key").applyInPandas(lambda key, pdf: f(key[0], pdf), schema)


def cogroup_apply(left: DataFrame, right: DataFrame, f: Callable[[str, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f(key, left rows, right rows) for each key of either side. Holds one key's rows."""
    return left.groupBy("key").cogroup(right.groupBy("key")).applyInPandas(lambda key, a, b: f(key[0], a, b), schema)


def side_map(df: DataFrame, side: DataFrame, f: Callable[[Any, list], Iterator[Any]], schema: str, most: int = 100_000) -> DataFrame:
    """f(row, side rows), the side held by every task; refuses a side of more than `most` rows."""
    rows = side.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the side input has more than {most} rows; join it instead")
    held = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    return flat_map(df, lambda row: f(row, held.value), schema)


def concatenate(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def group_sum(df: DataFrame, value: str, keys: str | list[str] = "key", out: str = "total") -> DataFrame:
    return df.groupBy(keys).agg(F.sum(value).alias(out))


def group_list(df: DataFrame, keys: str | list[str], value: Column, out: str) -> DataFrame:
    """All values of each key, in order."""
    return df.groupBy(keys).agg(F.sort_array(F.collect_list(value)).alias(out))


def cogroup_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each key of either side the number of its rows on both; each side is summed first."""
    a, b = (t.groupBy("key").agg(F.count("*").alias(n)) for t, n in ((left, "n_left"), (right, "n_right")))
    return a.join(b, "key", "full").na.fill(0, ["n_left", "n_right"])


def key_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each key of either side once."""
    return left.select("key").union(right.select("key")).distinct()


def first_of(df: DataFrame, keys: str | list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order; a map-side aggregate, not a sort of the group."""
    names = [c for c in df.columns if c not in ([keys] if isinstance(keys, str) else keys)]
    best = F.min_by(F.struct(*names), F.struct(*order))
    return df.groupBy(keys).agg(best.alias("_first")).select(*([keys] if isinstance(keys, str) else keys), "_first.*")


def first_match_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Inner join of the first row of each side."""
    return first_of(left, "key", left_order).join(first_of(right, "key", right_order), "key")


def fold_join(left: DataFrame, right: DataFrame, right_order: list[str], value: Column, out: str) -> DataFrame:
    """Each key's first right row with all left values as an array; keys without a right row go."""
    folded = group_list(left, "key", value, out)
    return first_of(right, "key", right_order).join(folded, "key", "left").withColumn(out, F.coalesce(out, F.array().cast(folded.schema[out].dataType)))


def expand_join(left: DataFrame, right: DataFrame, items: str) -> DataFrame:
    """Inner join; each pair gives one row for each item of the right array."""
    return left.join(right, "key").withColumn("item", F.explode(items))


def semi_side(df: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """Rows whose value is in the side; Spark broadcasts the side where it is small."""
    return df.join(side.select(column).distinct(), column, "left_semi")


def cross_explode(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """A row for each pair of the elements of two arrays of a row."""
    return df.select(*keep, F.explode(a).alias("left_item"), b).select(*keep, "left_item", F.explode(b).alias("right_item"))


def sorted_table(df: DataFrame, path: str, shards: int, key: str = "key") -> None:
    """Writes a table in ranges of the key, each sorted."""
    df.repartitionByRange(shards, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def shard_names(name: str) -> list[str]:
    """`base@N` to its N file names; any other name to itself."""
    base, at, n = name.rpartition("@")
    return [f"{base}-{i:05d}-of-{int(n):05d}" for i in range(int(n))] if at and n.isdigit() else [name]


def boundaries(keys: list[str], shards: int) -> list[str]:
    """At most `shards` of the distinct sorted keys, evenly spread."""
    keys = sorted(set(keys))
    if len(keys) <= shards:
        return keys
    return [keys[(i + 1) * len(keys) // shards - 1] for i in range(shards)] if len(keys) >= 2 * shards else keys[:shards]


def key_range(df: DataFrame, prefix: str = "", least: str | None = None, below: str | None = None, key: str = "key") -> DataFrame:
    """Prefix, inclusive least and exclusive upper key; all reach the Parquet scan."""
    out = df.where(F.col(key).startswith(prefix)) if prefix else df
    out = out.where(F.col(key) >= least) if least is not None else out
    return out.where(F.col(key) < below) if below is not None else out

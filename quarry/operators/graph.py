"""Graphs as edge tables: ranks, both directions, what depends on what."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.tables import written


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) keyed from both ends: (key, src, dst); a self link gives two rows."""
    return edges.select(F.explode(F.array("src", "dst")).alias("key"), "src", "dst")


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 3, decay: float = 0.15) -> DataFrame:
    """(id, rank) after a fixed number of rounds from 1.0: the mean rank, plus for each node that
    points here its rank times 1 - decay over the number of its links. Not normalised; repeated
    links count; nodes without links give nothing."""
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    links = written(edges.join(out, "src"))
    ranks = nodes.select("id", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        mean = ranks.agg(F.avg("rank").alias("mean"))
        gain = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * (1 - decay) / F.col("n_out")).alias("gain"))
        ranks = written(ranks.join(gain, "id", "left").crossJoin(F.broadcast(mean)).select("id", (F.col("mean") + F.coalesce("gain", F.lit(0.0))).alias("rank")))
    return ranks


def dependents(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """All nodes from which a link path leads to a start node (src depends on dst), without the
    start nodes: breadth first, each round joins only the nodes found last, until none is new. More
    than `most` rounds, where given, are an error."""
    links = edges.select("src", "dst").distinct()
    seen = found = written(start.select("id").distinct())
    for n in itertools.count():
        found = written(links.join(found.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not found.limit(1).count():
            break
        if n == most:
            raise RuntimeError(f"nodes are still found after {most} rounds")
        seen = written(seen.unionByName(found))
    return seen.join(start.select("id"), "id", "left_anti")


def file_edges(sources: DataFrame, needs: DataFrame) -> DataFrame:
    """Distinct (src, dst) of files: those of a target (target, file) on those of each target that
    it needs (target, needs)."""
    a = needs.join(sources.select("target", F.col("file").alias("src")), "target")
    return a.join(sources.select(F.col("target").alias("needs"), F.col("file").alias("dst")), "needs").where("src <> dst").select("src", "dst").distinct()

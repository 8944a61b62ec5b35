"""Log analytics: time-range scans, named filters and extractors, time buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Events of a date-partitioned log in [start, end], both timestamps as text; days outside are
    never listed by the scan (partition pruning)."""
    logs = spark.read.parquet(root)
    day = F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return logs.where(day & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy("ts")


def write_logs(events: DataFrame, root: str) -> None:
    """One directory a day, each file in time order."""
    events.withColumn("date", F.to_date("ts")).repartition("date").sortWithinPartitions("date", "ts").write.mode("append").partitionBy("date").parquet(root)


def latency_between(args: dict[str, str]) -> Column:
    """minLatency and maxLatency, inclusive; a bound that isn't a number is ignored."""
    out = F.lit(True)
    for name, compare in (("minLatency", lambda b: F.col("value") >= b), ("maxLatency", lambda b: F.col("value") <= b)):
        if name in args:
            bound = F.lit(args[name]).try_cast("double")
            out = out & (bound.isNull() | compare(bound))
    return out


def kind_is(args: dict[str, str]) -> Column:
    """The kind asked for; without the argument nothing passes."""
    return F.col("event_type") == args["kind"] if "kind" in args else F.lit(False)


FILTERS: dict[str, Callable[[dict[str, str]], Column]] = {"latencyFilter": latency_between, "kindFilter": kind_is}


def filtered(events: DataFrame, names: list[str], args: dict[str, str]) -> DataFrame:
    """All named filters together; an unknown name is an error."""
    unknown = [n for n in names if n not in FILTERS]
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    return events.where(reduce(lambda a, b: a & b, (FILTERS[n](args) for n in names), F.lit(True)))


def extracted(events: DataFrame, name: str) -> DataFrame:
    """(ts, value): latency, size or text of an event."""
    if name == "latencyExtractor":
        value = F.col("value")
    elif name == "sizeExtractor":
        value = F.octet_length("props").cast("double")
    elif name == "textExtractor":
        value = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    else:
        raise ValueError(f"unknown extractor: {name}")
    return events.select("ts", value.alias("value"))


def time_buckets(points: DataFrame, n: int, how: str = "sum", rate: bool = False, scale: float = 1.0) -> DataFrame:
    """n equal buckets between the first and the last time: bucket, mid (epoch seconds), value.

    how: sum, average or count; rate divides by the bucket's seconds. Empty buckets have sum and
    count 0 and no average; a point at the last time is in the last bucket."""
    t = points.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("value") * scale).alias("value"))
    span = t.agg(F.min("us").alias("first"), F.max("us").alias("last"))
    width = F.greatest(F.col("last") - F.col("first"), F.lit(1)) / n
    kind = {"sum": F.sum("value"), "average": F.avg("value"), "count": F.count("value").cast("double")}[how]
    dealt = t.crossJoin(F.broadcast(span)).groupBy(F.least(F.floor((F.col("us") - F.col("first")) / width), F.lit(n - 1)).cast("int").alias("bucket")).agg(kind.alias("value"))
    every = span.select("first", "last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    value = F.col("value") if how == "average" else F.coalesce("value", F.lit(0.0))
    value = value / (width / 1e6) if rate else value
    return every.join(dealt, "bucket", "left").select("bucket", ((F.col("first") + (F.col("bucket") + 0.5) * width) / 1e6).alias("mid"), value.alias("value"))


#: Fixed value: rows that a log query gives at most.
MOST_ROWS = 1_000_000


def capped(events: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    return events.limit(most)

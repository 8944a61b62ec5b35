"""Functions that no registered query calls."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.functions import text as T
from quarry.operators import cells, dataflow, logs
from quarry.streaming import logs as live_logs
from quarry.streaming import queue

SF = "/root/testdata/sf0.001"
CELL = "row string, col string, ts long, data string, deleted boolean"


def test_text_and_scalars(spark: SparkSession) -> None:
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()[0]
    assert value(T.first_line(F.lit("\n  \n fix it \nmore"))) == "fix it" and value(T.first_line(F.lit(""))) == ""
    assert value(T.squeezed(F.lit("a\n\n\n\nb "))) == "a\n\nb"
    assert value(T.query_argument(F.lit("a=1&b=x%20y"), "b")) == "x y" and value(T.query_argument(F.lit("a=1"), "c")) is None
    assert value(T.normalized_path(F.lit("a//b/"))) == "/a/b"
    assert [value(scalars.duration_text(F.lit(us))) for us in (1500, 1_000_000, 150_000_000, 7_200_000_000)] == ["1 ms", "1 second", "2 minutes", "2 hours"]
    x = 88172645463325252
    for a, left in ((13, True), (7, False), (17, True)):
        x ^= x << a & 2**64 - 1 if left else x >> a
    assert value(scalars.next_token(F.lit(88172645463325252))) & 2**64 - 1 == x
    pairs = spark.createDataFrame([(2, 5.0), (1, 4.5)], "at long, value double").agg(scalars.json_pairs("at", "value").alias("j")).first()[0]
    assert pairs == "[[1.0,4.5],[2.0,5.0]]"


def test_cells_and_shards(spark: SparkSession) -> None:
    t = spark.createDataFrame([("r", "a", 1, "x", False), ("r", "b", 1, "y", False), ("s", "a", 2, "z", False)], CELL)
    gone = cells.tombstones(t.where("col = 'b'").select("row", "col"), 5, t)
    after = cells.upsert(t, gone)
    assert {(r.row, r.col) for r in cells.as_of(after).collect()} == {("r", "a"), ("s", "a")} and cells.as_of(after, 4).count() == 3
    keys = spark.createDataFrame([("r", "b", 4), ("r", "b", 6), ("s", "a", 1)], "row string, col string, at long")
    assert [(r.row, r["at"]) for r in cells.read_batch_each(after, keys).collect()] == [("r", 4)]
    hints = cells.shard_hints(spark.range(1000).selectExpr("cast(id % 10 as string) as row", "cast(id as string) as col", "id as ts", "'' as data", "false as deleted"), 4).collect()
    assert 2 <= len(hints) <= 4 and sum(h.cells for h in hints) == 1000 and len({(h.row, h.col) for h in hints}) == len(hints)
    assert sorted(r.v for r in dataflow.from_shards(spark, [[(1,)], [(2,), (3,)]], "v long").collect()) == [1, 2, 3]


def test_streams_of_logs_and_messages(spark: SparkSession, tmp_path: Path) -> None:
    events = spark.read.parquet(f"{SF}/events.parquet")
    logs.write_logs(events, str(tmp_path / "log"))
    day, n = events.groupBy(F.to_date("ts").cast("string").alias("d")).count().orderBy(F.desc("count"), "d").first()
    live_logs.compact_day(spark, str(tmp_path / "log"), day, str(tmp_path / "day"), files=1)
    back = [r.ts for r in spark.read.parquet(str(tmp_path / "day")).collect()]
    assert len(back) == n and back == sorted(back)
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/event[s].parquet")
    counts = live_logs.bucket_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    assert counts.awaitTermination(90) and spark.table("buckets").agg(F.sum("n")).first()[0] == events.count()
    messages = spark.createDataFrame([(1, "CREATED"), (2, "SUCCESS"), (3, "RETRY")], "id long, status string")
    messages.write.parquet(str(tmp_path / "messages"))
    live = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "messages"))
    assert queue.deliver(live, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination(60)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}

"""Operators on small fixtures with known results, and every registered query against its SQL."""

from __future__ import annotations

import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.functions import text as T
from quarry.operators import cells, dataflow, diffs, graph, logs
from quarry.plans import index, queries_versions, ranked, registry
from quarry.sources import records
from quarry.streaming import logs as live_logs
from quarry.streaming import queue

SF = "/root/testdata/sf0.001"
CELL = "row string, col string, ts long, data string, deleted boolean"


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    out = registry.QUERIES[name](spark, SF)
    got = out.select(*sorted(out.columns)).collect()
    if name in registry.SQL:
        found = duck.execute(registry.SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(out.columns)
        by = sorted(range(len(names)), key=lambda i: names[i])
        want = [tuple(plain(r[i]) for i in by) for r in found.fetchall()]
        assert sorted((plain(tuple(r)) for r in got), key=repr) == sorted(want, key=repr)


# dataflow


def test_map_key_and_group(spark: SparkSession) -> None:
    numbers = dataflow.from_rows(spark, [(i,) for i in range(1, 5)], "value long")
    keyed = dataflow.key_by(numbers.select((F.col("value") * F.col("value")).alias("value")), F.when(F.col("value") % 2 == 0, "even").otherwise("odd"))
    assert rows(keyed.select("key", "value")) == sorted([("even", 4), ("even", 16), ("odd", 1), ("odd", 9)], key=repr)
    assert rows(dataflow.group_sum(keyed, "value")) == [("even", 20), ("odd", 10)]
    many = spark.createDataFrame([(f"{k:06d}", v) for k in range(100) for v in (12, 23, 34, 45)], "key string, value long")
    assert {r[1] for r in dataflow.group_sum(many, "value").collect()} == {114}
    twice = dataflow.flat_map(numbers, lambda r: iter([(r.value,)] * (r.value % 3)), "value long")
    assert rows(twice) == [(1,), (2,), (2,), (4,)]


def test_joins(spark: SparkSession) -> None:
    jobs = spark.createDataFrame([("1", "janitor"), ("2", "sales"), ("3", "marketing"), ("4", "marketing")], "key string, job string")
    names = spark.createDataFrame([("1", "john"), ("3", "tim"), ("5", "james")], "key string, name string")
    joined = dataflow.first_match_join(jobs, names, ["job"], ["name"])
    assert rows(joined.select(F.concat("name", F.lit(", who is a "), "job"))) == [("john, who is a janitor",), ("tim, who is a marketing",)]
    assert rows(dataflow.key_union(jobs, names)) == [("1",), ("2",), ("3",), ("4",), ("5",)]
    a = spark.createDataFrame([("tim",), ("john",), ("colin",), ("william",)], "value string")
    b = spark.createDataFrame([("tim",), ("colin",), ("josh",), ("kyle",)], "value string")
    assert rows(dataflow.semi_side(a, b, "value")) == [("colin",), ("tim",)]
    got = dataflow.side_map(a, b, lambda r, side: iter([(r.value,)] if r.value in {s[0] for s in side} else []), "value string")
    assert rows(got) == [("colin",), ("tim",)]
    with pytest.raises(ValueError):
        dataflow.side_map(a, b, lambda r, side: iter([]), "value string", most=3)
    assert dataflow.concatenate(a, b, a).count() == 12


def test_shards() -> None:
    assert dataflow.shard_names("/tmp/file.txt@5") == [f"/tmp/file.txt-{i:05d}-of-00005" for i in range(5)]
    assert dataflow.shard_names("/tmp/file.txt") == ["/tmp/file.txt"]
    assert dataflow.boundaries(list("abcdefghi"), 3) == ["c", "f", "i"] and dataflow.boundaries(list("abcd"), 3) == ["a", "b", "c"]


def test_sorted_table(spark: SparkSession, tmp_path: Path) -> None:
    table = spark.range(1000).select(F.format_string("%06d", F.hash("id") % 5000).alias("key"), "id")
    dataflow.sorted_table(table, str(tmp_path / "t"), 3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert rows(back) == rows(table)
    spans = back.groupBy(F.input_file_name()).agg(F.min("key"), F.max("key")).orderBy("min(key)").collect()
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))


# versioned cells


def test_as_of_reads(spark: SparkSession) -> None:
    t = spark.createDataFrame([("asdf", "fdsa", 123, "old", False), ("test", "test", 555, "x", True), ("asdf", "fdsa", 234, "new", False)], CELL)
    assert rows(cells.as_of(t, 999)) == [("asdf", "fdsa", 234, "new")]
    assert rows(cells.as_of(t, 200)) == [("asdf", "fdsa", 123, "old")] and cells.as_of(t, 5).count() == 0
    t = spark.createDataFrame([("abc", "def", 123, "abc def", False), ("abc", "def", 234, "updated", False), ("abc", "qrst", 234, "new value", False), ("abc", "aaa", 234, "starting value", False), ("abc", "bbb", 999, "invisible value", False), ("abc", "qrst", 400, None, True)], CELL)
    for at in (345, 350):
        assert [(r["col"], r["data"]) for r in cells.read_range(t, "abc", at).collect()] == [("aaa", "starting value"), ("def", "updated"), ("qrst", "new value")]
    assert [r["col"] for r in cells.read_range(t, "abc", 450).collect()] == ["aaa", "def"]
    assert [r["col"] for r in cells.read_range(t, "abc", 345, limit=1, least="b").collect()] == ["def"]
    assert rows(cells.upsert(t, spark.createDataFrame([("abc", "def", 234, "again", False)], CELL)).where("ts = 234 and col = 'def'").select("data")) == [("again",)]


def test_compaction(spark: SparkSession) -> None:
    at = [("aardvark", 100), ("aardvark", 125), ("baseball", 100), ("baseball", 125), ("baseball", 135), ("calendar", 100), ("calendar", 100), ("calendar", 100), ("diamond", 100), ("elephant", 0), ("elephant", 100), ("elephant", 200)]
    t = spark.createDataFrame([("a", c, ts, "v", False) for c, ts in at], CELL)
    policies = spark.createDataFrame([("a", "", 0, 1), ("a", "c", 0, 0), ("a", "b", 50, 0), ("a", "d", 50, 0)], "row string, scope string, ttl long, history long")
    kept = [(r["col"], r["ts"]) for r in cells.compact(t, policies, 160).orderBy("col", "ts").collect()]
    assert kept == [("aardvark", 125), ("baseball", 125), ("baseball", 135), ("calendar", 100), ("calendar", 100), ("calendar", 100), ("elephant", 200)]


def test_next_ids_and_overlay(spark: SparkSession) -> None:
    ids = spark.createDataFrame([("hello", 1), ("hello", 2)], "name string, id long")
    assert rows(cells.next_id(ids, ["name"], "id"))[0][-1] == 3
    base = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "k string, v long, gone boolean")
    top = spark.createDataFrame([("b", 3, True), ("c", 4, False)], "k string, v long, gone boolean")
    assert rows(cells.overlay(base, top, ["k"], "gone").select("k", "v")) == [("a", 1), ("c", 4)]


# diffs


def test_patience_and_merge() -> None:
    assert diffs.patience(list("AaaxZ"), list("AxaaZ")) == [("=", "A"), ("-", "a"), ("-", "a"), ("=", "x"), ("+", "a"), ("+", "a"), ("=", "Z")]
    assert [("a--b---c"[i], "abc"[j]) for i, j in diffs.common_subsequence(list("a--b---c"), list("abc"))] == [("a", "a"), ("b", "b"), ("c", "c")]
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcde", k=rng.randint(0, 12)) for _ in range(2))
        steps = diffs.patience(a, b)
        assert diffs.applied(steps) == b and [x for op, x in steps if op != "+"] == a
        assert diffs.merge3(a, a, b) == (b, 0) and diffs.merge3(a, b, a) == (b, 0) and diffs.merge3(a, b, b) == (b, 0)
    assert diffs.merge3(list("abc"), list("aXc"), list("aYc"))[1] == 1


def test_snapshot_diff(spark: SparkSession) -> None:
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "path string, v long")
    b = spark.createDataFrame([("y", 3), ("z", None), ("w", 4)], "path string, v long")
    assert rows(diffs.snapshot_diff(a, b, "path", ["v"]).select("path", "change")) == [("w", "added"), ("x", "removed"), ("y", "modified")]


# index and search


def test_index_and_search(spark: SparkSession) -> None:
    files = spark.createDataFrame([("dk.rs", "let donkey_kong = 5;"), ("mario.rs", "let mario = donkey_kong * 5;")], "filename string, content string")
    imports = spark.createDataFrame([("mario.rs", "dk.rs")], "filename string, target string")
    grams = sorted(r[0] for r in index.trigram_postings(files.limit(1)).select("trigram").collect())
    assert len(grams) == 18 and grams[:4] == [" 5;", " = ", " do", "= 5"]
    found = rows(index.definitions(files).select("normalized", "filename", "symbol", "line_number", "symbol_type"))
    assert found == [("donkeykong", "dk.rs", "donkey_kong", 0, "VARIABLE"), ("mario", "mario.rs", "mario", 0, "VARIABLE")]
    built = index.build_index(files, imports)
    order = [r["filename"] for r in ranked.search(built, "donkey_kong").collect()]
    assert set(order) == {"dk.rs", "mario.rs"} and order[0] == "dk.rs"
    assert [r["filename"] for r in ranked.search(built, "mario f:mario").collect()] == ["mario.rs"]
    assert ranked.search(built, "no_such_word").count() == 0
    with pytest.raises(ValueError):
        ranked.search(built, "")


def test_common_subsequence_equals_brute_force_and_takes_long_texts(monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(2)
    for bits in (diffs.TABLE_BITS, 4):
        monkeypatch.setattr(diffs, "TABLE_BITS", bits)
        for _ in range(400):
            a, b = (rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 14)) for _ in range(2))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            got = diffs.common_subsequence(a, b)
            assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    monkeypatch.undo()
    long = [str(i % 50) for i in range(100_000)]
    assert diffs.merge3(long, [*long, "local"], ["remote", *long]) == (["remote", *long, "local"], 0)
    base = [str(rng.randrange(300)) for _ in range(4000)]
    ours, theirs = ["x", *base[:2000], "ours", *base[2000:], "y"], ["z", *base[:3000], "theirs", *base[3000:], "z"]
    assert diffs.merge3(base, ours, theirs)[1] == 2


def test_three_way_merge_has_every_document_whole(spark: SparkSession) -> None:
    texts = {1: "a\nb", 2: "line\n" * 30_000, 3: None, 4: ""}
    given = spark.createDataFrame([(i, t, len(t) if t and i != 1 else None) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.merged, r.n_conflicts) for r in queries_versions.arr05_three_way_merge(lambda _: given).collect()}
    assert got == {i: (f"remote\n{t}\nlocal" if t is not None else "", 0) for i, t in texts.items()}


def test_page_rank_by_hand(spark: SparkSession) -> None:
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("b", "c")], "src string, dst string")
    want = dict.fromkeys("abc", 1.0)
    links = {"a": ["b", "c"], "b": ["c", "c"], "c": []}
    for _ in range(3):
        mean = sum(want.values()) / 3
        want = {n: mean + sum(want[s] * 0.85 / len(d) * d.count(n) for s, d in links.items() if d) for n in want}
    assert {r.id: pytest.approx(r["rank"]) for r in graph.page_rank(nodes, edges).collect()} == want
    assert rows(graph.dependents(edges, spark.createDataFrame([("c",)], "id string"))) == [("a",), ("b",)]
    assert rows(graph.both_ways(edges.limit(1))) == [("a", "a", "b"), ("b", "a", "b")]


# functions


def test_functions(spark: SparkSession) -> None:
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()[0]
    assert [value(scalars.date_directory(F.lit(s))) for s in (0, 1592761499)] == ["1970/01/01", "2020/06/21"]
    assert value(T.middle_cut(F.lit("asdf hello world"), 10)) == "asd...orld"
    assert value(T.middle_cut(F.lit("third_party/vendor/aho-corasick-0.7.10/src/nfa.rs#L80"), 25)) == "third_party.../nfa.rs#L80"
    assert value(T.normalized(F.lit("Donkey_Kong-x"))) == "donkeykongx" and value(T.trigrams(F.lit("ab"))) == []
    assert [value(scalars.or_else(F.lit(a), F.lit(b))) for a, b in ((0, 5), (7, 5))] == [5, 7] and value(scalars.or_else(F.lit(""), F.lit("colin"))) == "colin"
    assert value(scalars.ttl_seconds(F.lit("ttl=3h"))) == 10800 and value(scalars.ttl_seconds(F.lit("3h"))) is None
    assert value(scalars.log2_or(F.lit(0.0))) == 0.0 and value(scalars.log2_or(F.lit(8.0))) == 3.0
    ids = spark.range(1, 51).select(F.col("id").alias("n"), scalars.newest_first_id(F.col("id")).alias("t")).orderBy("t").collect()
    assert [r.n for r in ids] == list(range(50, 0, -1))


# logs, queue and streams


def test_time_buckets(spark: SparkSession) -> None:
    points = spark.createDataFrame([("2020-01-01 00:00:00", 1.0), ("2020-01-01 00:00:10", 2.0), ("2020-01-01 00:01:40", 4.0)], "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value")
    got = {how: [r.value for r in logs.time_buckets(points, 4, how).orderBy("bucket").collect()] for how in ("sum", "count", "average")}
    assert got == {"sum": [3.0, 0.0, 0.0, 4.0], "count": [2.0, 0.0, 0.0, 1.0], "average": [1.5, None, None, 4.0]}
    with pytest.raises(ValueError):
        logs.filtered(points, ["no such filter"], {})


def test_log_round_trip(spark: SparkSession, tmp_path: Path) -> None:
    events = spark.read.parquet(f"{SF}/events.parquet")
    logs.write_logs(events, str(tmp_path / "log"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    assert logs.read_logs(spark, str(tmp_path / "log"), str(first), str(last)).count() in (events.count(), events.where(F.col("ts") < last).count())


def test_streams(spark: SparkSession, tmp_path: Path) -> None:
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/event[s].parquet")
    live_logs.append_events(stream, str(tmp_path / "log"), str(tmp_path / "c1"), once=True).awaitTermination(60)
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == spark.read.parquet(f"{SF}/events.parquet").count() and "date" in back.columns
    actions = spark.createDataFrame([(1, "start", 1), (1, "succeed", 2), (2, "start", 1), (2, "retry", 2), (3, "succeed", 1)], "id long, action string, at long")
    actions.write.parquet(str(tmp_path / "actions"))
    states = queue.message_states(spark.readStream.schema(actions.schema).parquet(str(tmp_path / "actions")))
    got: list = []
    # once: a processing-time timeout keeps availableNow going for ever
    out = states.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(rows(df))).option("checkpointLocation", str(tmp_path / "c2")).trigger(once=True).start()
    assert out.awaitTermination(60)
    assert (1, "SUCCESS", 0) in got and (2, "RETRY", 1) in got and (3, "CREATED", 0) in got


def test_queue(spark: SparkSession) -> None:
    schema = "id long, queue string, status string, failures int, start_time long, blocked_by array<long>"
    m = spark.createDataFrame([(1, "q", "SUCCESS", 0, 0, []), (2, "q", "STARTED", 0, 0, []), (3, "q", "STARTED", 2, 0, []), (4, "q", "STARTED", 0, 990, []), (5, "q", "BLOCKED", 0, 0, [1]), (6, "q", "BLOCKED", 0, 0, [2]), (7, "q", "BLOCKED", 0, 0, [99])], schema)
    assert rows(queue.sweep(m, 1000)) == [(1, "SUCCESS", 0), (2, "RETRY", 1), (3, "FAILURE", 3), (4, "STARTED", 0), (5, "CONTINUE", 0), (6, "BLOCKED", 0), (7, "FAILURE", 0)]
    assert rows(queue.low_water(m)) == [("q", 2)] and queue.consume(m).count() == 0
    new = queue.enqueue(m, spark.createDataFrame([("q", "b"), ("q", "a"), ("r", "c")], "queue string, name string"), 5)
    assert rows(new.select("queue", "name", "id", "status")) == [("q", "a", 8, "CREATED"), ("q", "b", 9, "CREATED"), ("r", "c", 1, "CREATED")]


# sources


def test_record_files(spark: SparkSession, tmp_path: Path) -> None:
    records.register(spark)
    values = spark.createDataFrame([(bytes([i] * i),) for i in range(6)], "value binary")
    values.repartition(2).write.format("recordio").mode("append").save(str(tmp_path / "r"))
    back = spark.read.format("recordio").load(str(tmp_path / "r"))
    assert sorted(bytes(r.value) for r in back.collect()) == [bytes([i] * i) for i in range(6)]
    (tmp_path / "cut").write_bytes(b"\x02\0\0\0ab\x09\0\0\0x")
    assert [bytes(r.value) for r in spark.read.format("recordio").option("mode", "DROPMALFORMED").load(str(tmp_path / "cut")).collect()] == [b"ab"]
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("recordio").load(str(tmp_path / "cut")).collect()
    keyed = spark.createDataFrame([(f"k{i:03d}", b"v") for i in range(50)], "key string, value binary")
    keyed.repartitionByRange(3, "key").sortWithinPartitions("key").write.format("keyed").mode("append").save(str(tmp_path / "k"))
    table = spark.read.format("keyed").load(str(tmp_path / "k"))
    assert table.count() == 50 and [r.key for r in table.where("key >= 'k010' and key < 'k012'").orderBy("key").collect()] == ["k010", "k011"]


def test_crawl(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "src").mkdir()
    for name, data in (("src/a.py", b"x = 1\n"), ("src/.hidden", b"no"), ("b.bin", b"\xff\xfe\x00")):
        (tmp_path / name).write_bytes(data)
    found = {os.path.basename(r.filename): (r.content, r.is_binary) for r in records.crawl(spark, str(tmp_path)).collect()}
    assert found["a.py"] == ("x = 1\n", False) and found["b.bin"][1] and ".hidden" not in found


def test_trigrams_of_any_signs(spark: SparkSession) -> None:
    texts = ["a😀b😀", "ab", "", None, "é\tx\ny", "aaaa"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(T.trigrams(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else [t[i : i + 3] for i in range(len(t) - 2)] for t in texts]

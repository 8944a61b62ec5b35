"""Versioned cells, overlays, diffs and queues on the driver tables.

Cells: the events, row = user_id, col = event_type, ts = microseconds, data = value; a tombstone where
event_id is divisible by 10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import cells as C
from quarry.operators import diffs as V
from quarry.plans.registered import query
from quarry.streaming import queue as Q

CELLS = "cells AS (SELECT CAST(user_id AS VARCHAR) AS row, event_type AS col, epoch_us(ts) AS ts, max_by(value, event_id) AS data, max_by(event_id % 10 = 0, event_id) AS deleted FROM events GROUP BY 1, 2, 3)"
MIDDLE = 1_705_000_000_000_000


def cells(t) -> DataFrame:
    e = t("events").select(F.col("user_id").cast("string").alias("row"), F.col("event_type").alias("col"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("data"), (F.col("event_id") % 10 == 0).alias("deleted"), "event_id")
    one = e.groupBy("row", "col", "ts").agg(F.max_by(F.struct("data", "deleted"), "event_id").alias("v"))
    return one.select("row", "col", "ts", "v.data", "v.deleted")


@query(f"WITH {CELLS}, n AS (SELECT row, col, max(ts) AS ts, arg_max(data, ts) AS data, arg_max(deleted, ts) AS deleted FROM cells WHERE ts <= {MIDDLE} GROUP BY 1, 2) SELECT row, col, ts, data FROM n WHERE NOT deleted")
def tab03_asof_read(t) -> DataFrame:
    return C.as_of(cells(t), MIDDLE)


@query(f"WITH {CELLS}, n AS (SELECT row, col, max(ts) AS ts, arg_max(data, ts) AS data, arg_max(deleted, ts) AS deleted FROM cells WHERE row = '7' AND col >= 'click' AND col < 'view' GROUP BY 1, 2) SELECT row, col, ts, data FROM n WHERE NOT deleted ORDER BY col LIMIT 3")
def tab04_asof_range(t) -> DataFrame:
    return C.read_range(cells(t), "7", limit=3, least="click", below="view")


@query(f"WITH {CELLS}, n AS (SELECT row, col, max(ts) AS ts, arg_max(data, ts) AS data, arg_max(deleted, ts) AS deleted FROM cells WHERE starts_with(col, 'p') GROUP BY 1, 2) SELECT row, col, ts, data FROM n WHERE NOT deleted")
def tab05_prefix_scope(t) -> DataFrame:
    return C.as_of(C.scoped(cells(t), prefix="p"))


@query(f"WITH {CELLS} SELECT row, col, ts, coalesce(-1 * data, data) AS data, TRUE AS deleted FROM cells WHERE col = 'error' UNION ALL SELECT row, col, ts, data, deleted FROM cells WHERE col <> 'error'")
def tab01_upsert(t) -> DataFrame:
    base = cells(t)
    changes = base.where("col = 'error'").select("row", "col", "ts", (-F.col("data")).alias("data"), F.lit(True).alias("deleted"))
    return C.upsert(base, changes)


@query(f"WITH {CELLS}, n AS (SELECT row, col, max(ts) AS ts, arg_max(data, ts) AS data, arg_max(deleted, ts) AS deleted FROM cells WHERE row IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3) AND col = 'view' GROUP BY 1, 2) SELECT row, col, ts, data FROM n WHERE NOT deleted")
def tab07_batch_read(t) -> DataFrame:
    keys = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("row"), F.lit("view").alias("col"))
    return C.read_batch(cells(t), keys)


POLICIES = [("7", "", 0, 3), ("7", "c", 0, 1), ("8", "e", 5_000_000_000_000, 0), ("9", "view", 0, 2), ("9", "", 10_000_000_000_000, 0)]


@query(f"""WITH {CELLS}, p AS (SELECT * FROM (VALUES {', '.join(map(str, POLICIES))}) v(row, scope, ttl, history)), b AS (
  SELECT c.row, c.col, arg_max(ttl, length(scope)) AS ttl, arg_max(history, length(scope)) AS history FROM (SELECT DISTINCT row, col FROM cells) c JOIN p ON p.row = c.row AND starts_with(c.col, scope) GROUP BY 1, 2),
r AS (SELECT c.*, coalesce(ttl, 0) AS ttl, coalesce(history, 0) AS history, row_number() OVER (PARTITION BY c.row, c.col ORDER BY c.ts DESC) AS n FROM cells c LEFT JOIN b ON b.row = c.row AND b.col = c.col)
SELECT row, col, ts, data, deleted FROM r WHERE (history = 0 OR n <= history) AND (ttl = 0 OR ts >= {MIDDLE} - ttl)""")
def tab12_compaction(t) -> DataFrame:
    base = cells(t)
    policies = base.sparkSession.createDataFrame(POLICIES, "row string, scope string, ttl long, history long")
    return C.compact(base, policies, MIDDLE)


@query(f"WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY ts DESC) AS n FROM cells) SELECT row, col, ts, data, deleted FROM r WHERE n <= 2")
def win04_history(t) -> DataFrame:
    return C.newest_versions(cells(t), 2)


@query("SELECT o_orderpriority, max(o_orderkey) + 1 AS next_id FROM orders GROUP BY 1")
def agg09_reserve_id(t) -> DataFrame:
    return C.next_id(t("orders"), ["o_orderpriority"], "o_orderkey")


@query("""WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_acctbal AS was, b.c_acctbal AS now, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT * FROM customer WHERE c_custkey % 13 <> 0) a FULL JOIN n b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_name IS DISTINCT FROM b.c_name""")
def join10_snapshot_diff(t) -> DataFrame:
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    out = V.snapshot_diff(c.where("c_custkey % 13 <> 0"), new, "c_custkey", ["c_name", "c_acctbal"])
    return out.select("c_custkey", F.col("left.c_acctbal").alias("was"), F.col("right.c_acctbal").alias("now"), "change")


STATES = "CASE {0} % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END"


@query(f"""WITH a AS (SELECT p_partkey, {STATES.format('p_size')} AS was FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey, {STATES.format('p_partkey')} AS now FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN now IS NULL THEN 'reverted' WHEN was IS NULL THEN now WHEN was = 'removed' AND now <> 'removed' THEN 'added' WHEN now = 'removed' AND was <> 'removed' THEN 'removed' WHEN was = 'removed' THEN 'unchanged' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def join11_patch_states(t) -> DataFrame:
    kinds = F.array(*map(F.lit, ("added", "modified", "removed")))
    p = t("part")
    old = p.where("p_partkey % 4 <> 0").select("p_partkey", kinds[F.col("p_size") % 3].alias("state"))
    new = p.where("p_partkey % 5 <> 0").select("p_partkey", kinds[(F.col("p_partkey") % 3).cast("int")].alias("state"))
    return V.patch_states(old, new, "p_partkey")


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'MOVED', c_acctbal * 2 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0""")
def join12_overlay(t) -> DataFrame:
    c = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(False).alias("deleted"))
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("MOVED").alias("c_mktsegment"), (F.col("c_acctbal") * 2).alias("c_acctbal"), (F.col("c_custkey") % 10 == 0).alias("deleted"))
    return C.overlay(c, changes, ["c_custkey"], "deleted").drop("deleted")


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS layer, CASE WHEN p_partkey % 6 = 0 THEN 'change' WHEN p_partkey % 3 = 0 THEN 'base' ELSE p_name END AS v FROM part""")
def join13_layered_read(t) -> DataFrame:
    p = t("part").select("p_partkey", F.col("p_name").alias("v"))
    layers = [p.where("p_partkey % 6 = 0").withColumn("v", F.lit("change")), p.where("p_partkey % 3 = 0").withColumn("v", F.lit("base")), p]
    return V.layered(layers, "p_partkey", "v")


@query(f"""WITH {CELLS}, ch AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS i FROM events WHERE event_type = 'purchase'), tt AS (SELECT path, count(*) AS n_changes FROM ch WHERE i > {MIDDLE} AND i <= {MIDDLE} + 3000000000000 GROUP BY 1),
v AS (SELECT row, ts, data, deleted FROM cells WHERE col = 'purchase'),
o AS (SELECT row, arg_max(data, ts) AS d, arg_max(deleted, ts) AS x FROM v WHERE ts <= {MIDDLE} GROUP BY 1), n AS (SELECT row, arg_max(data, ts) AS d, arg_max(deleted, ts) AS x FROM v WHERE ts <= {MIDDLE} + 3000000000000 GROUP BY 1)
SELECT path, n_changes, CASE WHEN NOT o.x THEN o.d END AS old, CASE WHEN NOT n.x THEN n.d END AS new FROM tt LEFT JOIN o ON o.row = path LEFT JOIN n ON n.row = path""")
def ver02_basis_diff(t) -> DataFrame:
    changes = t("events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("index"))
    return V.basis_diff(changes, cells(t).where("col = 'purchase'"), MIDDLE, MIDDLE + 3_000_000_000_000)


@query("""SELECT path FROM (SELECT regexp_replace(url, '^.*?://', '') AS path FROM pages) WHERE starts_with(path, 'm.') AND len(string_split(path, '/')) = 3""")
def ver03_directory(t) -> DataFrame:
    return V.directory(t("pages").select(F.regexp_replace("url", "^.*?://", "").alias("path")), "m.", 3)


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS versions FROM orders GROUP BY 1")
def ver05_history(t) -> DataFrame:
    out = V.history(t("orders"), "o_custkey", "o_orderkey", F.col("o_orderkey").cast("string"))
    return out.select("o_custkey", F.array_join("versions", ",").alias("versions"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'new' END AS data, p_partkey % 3 = 0 AS deleted FROM part WHERE CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 <> 0 ELSE p_partkey % 4 = 0 OR p_partkey % 2 <> 0 END""")
def ver06_staged(t) -> DataFrame:
    p = t("part")
    base = p.where("p_partkey % 4 <> 0").select("p_partkey", F.col("p_name").alias("data"))
    changes = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("new").alias("data"), (F.col("p_partkey") % 3 == 0).alias("deleted"))
    return V.staged(changes, base, "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'take_remote' WHEN p_partkey % 6 = 2 THEN 'same' ELSE 'conflict' END AS state FROM part WHERE p_partkey % 2 = 0""")
def ver07_three_way(t) -> DataFrame:
    p = t("part")
    base = p.select("p_partkey", F.col("p_name").alias("data"))
    remote = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "remote").otherwise(F.col("p_name")).alias("data"))
    local = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 2, "remote").otherwise("local").alias("data"))
    return V.three_way(base, remote, local, "p_partkey").select("p_partkey", "state")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 20")
def ver08_latest_changes(t) -> DataFrame:
    return t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderkey")).limit(20)


@query()
def arr03_patience_diff(t) -> DataFrame:
    c = t("conversations")
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    return V.diff_texts(pairs, "x", "y", ["conv_id", "turn"])


@query()
def arr05_three_way_merge(t) -> DataFrame:
    lines = F.split("text", "\n")
    rows = t("documents").select("doc_id", F.col("text").alias("base"), F.concat(F.col("text"), F.lit("\nlocal")).alias("local"), F.concat(F.lit("remote\n"), F.array_join(lines, "\n")).alias("remote"))
    return V.merge_texts(rows, ["doc_id"])


MESSAGES = """m AS (SELECT event_id AS id, event_type AS queue, CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'STARTED' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'FAILURE' ELSE 'CREATED' END AS status,
  event_id % 4 AS failures, epoch_us(ts) // 1000000 AS start_time, [event_id - 1, event_id + 1] AS blocked_by FROM events)"""
NOW = MIDDLE // 1_000_000


def messages(t) -> DataFrame:
    kinds = F.array(*map(F.lit, ("SUCCESS", "STARTED", "BLOCKED", "FAILURE", "CREATED")))
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("queue"), kinds[(F.floor("value") % 5).cast("int")].alias("status"), (F.col("event_id") % 4).alias("failures"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_time"), F.array(F.col("event_id") - 1, F.col("event_id") + 1).alias("blocked_by"))


@query(f"WITH {MESSAGES} SELECT queue, coalesce(min(CASE WHEN status NOT IN ('SUCCESS', 'FAILURE') THEN id END), max(id) + 1) AS low FROM m GROUP BY 1")
def agg14_low_water(t) -> DataFrame:
    return Q.low_water(messages(t))


@query(f"WITH {MESSAGES} SELECT id, queue FROM m WHERE status IN ('CREATED', 'RETRY', 'CONTINUE') ORDER BY id LIMIT 11")
def stm01_consume_page(t) -> DataFrame:
    return Q.consume(messages(t)).select("id", "queue")


@query(f"""WITH {MESSAGES}, b AS (SELECT id, unnest(blocked_by) AS blocker FROM m WHERE status = 'BLOCKED'), j AS (SELECT b.id, bool_or(x.status IS NULL) AS unknown, bool_and(coalesce(x.status IN ('SUCCESS', 'FAILURE'), FALSE)) AS ready FROM b LEFT JOIN m x ON x.id = b.blocker GROUP BY 1),
f AS (SELECT m.*, status = 'STARTED' AND start_time + 60 < {NOW} AS late, unknown, ready FROM m LEFT JOIN j ON j.id = m.id)
SELECT id, CASE WHEN late AND failures + 1 >= 3 THEN 'FAILURE' WHEN late THEN 'RETRY' WHEN unknown THEN 'FAILURE' WHEN ready THEN 'CONTINUE' ELSE status END AS status, failures + CAST(late AS INTEGER) AS failures FROM f""")
def stm04_sweep(t) -> DataFrame:
    return Q.sweep(messages(t), NOW)


@query(f"WITH {MESSAGES} SELECT id, status NOT IN ('SUCCESS', 'FAILURE') AS open FROM (SELECT * FROM m WHERE id >= 480 ORDER BY id LIMIT 25)")
def ver10_queue_page(t) -> DataFrame:
    return Q.page(messages(t), 500).select("id", "open")

"""Log analytics on the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import logs as L
from quarry.plans.registered import query


@query("SELECT event_id, value FROM events WHERE value >= 10 AND value <= 50")
def flt01_latency_range(t) -> DataFrame:
    return L.filtered(t("events"), ["latencyFilter"], {"minLatency": "10", "maxLatency": "50"}).select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 5")
def flt03_filter_and(t) -> DataFrame:
    return L.filtered(t("events"), ["latencyFilter", "kindFilter"], {"minLatency": "5", "maxLatency": "many", "kind": "click"}).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'er')")
def flt06_all_terms(t) -> DataFrame:
    return t("documents").where(F.contains(F.lower("text"), F.lit("the")) & F.contains(F.lower("text"), F.lit("er"))).select("doc_id")


@query("SELECT ts, CAST(octet_length(encode(props)) AS DOUBLE) AS value FROM events")
def prj01_size_extractor(t) -> DataFrame:
    return L.extracted(t("events"), "sizeExtractor")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def src15_time_range(t) -> DataFrame:
    return t("events").where(F.col("ts").between(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))).select("event_id", "ts")


def _buckets(value: str) -> str:
    return f"""WITH t AS (SELECT epoch_us(ts) AS us, value FROM events), s AS (SELECT min(us) AS a, max(us) AS b, greatest(max(us) - min(us), 1) / 64.0 AS w FROM t),
d AS (SELECT CAST(least(floor((us - a) / w), 63) AS INTEGER) AS bucket, sum(value) AS total, avg(value) AS mean, CAST(count(value) AS DOUBLE) AS n FROM t, s GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bucket, round({value}, 4) AS value FROM range(64) r(i) CROSS JOIN s LEFT JOIN d ON d.bucket = i"""


@query(_buckets("coalesce(total, 0)"))
def win01_time_buckets_sum(t) -> DataFrame:
    return L.time_buckets(t("events"), 64).select("bucket", F.round("value", 4).alias("value"))


@query(_buckets("mean"))
def win01_time_buckets_avg(t) -> DataFrame:
    return L.time_buckets(t("events"), 64, "average").select("bucket", F.round("value", 4).alias("value"))


@query(_buckets("coalesce(n, 0)"))
def win01_time_buckets_count(t) -> DataFrame:
    return L.time_buckets(t("events"), 64, "count").select("bucket", F.round("value", 4).alias("value"))


@query(_buckets("coalesce(total, 0) / (w / 1000000)"))
def win01_time_buckets_rate(t) -> DataFrame:
    return L.time_buckets(t("events"), 64, rate=True).select("bucket", F.round("value", 4).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d') AS day FROM events")
def dt03_date_directory(t) -> DataFrame:
    return t("events").select("event_id", S.date_directory(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn01_json_value(t) -> DataFrame:
    return t("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("""SELECT a.conv_id, a.turn, max(u.turn) AS asked FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn WHERE a.role = 'assistant' GROUP BY 1, 2""")
def win05_containment(t) -> DataFrame:
    """The nearest user turn before each assistant turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t("conversations").withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)).where("role = 'assistant'").select("conv_id", "turn", "asked")

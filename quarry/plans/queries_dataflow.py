"""Dataflow operators on the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import dataflow as D
from quarry.plans.registered import query


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders")
def src04_keyed_table(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000100' AND starts_with(c_name, 'Customer#')")
def src07_key_range(t) -> DataFrame:
    return D.key_range(t("customer").select("c_custkey", "c_name"), "Customer#", "Customer#000000010", "Customer#000000100", key="c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def src11_point_lookup(t) -> DataFrame:
    return t("orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL")
def map01_flat_map_lines(t) -> DataFrame:
    return t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("SELECT o_orderkey AS value, o_orderkey * o_orderkey AS square FROM orders")
def map02_square(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("value"), (F.col("o_orderkey") * F.col("o_orderkey")).alias("square"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS key, o_orderkey * o_orderkey AS square FROM orders")
def map03_parity_key(t) -> DataFrame:
    rows = t("orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey")).alias("square"))
    return D.key_by(rows, F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd")).select("key", "square")


@query("SELECT r_regionkey, r_name FROM region")
def map04_identity(t) -> DataFrame:
    return t("region").select("*")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders")
def map11_key_by_elements(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").cast("string").alias("key"), F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("value"))


@query("""WITH p AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS parts, list(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey, unnest(parts) AS part, supps FROM p) SELECT l_orderkey, part AS left_item, unnest(supps) AS right_item FROM a""")
def map08_cross_explode(t) -> DataFrame:
    arrays = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("supps"))
    return D.cross_explode(arrays, "parts", "supps", ["l_orderkey"])


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS key, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def agg02_group_sum(t) -> DataFrame:
    return D.group_sum(D.key_by(t("orders"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd")), "o_orderkey")


@query("SELECT n_regionkey AS key, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def agg03_collect_list(t) -> DataFrame:
    return D.group_list(t("nation").withColumnRenamed("n_regionkey", "key"), "key", F.col("n_name"), "names")


@query("SELECT o_orderpriority AS key, CAST(count(*) AS BIGINT) AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def agg01_group_apply(t) -> DataFrame:
    """The opaque form on map-side sums, so that a group holds a row for each status."""
    part = t("orders").groupBy(F.col("o_orderpriority").alias("key"), "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    return D.group_apply(part, lambda key, pdf: pd.DataFrame({"key": [key], "n": [int(pdf["n"].sum())], "spread": [round(pdf["high"].max() - pdf["low"].min(), 2)]}), "key string, n long, spread double")


@query("SELECT count(*) AS n FROM lineitem")
def agg11_count(t) -> DataFrame:
    return t("lineitem").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.key, b.key) AS key, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right
FROM (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n_left FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS key, count(*) AS n_right FROM customer GROUP BY 1) b ON a.key = b.key""")
def join01_cogroup_counts(t) -> DataFrame:
    return D.cogroup_counts(D.key_by(t("orders"), F.col("o_custkey")), D.key_by(t("customer"), F.col("c_custkey")))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n_left, max(r_name) AS name FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def join01_cogroup_apply(t) -> DataFrame:
    def merged(key: str, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "n_left": [len(a)], "name": [b["r_name"].iloc[0] if len(b) else None]})

    return D.cogroup_apply(D.key_by(t("nation"), F.col("n_regionkey")), D.key_by(t("region"), F.col("r_regionkey")), merged, "key string, n_left long, name string")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, o_orderkey FROM o JOIN customer ON c_custkey = o_custkey WHERE n = 1""")
def join02_first_match(t) -> DataFrame:
    orders = D.key_by(t("orders"), F.col("o_custkey")).select("key", "o_orderkey", "o_orderdate")
    people = D.key_by(t("customer"), F.col("c_custkey")).select("key", "c_name")
    return D.first_match_join(orders, people, ["o_orderdate", "o_orderkey"], ["c_name"]).select("key", "c_name", "o_orderkey")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey, coalesce((SELECT string_agg(l_partkey, ',' ORDER BY l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS parts FROM orders""")
def join03_fold_arrays(t) -> DataFrame:
    items = D.key_by(t("lineitem"), F.col("l_orderkey")).select("key", "l_partkey")
    orders = D.key_by(t("orders"), F.col("o_orderkey")).select("key", "o_custkey")
    return D.fold_join(items, orders, ["o_custkey"], F.col("l_partkey"), "parts").select("key", "o_custkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query("""WITH s AS (SELECT s_nationkey, list(s_suppkey) AS supps FROM supplier GROUP BY 1)
SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name, unnest(supps) AS item FROM nation JOIN s ON s_nationkey = n_nationkey""")
def join04_expand(t) -> DataFrame:
    supps = D.key_by(t("supplier").groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("supps")), F.col("s_nationkey"))
    return D.expand_join(D.key_by(t("nation"), F.col("n_nationkey")).select("key", "n_name"), supps, "supps").select("key", "n_name", "item")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key FROM customer UNION SELECT CAST(s_nationkey AS VARCHAR) FROM supplier")
def join05_key_union(t) -> DataFrame:
    return D.key_union(D.key_by(t("customer"), F.col("c_nationkey")), D.key_by(t("supplier"), F.col("s_nationkey")))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def join06_side_map(t) -> DataFrame:
    """The opaque side input; nation is fixed at 25 rows and its size is checked."""
    side = t("nation").select("n_nationkey", "n_name")
    return D.side_map(t("supplier").select("s_suppkey", "s_nationkey"), side, lambda row, rows: ((row.s_suppkey, name) for k, name in rows if k == row.s_nationkey), "s_suppkey long, n_name string")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join07_semi_side(t) -> DataFrame:
    return D.semi_side(t("documents").select("doc_id", "n_chars"), t("labels").where("toxic = 1"), "doc_id")


@query("SELECT l_linenumber, c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def join15_index_lookup(t) -> DataFrame:
    """Secondary to primary look-ups as equi-joins."""
    return t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("l_linenumber", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def set01_concatenate(t) -> DataFrame:
    return D.concatenate(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), t("nation").select(F.col("n_nationkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set02_intersection(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").select(F.col("o_custkey").alias("k")))


@query("SELECT o_custkey % 50 AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def set03_difference(t) -> DataFrame:
    return t("orders").select((F.col("o_custkey") % 50).alias("k")).subtract(t("customer").where("c_custkey % 3 = 0").select("c_custkey"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def sort01_sorted_within_key(t) -> DataFrame:
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk01_best(t) -> DataFrame:
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 11")
def lim03_first_page(t) -> DataFrame:
    return t("orders").select("o_orderkey").orderBy("o_orderkey").limit(11)


@query("SELECT o_orderkey AS id, upper(lpad(to_hex(-1 - o_orderkey), 16, '0')) AS code FROM orders")
def mth09_newest_first(t) -> DataFrame:
    from quarry.functions.scalars import newest_first_id

    return t("orders").select(F.col("o_orderkey").alias("id"), newest_first_id(F.col("o_orderkey")).alias("code"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def mth05_digest(t) -> DataFrame:
    return t("customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_retailprice > 1000 THEN round(log2(p_retailprice), 6) ELSE 0.0 END AS weight, CAST(p_size AS DOUBLE) / NULLIF(p_size - 10, 0) AS ratio FROM part")
def mth03_guarded_math(t) -> DataFrame:
    from quarry.functions.scalars import log2_or

    price = F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).otherwise(0.0)
    return t("part").select("p_partkey", F.round(log2_or(price), 6).alias("weight"), F.try_divide(F.col("p_size").cast("double"), (F.col("p_size") - 10).cast("double")).alias("ratio"))

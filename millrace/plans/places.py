"""Queries for the first rows of each group."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ranking
from millrace.plans.catalog import query


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def topk_per_group(t):
    return ranking.first_per_group(t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], 3, "o_totalprice", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity DESC) AS INTEGER) AS place FROM lineitem QUALIFY place <= 2")
def topk_per_group_ties(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ranking.first_per_group(rows, ["l_returnflag", "l_linestatus"], 2, "l_quantity", ties="rank")


@query("SELECT p_brand, p_partkey, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS place FROM part QUALIFY place <= 2")
def topk_per_group_dense(t):
    return ranking.first_per_group(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], 2, "p_size", ties="dense", descending=False)


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_tax, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_tax DESC) AS INTEGER) AS place FROM lineitem QUALIFY place <= 2")
def topk_per_group_spread(t):
    # every group is a large part of all rows and its best value repeats: rows are compared with the values, never gathered
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_tax")
    return ranking.first_values_per_group(rows, ["l_returnflag"], 2, "l_tax", "rank")


@query("""WITH n AS (SELECT c_nationkey, c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) AS INTEGER) AS place FROM n) SELECT n_name, c_custkey, n, place FROM r JOIN nation ON c_nationkey = n_nationkey WHERE place IN (1, 5)""")
def rank_first_and_nth_per_group(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    buyers = counts.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    placed = ranking.nth_per_group(buyers, ["c_nationkey"], [1, 5], "n", "c_custkey")
    return placed.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "n", "place")

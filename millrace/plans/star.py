"""Relational queries over the star schema: the kinds of joins, groupings, windows and set
operations that the other operators are made of. Dimensions of fixed size are left to
Catalyst, which broadcasts what its statistics allow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.runtime import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _star(sql: str):
    def register(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return register



_REVENUE = "l_extendedprice * (1 - l_discount)"


@_star(
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_REVENUE}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS orders
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, d):
    lines = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr(_REVENUE)), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("orders")
    )


@_star(
    f"""SELECT n_name, round(sum({_REVENUE}), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name"""
)
def nation_revenue(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.expr(_REVENUE)), 2).alias("revenue"))


@_star(
    f"""SELECT o_orderkey, round(sum({_REVENUE}), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY round(sum({_REVENUE}), 2) DESC, o_orderkey LIMIT 10"""
)
def top_orders(spark, d):
    building = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    joined = building.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.round(F.sum(F.expr(_REVENUE)), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@_star("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@_star("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def busy_suppliers(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem").where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@_star("SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def order_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_star("SELECT l_returnflag, l_linestatus, count(*) AS lines FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def line_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))


@_star(
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS n, round(sum(o_totalprice) OVER w, 2) AS running FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"""
)
def running_totals(spark, d):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("n"), F.round(F.sum("o_totalprice").over(order.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))


@_star("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@_star("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def unsold_parts(spark, d):
    return table(spark, d, "part").select("p_partkey").exceptAll(table(spark, d, "lineitem").select("l_partkey").distinct())


@_star(
    """SELECT l_orderkey, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS open, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS filled
    FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250"""
)
def large_orders(spark, d):
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_linestatus") == "F").alias("filled"), F.sum("l_quantity").alias("q"))
    return grouped.where("q > 250").drop("q")

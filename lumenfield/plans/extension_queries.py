"""Relational extensions over the driver's star schema: what a cube engine on Spark gets for free, labelled ext_."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query
from .standin import table

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("ext_pricing_summary", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue()), 2).alias("revenue"))


@query("ext_join_rollup", """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ext_cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def counts(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_running_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders")
def frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last3"))


@query("ext_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without")
def semi_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, d, "customer").join(o, "c_custkey", "left").agg(F.count_if(F.col("has").isNotNull()).alias("with_orders"), F.count_if(F.col("has").isNull()).alias("without"))


@query("ext_set_operations", "SELECT k, n FROM (SELECT c_nationkey AS k, 'both' AS n FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def sets(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("n", F.lit("both")).unionByName(c.subtract(s).withColumn("n", F.lit("customer")))


@query("ext_as_of_join", """SELECT e.event_id, max(p.event_id) AS before FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (e.ts, e.event_id) WHERE e.event_type = 'view' GROUP BY e.event_id""")
def as_of(spark, d):
    """Each view with the user's purchase before it: one window over both, not a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").where("event_type in ('view', 'purchase')")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before", last).where("event_type = 'view'").select("event_id", "before")

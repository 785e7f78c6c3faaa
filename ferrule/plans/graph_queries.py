"""Queries on graphs of the whole corpus, whose components and paths are as long as the tables make them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators import corpus_graph
from ferrule.plans.registry import query, table


@query(
    "corpus_components",
    """WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders
                            UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
       core AS (SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e)),
       way(src, dst) AS (SELECT src, dst FROM core UNION SELECT w.src, c.dst FROM way w JOIN core c ON w.dst = c.src),
       both_ways AS (SELECT a.src AS node, min(a.dst) AS least FROM way a JOIN way b ON a.dst = b.src AND a.src = b.dst GROUP BY a.src)
       SELECT n.node, least(n.node, coalesce(b.least, n.node)) AS component
       FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n LEFT JOIN both_ways b USING (node)""",
)
def corpus_components(spark, sf_dir):
    """Orders call the function numbered like their customer, and one for each part that came back: one graph over all rows."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return corpus_graph.strong_components(orders.unionByName(back))


@query(
    "corpus_reachability",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
       SELECT a.o_orderkey AS src, b.o_orderkey AS dst, CAST((b.k - a.k + 1) // 2 AS BIGINT) AS depth FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.k < b.k""",
)
def corpus_reachability(spark, sf_dir):
    """Each order leads to the customer's next two: whatever follows is reached, in half as many steps as orders lie between."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    led = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.array(F.lead("o_orderkey", 1).over(order), F.lead("o_orderkey", 2).over(order)).alias("after"))
    return corpus_graph.reachability(led.select("src", F.explode("after").alias("dst")))

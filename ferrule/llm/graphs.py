"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component's name is its smallest node.

    Large-star and small-star steps in turn: each relinks a node's neighbours to the smallest node it knows, until
    nothing changes. A step is two shuffles of the edge table; its result is staged in the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stage_table(links, "links")
    seen = None
    while True:  # ends: a step that changes something lowers a neighbour
        # large star: neighbours above a node go to the least of its neighbourhood
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        big = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a node, and the node, go to the least of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        links = stage_table(small.select("e.*").where("a <> b").distinct(), "links")
        name = F.xxhash64("a", "b")
        now = links.agg(F.count("*"), F.bit_xor(name), F.sum(name.cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

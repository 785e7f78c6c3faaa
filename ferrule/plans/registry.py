"""Registered queries of the engine and the SQL that DuckDB compares them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) callable, with its oracle where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "stats_per_function",
    """
    WITH s AS (SELECT user_id, event_type,
                      lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT user_id AS fn, CAST(count(*) AS BIGINT) AS num_instructions,
           CAST(count(DISTINCT event_type) AS BIGINT) AS num_mnemonics,
           CAST(count(nxt) AS BIGINT) AS num_edges,
           CAST(count(*) FILTER (nxt = event_type) AS BIGINT) AS num_self_edges
    FROM s GROUP BY user_id
    """,
)
def stats_per_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        events.withColumn("nxt", F.lead("event_type").over(order))
        .groupBy(F.col("user_id").alias("fn"))
        .agg(
            F.count("*").alias("num_instructions"),
            F.countDistinct("event_type").alias("num_mnemonics"),
            F.count("nxt").alias("num_edges"),
            F.count_if(F.col("nxt") == F.col("event_type")).alias("num_self_edges"),
        )
    )

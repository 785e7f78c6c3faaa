"""Sinks: partitioned tables, JSON documents, graph text, and resuming by anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_tables(tables: dict[str, DataFrame], path: str, partition: str | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/{name}")


def documents(rows: DataFrame, key: str, items: Column, name: str) -> DataFrame:
    """(key, json): the sorted items of each key as one JSON document."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(items)).alias(name))
    return packed.select(key, F.to_json(F.struct(key, name)).alias("json"))


def dot_graphs(edges: DataFrame, fn: str) -> DataFrame:
    """(fn, dot): each function's edges as a digraph, in order."""
    line = F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";'))
    lines = edges.select(fn, line.alias("l")).groupBy(fn).agg(F.array_join(F.array_sort(F.collect_set("l")), "\n").alias("body"))
    return lines.select(fn, F.concat(F.lit("digraph {\n"), F.col("body"), F.lit("\n}")).alias("dot"))

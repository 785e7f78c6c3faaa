"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.session import checkpoint_dir

#: Texts differ widely in length: a batch of a fixed number of rows has no bound of its own.
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
SPARKS_DEFAULT = "67108864b"
#: Shuffle files go when the query that wrote them ends; by default they wait for the driver's garbage collector.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, so that a lost executor costs nothing, and read again."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")  # a write's plan is run once, so nothing asks for its shuffles again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold by bytes, unless the session has set a bound itself."""
    if spark.conf.get(BATCH_BYTES_KEY) == SPARKS_DEFAULT:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))

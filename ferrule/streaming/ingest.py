"""Incremental ingest: new files become rows of a table, each binary once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.sources.binaries import FILE_SCHEMA, with_identity
from ferrule.sources.sinks import pending


def binary_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path)


def ingest(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append binaries that the table has not seen; a batch that is replayed after a loss adds nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = with_identity(batch).dropDuplicates(["binary_id"])
        try:
            done = batch.sparkSession.read.parquet(table_path)
        except Exception as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = rows.limit(0)
        pending(rows, done, "binary_id").write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str, late: str) -> DataFrame:
    """Events per window and kind, rows later than ``late`` left out; for streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), kind, "n"
    )

"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets of about ``bucket_bytes`` by seeded hashes; a bucket belongs to one
shard and to one Spark partition, so no task holds more than a bucket. Pass two loads a bucket, permutes it with a
seeded Fisher-Yates shuffle and writes it. The law is ``key``: the shard is the one with the highest seeded hash of
(id, shard), so that one more shard only takes rows into itself.

Edge cases: a null text has no bytes (size 1) and the CRC of the empty text; a null id is a key of its own; rows that
agree in id and text are interchangeable, each keeps its own slot; an empty table gives an empty result; further
columns are carried unless they bear a name of the outputs (``OUTPUTS``), which then wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ferrule.llm.common import fresh_path

OUTPUTS = ("size", "shard", "grown_shard", "bucket", "place", "first_slot", "slot")
SEED = 20_011
#: Most buckets whose first slots are sent to the tasks (16 bytes each); at 16 MB a bucket that is 16 TB.
SENT = 1 << 20


def highest_hash_shard(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard in [0, n_shards) whose hash with the key is highest."""
    scores = F.array(*[F.xxhash64(F.lit(seed), key, F.lit(i)) for i in range(n_shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): the last open place swaps with a random one up to it."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for last in range(n - 1, 0, -1):
        pick = picks[last]
        order[last], order[pick] = order[pick], order[last]
    return order


def _permute_buckets(id_col: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        for bucket in sorted(set(rows.column("bucket").to_pylist())):
            own = rows.filter(pa.compute.equal(rows.column("bucket"), bucket))
            # a canonical order first: the result must not depend on the order of arrival
            own = own.sort_by([(id_col, "ascending"), ("place", "ascending")])
            order = fisher_yates(own.num_rows, np.random.default_rng([seed, bucket]))
            own = own.take(pa.array(order))
            spot = own.schema.get_field_index("place")
            own = own.set_column(spot, "place", pa.array(np.arange(own.num_rows), pa.int64()))
            yield from own.to_batches(max_chunksize=2_000)

    return run


def shuffled_buckets(
    docs: DataFrame,
    n_shards: int = 8,
    bucket_bytes: int = 16 << 20,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs``, whole, with their shard, their bucket and their place in the permuted bucket."""
    shard = highest_hash_shard(F.col(id_col), n_shards, seed)
    newcomer = F.xxhash64(F.lit(seed), F.col(id_col), F.lit(n_shards))
    best = F.array_max(F.array(*[F.xxhash64(F.lit(seed), F.col(id_col), F.lit(i)) for i in range(n_shards)]))
    rows = docs.drop(*[c for c in OUTPUTS if c in docs.columns]).withColumns(
        {
            "size": record_size(F.col(text_col)),
            "shard": shard,
            "grown_shard": F.when(newcomer > best, F.lit(n_shards)).otherwise(shard).cast("int"),
        }
    )
    # one number per shard comes back: its bytes, to size the buckets
    held = {r["shard"]: r["held"] for r in rows.groupBy("shard").agg(F.sum("size").alias("held")).collect()}
    counts = [max(1, math.ceil(held.get(s, 0) / bucket_bytes)) for s in range(n_shards)]
    firsts = [sum(counts[:s]) for s in range(n_shards)]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    content = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col))
    rows = rows.withColumn("place", content).withColumn(
        "bucket", (pick(firsts) + F.pmod(F.xxhash64(F.lit(seed + 2), "place"), pick(counts))).cast("int")
    )
    return rows.repartitionById(sum(counts), F.col("bucket")).mapInArrow(_permute_buckets(id_col, seed), rows.schema)


def write_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards, a folder per shard and a file per bucket, and return what was written with its slots.

    A slot is the place in the bucket plus the rows of the shard's earlier buckets, so slots run gapless from 0.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    rows = shuffled_buckets(docs, **options)
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = T.StructType([f for f in rows.schema if f.name != "shard"] + [rows.schema["shard"]])
    written = spark.read.schema(schema).parquet(path)
    buckets = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = buckets.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    # a row per bucket: sent to the tasks, so that texts are not shuffled again, while that many rows are few
    firsts = F.broadcast(firsts) if firsts.count() <= SENT else firsts
    return written.join(firsts, "bucket").withColumn("slot", F.col("first_slot") + F.col("place")).drop("first_slot")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard the whole ``documents`` table into 8 shards and read the digest columns back from the shards."""
    from ferrule.llm.common import table

    return write_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )

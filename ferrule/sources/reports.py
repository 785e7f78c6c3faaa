"""Reports of analysed binaries as JSON documents, read into tables.

Maps keyed by address come as objects with string keys; they are read as maps and exploded into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTION = (
    "struct<offset:long, blocks:map<string,array<array<string>>>, apirefs:map<string,string>, "
    "blockrefs:map<string,array<long>>, inrefs:array<long>, outrefs:map<string,array<long>>, is_exported:boolean, "
    "metadata:struct<function_name:string, confidence:double, tfidf:double, nesting_depth:int>>"
)
SCHEMA = (
    "architecture string, base_addr long, binary_size long, bitness int, sha256 string, status string, timestamp string, "
    f"oep long, metadata struct<filename:string, family:string, version:string>, xcfg map<string,{FUNCTION}>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report; documents that lack keys get nulls, those that fail to parse are dropped by the caller."""
    reports = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    return reports.withColumn("analysed_at", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH-mm-ss"))


def functions_of(reports: DataFrame) -> DataFrame:
    each = reports.select(F.col("sha256").alias("binary_id"), "architecture", F.explode("xcfg").alias("key", "f"))
    return each.select("binary_id", "architecture", F.col("key").cast("long").alias("fn"), "f")


def instructions_of(functions: DataFrame) -> DataFrame:
    """(binary_id, fn, block, seq, addr, bytes, mnemonic, operands)."""
    blocks = functions.select("binary_id", "fn", F.explode("f.blocks").alias("block", "rows"))
    each = blocks.select("binary_id", "fn", F.col("block").cast("long").alias("block"), F.posexplode("rows").alias("seq", "i"))
    return each.select(
        "binary_id", "fn", "block", "seq", F.col("i")[0].cast("long").alias("addr"), F.col("i")[1].alias("bytes"),
        F.col("i")[2].alias("mnemonic"), F.col("i")[3].alias("operands"),
    )


def code_refs_of(functions: DataFrame) -> DataFrame:
    refs = functions.select("binary_id", "fn", F.explode("f.outrefs").alias("src", "dsts"))
    return refs.select("binary_id", "fn", F.col("src").cast("long").alias("src"), F.explode("dsts").alias("dst"))


def api_refs_of(functions: DataFrame) -> DataFrame:
    refs = functions.select("binary_id", "fn", F.explode("f.apirefs").alias("src", "api"))
    return refs.select("binary_id", "fn", F.col("src").cast("long").alias("src"), "api")


def block_edges_of(functions: DataFrame) -> DataFrame:
    refs = functions.select("binary_id", "fn", F.explode("f.blockrefs").alias("src", "dsts"))
    return refs.select("binary_id", "fn", F.col("src").cast("long").alias("src"), F.explode("dsts").alias("dst"))


def statistics(instructions: DataFrame, code_refs: DataFrame, api_refs: DataFrame) -> DataFrame:
    """Counters per binary. Calls of functions count every reference to a function's start, jumps too."""
    own = instructions.groupBy("binary_id").agg(
        F.countDistinct("fn").alias("num_functions"),
        F.countDistinct("fn", "block").alias("num_basic_blocks"),
        F.count("*").alias("num_instructions"),
        F.sum(F.length("bytes") / 2).cast("long").alias("binweight"),
    )
    starts = instructions.select("binary_id", F.col("fn").alias("dst")).distinct()
    calls = code_refs.join(starts, ["binary_id", "dst"], "left_semi").groupBy("binary_id").agg(F.count("*").alias("num_function_calls"))
    apis = api_refs.groupBy("binary_id").agg(F.countDistinct("src").alias("num_api_calls"))
    counts = ["num_function_calls", "num_api_calls"]
    return own.join(calls, "binary_id", "left").join(apis, "binary_id", "left").na.fill(0, counts)

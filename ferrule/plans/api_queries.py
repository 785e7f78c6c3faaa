"""Queries on names of library functions in dumps: parts are exports, orders are dumps that point to the parts of their lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ferrule.operators import api_names
from ferrule.plans.built_files import Built
from ferrule.plans.image_queries import BASE
from ferrule.plans.registry import query, table
from ferrule.sources.pages import PAGE
from ferrule.sources.pe_tables import spread

#: Four libraries, far above 32 bits.
FAR, APART = 0x7FF800000000, 1 << 28
EXPORTS_SQL = f"""x AS (SELECT 'lib_' || p_size % 4 || '_.dll' AS dll, CASE WHEN p_partkey % 10 = 0 THEN 'None<' || p_partkey || '>' ELSE p_name || p_partkey END AS api,
    {FAR} + p_size % 4 * {APART} + p_partkey * 16 AS address FROM part)"""
WORDS_SQL = """d AS (SELECT DISTINCT l_orderkey AS binary_id, {far} + p_size % 4 * {apart} + l_partkey * 16 + {shift} AS word FROM lineitem JOIN part ON l_partkey = p_partkey),
    w AS (SELECT binary_id, {base} + 8 * (row_number() OVER (PARTITION BY binary_id ORDER BY word) - 1) AS addr, word FROM d)"""
MOVED = "(l_orderkey % 7 - 3) * 65536 * (p_size % 4 + 1)"


def _exports(spark, sf_dir):
    number = (F.col("p_size") % 4).cast("string")
    named = F.when(F.col("p_partkey") % 10 != 0, F.concat("p_name", F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select(
        F.lit(1).alias("os"), F.col("p_partkey").alias("place"), F.concat(F.lit("10_x64_lib_"), number, F.lit("_.dll")).alias("entry"), F.lit(64).alias("bitness"),
        (F.lit(FAR) + F.col("p_size") % 4 * APART).cast("decimal(20,0)").alias("base"), named.alias("name"), F.col("p_partkey").alias("ordinal"), (F.col("p_partkey") * 16).cast("decimal(20,0)").alias("address"),
    )
    return api_names.named_exports(rows)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, api_names.PAGES):
            part = batch.slice(at, api_names.PAGES)
            n = np.asarray(pc.list_value_length(part.column(1)), np.int64)
            f, i = spread(n)
            out = Built(np.full(len(n), PAGE))
            out.number(f, 8 * i, np.asarray(part.column(1).flatten(), np.int64), 8)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.zeros(len(n), np.int64)), out.contents()], names=["binary_id", "page", "bytes"])


def _words(spark, sf_dir, moved: bool):
    """The words of dumps that hold a page each: a pointer to each part of an order, by address, and zeros behind them."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey")
    shift = (F.col("l_orderkey") % 7 - 3) * api_names.LOW * (F.col("p_size") % 4 + 1) if moved else F.lit(0)
    word = F.lit(FAR) + F.col("p_size") % 4 * APART + F.col("l_partkey") * 16 + shift
    slots = lines.groupBy(F.col("l_orderkey").alias("binary_id")).agg(F.sort_array(F.collect_set(word.cast("long"))).alias("m"))
    pages = slots.mapInArrow(_pages, "binary_id long, page long, bytes binary")
    layout = slots.select("binary_id", F.lit(BASE).alias("base"), F.lit(PAGE).alias("size"), F.lit(None).cast("string").alias("fault"))
    return api_names.page_words(pages, layout, 8)



@query(
    "dump_apis",
    f"WITH {EXPORTS_SQL}, {WORDS_SQL.format(base=BASE, far=FAR, apart=APART, shift=0)} SELECT binary_id, CAST(addr AS BIGINT) AS addr, dll, api FROM w JOIN x ON word = address",
)
def dump_apis(spark, sf_dir):
    found = api_names.resolve_apis(_words(spark, sf_dir, False), _exports(spark, sf_dir))
    return found.select("binary_id", F.col("addr").cast("long").alias("addr"), "dll", "api")


@query(
    "moved_dump_apis",
    f"""WITH {EXPORTS_SQL}, {WORDS_SQL.format(base=BASE, far=FAR, apart=APART, shift=MOVED)},
        v AS (SELECT binary_id, dll, word - address AS shift, count(*) AS n FROM (SELECT DISTINCT binary_id, word FROM w) JOIN x ON word % 65536 = address % 65536 GROUP BY ALL HAVING count(*) >= 2),
        b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY binary_id, dll ORDER BY n DESC, abs(shift), shift) = 1)
        SELECT w.binary_id, CAST(addr AS BIGINT) AS addr, x.dll, api FROM w JOIN b USING (binary_id) JOIN x ON x.dll = b.dll AND x.address = word - shift""",
)
def moved_dump_apis(spark, sf_dir):
    """Each order's libraries have moved by multiples of 64 KB, each its own way; two lines or more of a library tell how far."""
    found = api_names.resolve_shifted(_words(spark, sf_dir, True), _exports(spark, sf_dir))
    return found.select("binary_id", F.col("addr").cast("long").alias("addr"), "dll", "api")

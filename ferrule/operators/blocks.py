"""Basic blocks, function parts and neighbours of instructions, by windows over the order of addresses.

Instructions are rows of (fn, addr, size); every window is partitioned by function, which bounds what a task sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.operators.ranges import locate, merge_areas, range_join


def derive_blocks(instructions: DataFrame, targets: DataFrame, fn: str, ends: Column) -> DataFrame:
    """``instructions`` with ``block``, the address of the leader of each.

    Leaders open a function, follow an instruction that ``ends`` a block, or are among ``targets`` (fn, dst).
    Targets are merged into the order of addresses instead of being joined, so that rows are dealt by function only, and
    instructions and targets that are dealt so already stay where they are.
    """
    rows = instructions.withColumn("_code", F.struct(ends.alias("ends")))
    known = targets.select(fn, F.when(F.col(fn).isNotNull(), F.col("dst")).alias("addr"))
    order = Window.partitionBy(fn).orderBy("addr", F.col("_code").isNotNull())
    before, running = (order.rowsBetween(Window.unboundedPreceding, last) for last in (-1, 0))
    aimed = F.last(F.when(F.col("_code").isNull(), F.col("addr")), True).over(running) == F.col("addr")
    leads = F.coalesce(aimed, F.lit(False)) | F.coalesce(F.last("_code", True).over(before)["ends"], F.lit(True))
    rows = rows.unionByName(known, allowMissingColumns=True).withColumn("_leads", leads).where("_code is not null")
    leader = F.max(F.when(F.col("_leads"), F.col("addr"))).over(Window.partitionBy(fn).orderBy("addr"))
    return rows.withColumn("block", leader).drop("_code", "_leads")


def block_table(blocks: DataFrame, fn: str) -> DataFrame:
    """One row per block: start, end (exclusive) and its count of instructions."""
    found = blocks.groupBy(fn, F.col("block").alias("start"))
    return found.agg(F.max(F.col("addr") + F.col("size")).alias("end"), F.count("*").alias("n_instructions"))


def function_extents(instructions: DataFrame, fn: str) -> DataFrame:
    return instructions.groupBy(fn).agg(F.min("addr").alias("start"), F.max(F.col("addr") + F.col("size")).alias("end"))


def function_intervals(instructions: DataFrame, fn: str) -> DataFrame:
    """The contiguous runs of each function's bytes."""
    spans = instructions.select(fn, F.col("addr").alias("start"), (F.col("addr") + F.col("size")).alias("end"))
    return merge_areas(spans, (fn,))


def backtrack(instructions: DataFrame, fn: str, order: list[str], item: Column, n: int) -> DataFrame:
    """``instructions`` with ``before``: the last ``n`` items ahead of each, oldest first."""
    window = Window.partitionBy(fn).orderBy(*order).rowsBetween(-n, -1)
    return instructions.withColumn("before", F.collect_list(item).over(window))


def split_at(instructions: DataFrame, fn: str, order: list[str], splits: Column) -> DataFrame:
    """``instructions`` with ``part``, the number of split points at or before each in its function."""
    window = Window.partitionBy(fn).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return instructions.withColumn("part", F.count_if(splits).over(window))


def next_boundary(points: DataFrame, starts: DataFrame, at: str, start: str, keys: tuple[str, ...] = (), bucket: int | None = None) -> DataFrame:
    """As-of forward: the smallest start beyond each point, as ``following``; an as-of lookup on negated addresses."""
    turned = starts.select(*keys, (-F.col(start)).alias("_neg"))
    found = locate(points.withColumn("_turned", -F.col(at) - 1), turned, "_turned", "_neg", keys, bucket)
    return found.withColumn("following", -F.col("located")).drop("located", "_turned", "_neg")


def section_of(points: DataFrame, sections: DataFrame, at: str, bucket: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each point with ``section``: of the sections (name, start, end) that hold it, the one that starts first; or null."""
    held = range_join(points.select(*keys, at).distinct(), sections, at, bucket, keys)
    named = held.groupBy(*keys, at).agg(F.min_by("name", F.struct("start", "name")).alias("section"))
    return points.join(named, [*keys, at], "left")


def first_wins(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One value per key, that of the first row in order."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def through_stubs(calls: DataFrame, stubs: DataFrame, slots: DataFrame) -> DataFrame:
    """Two hops: calls (dst) into stubs (stub, slot) that read import slots (slot, name)."""
    return calls.join(stubs, calls.dst == stubs.stub).join(slots, "slot").drop("stub")


def normalised_exports(exports: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """Exports whose addresses all lie below the base are relative to it."""
    top = F.max("addr").over(Window.partitionBy(*keys))
    return exports.withColumn("addr", F.when(top >= base, F.col("addr")).otherwise(F.col("addr") + base))

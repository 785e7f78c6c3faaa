"""Address ranges: joins of points with intervals, as-of lookup, merging, gaps and overlap.

Ranges are half-open, [start, end). Spark plans a theta join as a nested loop; these operators cut addresses into
buckets first, so that Catalyst sees an equi-join with a residual filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_join(points: DataFrame, intervals: DataFrame, at: str, bucket: int, keys: tuple[str, ...] = (), inclusive_end: bool = False) -> DataFrame:
    """Each point beside every interval (columns ``start``, ``end``) that holds it.

    ``bucket``: size of a bucket, about the usual length of an interval. ``keys``: columns that must agree as well.
    """
    last = F.col("end") if inclusive_end else F.col("end") - 1
    lows, highs = F.floor(F.col("start") / bucket), F.floor(last / bucket)
    cut = intervals.where(highs >= lows).withColumn("_bucket", F.explode(F.sequence(lows, highs)))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    inside = (F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end") if inclusive_end else F.col(at) < F.col("end"))
    return placed.join(cut, [*keys, "_bucket"]).where(inside).drop("_bucket")


def overlap_join(left: DataFrame, right: DataFrame, bucket: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals that share an address: (l_start, l_end) of the left, (r_start, r_end) of the right.

    A pair that meets in several buckets is kept in the first of them only, which saves a distinct.
    """

    def cut(df: DataFrame, p: str) -> DataFrame:
        lows, highs = F.floor(F.col(f"{p}_start") / bucket), F.floor((F.col(f"{p}_end") - 1) / bucket)
        return df.where(F.col(f"{p}_end") > F.col(f"{p}_start")).withColumn("_bucket", F.explode(F.sequence(lows, highs)))

    met = cut(left, "l").join(cut(right, "r"), [*keys, "_bucket"])
    met = met.where("l_start < r_end AND r_start < l_end")
    return met.where(F.col("_bucket") == F.floor(F.greatest("l_start", "r_start") / bucket)).drop("_bucket")


def locate(points: DataFrame, blocks: DataFrame, at: str, start: str, keys: tuple[str, ...] = (), bucket: int | None = None) -> DataFrame:
    """As-of: the greatest block start at or below each point, as ``located``.

    Points and starts are merged in order, and the last start carries forward. ``bucket`` splits the order into parts,
    so that no task needs all of it; the last start before a part comes from a table with one row per part.
    """
    keys = list(keys)
    tagged = points.withColumns({"_at": F.col(at), "_start": F.lit(None).cast(blocks.schema[start].dataType), "_point": F.lit(1)})
    starts = blocks.select(*keys, F.col(start).alias("_at"), F.col(start).alias("_start"), F.lit(0).alias("_point"))
    merged = tagged.unionByName(starts, allowMissingColumns=True)
    if bucket is None:
        order = Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
        return merged.withColumn("located", F.last("_start", True).over(order)).where("_point = 1").drop("_at", "_start", "_point")
    merged = merged.withColumn("_part", F.floor(F.col("_at") / bucket))
    order = Window.partitionBy(*keys, "_part").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    here = merged.withColumn("located", F.last("_start", True).over(order)).where("_point = 1")
    parts = merged.groupBy(*keys, "_part").agg(F.max("_start").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.max("_top").over(before).alias("_before"))
    out = here.join(parts, [*keys, "_part"]).withColumn("located", F.coalesce("located", "_before"))
    return out.drop("_at", "_start", "_point", "_part", "_before")


def merge_areas(areas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Areas of each key merged where they touch or overlap (start at or below the end so far)."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = areas.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(running))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def gaps(areas: DataFrame, keys: tuple[str, ...], least: Column | int = 1) -> DataFrame:
    """Holes of at least ``least`` between consecutive areas: gap_start, gap_end, gap_size."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    merged = merge_areas(areas, keys)
    nxt = F.lead("start").over(order)
    return (
        merged.withColumn("gap_end", nxt)
        .where(F.col("gap_end") - F.col("end") >= least)
        .select(*keys, F.col("end").alias("gap_start"), "gap_end", (F.col("gap_end") - F.col("end")).alias("gap_size"))
    )


def overlaps_previous(areas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Areas that start before an earlier one of the key has ended: ``overlap`` bytes."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = areas.withColumn("_reach", F.max("end").over(before))
    return found.where("_reach > start").withColumn("overlap", F.least("_reach", "end") - F.col("start")).drop("_reach")


def in_code_areas(address: Column, areas: Column, base: Column, size: Column) -> Column:
    """Whether an address lies in one of an array of areas; without areas the whole image counts, its end included."""
    listed = F.exists(areas, lambda a: (address >= a["start"]) & (address < a["end"]))
    return F.when(F.size(F.coalesce(areas, F.array())) > 0, listed).otherwise((address >= base) & (address <= base + size))


def in_image(address: Column, base: Column, size: Column) -> Column:
    return (address >= base) & (address < base + size)

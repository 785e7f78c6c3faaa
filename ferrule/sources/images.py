"""Memory images of binaries: raw dumps, mapping of PE and ELF files, segment assembly, reads, header regions, bitness.

An image is a binary column whose first byte lies at ``base``. Mapping puts pieces of the file at their addresses, later
pieces over earlier ones, in a buffer of zeros; images above ``MOST`` bytes are not mapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.binaries import uint

#: Fixed limits: bytes of an image, page size, and most header bytes that are kept by format.
MOST, PAGE = 100 << 20, 0x1000
HEADER_CAPS = {"pe": 0x2000, "elf": 0x1000}
DEX_HEADER = 112


def raw_dumps(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Dumps with what the caller states of them (path, base, bitness, architecture); a DEX magic decides where nothing is stated."""
    dex = F.hex(F.substring("content", 1, 4)) == "6465780A"
    named = files.join(facts, "path", "left")
    return named.withColumn("architecture", F.coalesce("architecture", F.when(dex, "dalvik").otherwise("intel")))


def assemble(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base, image) of pieces (keys, base, start, chunk, layer): zeros between them, what lies below base left out.

    ``layer`` orders what covers what; within a layer the piece with the higher start wins.
    """
    skip = F.greatest(F.col("base") - F.col("start"), F.lit(0)).cast("int")
    cut = pieces.withColumn("chunk", F.substring("chunk", skip + 1, F.octet_length("chunk"))).withColumn(
        "at", (F.greatest("start", "base") - F.col("base")).cast("int")
    )
    cut = cut.where(F.octet_length("chunk") > 0)
    held = cut.groupBy(*keys, "base").agg(
        F.max(F.col("at") + F.octet_length("chunk")).alias("size"), F.array_sort(F.collect_list(F.struct("layer", "at", "chunk"))).alias("parts")
    )
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size")))
    image = F.aggregate("parts", zeros, lambda acc, p: F.overlay(acc, p["chunk"], p["at"] + 1))
    return held.where(F.col("size") <= MOST).select(*keys, "base", image.alias("image"))


def map_pe(headers: DataFrame) -> DataFrame:
    """(binary_id, base, image) of PE files: the headers, then each section's raw bytes at its address."""
    c = F.col("content")
    first = F.array_min(F.transform(F.filter("sections", lambda s: s["raw_at"] > 0), lambda s: s["raw_at"]))
    top = headers.select("binary_id", F.col("image_base").alias("base"), F.col("image_base").alias("start"), F.substring(c, F.lit(1), F.coalesce(first, F.lit(0)).cast("int")).alias("chunk"), F.lit(0).alias("layer"))
    each = headers.select("binary_id", "image_base", c, F.explode("sections").alias("s"))
    size = F.when(F.col("s.vsize") > 0, F.least("s.vsize", "s.raw_size")).otherwise(F.col("s.raw_size"))
    chunk = F.substring(c, F.col("s.raw_at").cast("int") + 1, size.cast("int"))
    body = each.select("binary_id", F.col("image_base").alias("base"), (F.col("image_base") + F.col("s.rva")).alias("start"), chunk.alias("chunk"), F.lit(1).alias("layer"))
    return assemble(top.unionByName(body), ["binary_id"])


def elf_bounds(sections: DataFrame, segments: DataFrame) -> DataFrame:
    """(binary_id, base, low, high): base from sections (address less file place), or from segments where none has an address."""
    own = sections.where("addr > 0").groupBy("binary_id").agg(
        F.min(F.when(F.col("addr") >= F.col("file_at"), F.col("addr") - F.col("file_at"))).alias("from_sections"),
        F.min("addr").alias("s_low"),
        F.max(F.col("addr") + F.col("size")).alias("s_high"),
    )
    other = segments.where("addr > 0").groupBy("binary_id").agg(
        F.min("addr").alias("from_segments"), F.max(F.col("addr") + F.col("size")).alias("g_high")
    )
    both = own.join(other, "binary_id", "full")
    base = F.coalesce("from_sections", "from_segments", F.lit(0).cast("decimal(20,0)"))
    return both.select("binary_id", base.alias("base"), F.least("s_low", "from_segments").alias("low"), F.greatest("s_high", "g_high").alias("high"))


def map_elf(binaries: DataFrame, sections: DataFrame, segments: DataFrame) -> DataFrame:
    """(binary_id, base, image) of ELF files: loaded segments first, then sections with bytes in the file over them."""
    known = elf_bounds(sections, segments).select("binary_id", "base").join(binaries.select("binary_id", "content"), "binary_id")
    loaded = segments.where("type = 1 AND file_size > 0").select("binary_id", "addr", "file_at", F.col("file_size").alias("n"), F.lit(0).alias("layer"))
    held = sections.where("addr > 0 AND type <> 8 AND size > 0").select("binary_id", "addr", "file_at", F.col("size").alias("n"), F.lit(1).alias("layer"))
    placed = loaded.unionByName(held).join(known, "binary_id")
    chunk = F.substring("content", F.col("file_at").cast("int") + 1, F.col("n").cast("int"))
    return assemble(placed.select("binary_id", "base", F.col("addr").alias("start"), chunk.alias("chunk"), "layer"), ["binary_id"])


def read_at(image: Column, base: Column, address: Column, size: int) -> Column:
    """Bytes at an address, null if any lies outside the image."""
    place = (address - base).cast("int")
    got = F.substring(image, place + 1, F.lit(size))
    return F.when((address >= base) & (F.octet_length(got) == size), got)


def number_at(image: Column, base: Column, address: Column, size: int) -> Column:
    """Little-endian number at an address (size 1, 4 or 8), null if it is not whole."""
    return F.when(address >= base, uint(image, (address - base).cast("int"), size))


def _without_zeros(content: Column) -> Column:
    """Bytes up to the last one that is not zero."""
    return F.unhex(F.regexp_extract(F.hex(content), "^((?:..)*?)(?:00)*$", 1))


def header_region(binaries: DataFrame) -> DataFrame:
    """``binaries`` with ``header``: the format's header region, capped, without trailing zeros; null for other formats."""
    c = F.col("content")
    nt = uint(c, 0x3C, 4).cast("int")
    table = nt + 24 + uint(c, nt + 20, 2)
    count = uint(c, nt + 6, 2)
    stated = uint(c, nt + 84, 4)
    starts = F.transform(F.sequence(F.lit(0), F.least(count, F.lit(4096)) - 1), lambda i: uint(c, (table + 40 * i + 20).cast("int"), 4))
    first = F.array_min(F.filter(F.when(count > 0, starts), lambda r: r > 0))
    ends = table + 40 * count
    first = F.coalesce(first, F.when(stated > 0, stated), ends)
    pe = F.greatest(ends, F.when(stated > 0, F.least(stated, first)).otherwise(first))
    wide, big = uint(c, 4, 1) == 2, uint(c, 5, 1) == 2
    pick = lambda a, b: F.when(wide, uint(c, *a, big).cast("long")).otherwise(uint(c, *b, big).cast("long"))
    at, own, step, n = pick((0x20, 8), (0x1C, 4)), pick((0x34, 2), (0x28, 2)), pick((0x36, 2), (0x2A, 2)), pick((0x38, 2), (0x2C, 2))
    elf = F.greatest(own, F.when(at > 0, at + step * n).otherwise(own))
    sizes = {"pe": F.least(pe, F.lit(HEADER_CAPS["pe"])), "elf": F.least(elf, F.lit(HEADER_CAPS["elf"]))}
    cut = lambda name: _without_zeros(F.substring(c, F.lit(1), sizes[name].cast("int")))
    header = F.when(F.col("format") == "pe", cut("pe")).when(F.col("format") == "elf", cut("elf"))
    return binaries.withColumn("header", header.when(F.col("format") == "dex", F.substring(c, 1, DEX_HEADER)))


def probe_bitness(calls: DataFrame, images: DataFrame, scores: DataFrame) -> DataFrame:
    """(binary_id, bitness): the distinct first bytes of call targets weighed by ``scores`` (first, s32, s64); ties are 32."""
    from_calls = calls.select("binary_id", "dst").distinct().join(images, "binary_id")
    firsts = from_calls.select("binary_id", uint(F.col("image"), (F.col("dst") - F.col("base")).cast("int"), 1).alias("first")).distinct()
    summed = firsts.join(F.broadcast(scores), "first", "left").groupBy("binary_id").agg(F.sum("s32").alias("s32"), F.sum("s64").alias("s64"))
    # at most 256 rows of scores: one per byte value
    found = images.select("binary_id").distinct().join(summed, "binary_id", "left").na.fill(0, ["s32", "s64"])
    return found.select("binary_id", F.when(F.col("s64") > F.col("s32"), 64).otherwise(32).alias("bitness"))

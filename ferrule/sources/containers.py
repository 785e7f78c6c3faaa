"""Tables inside container files, as Catalyst expressions: ELF sections, Mach-O slices and segments, DEX maps, .pdata.

Counts in headers are bounded by what the file can hold, so a broken header gives few rows instead of many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.binaries import uint

#: Fixed values of the formats.
ELF_EXECUTE, SEGMENT_32, SEGMENT_64, PROTECT_EXECUTE = 0x4, 0x1, 0x19, 0x4
FAT_MAGIC, MACHO_64 = "CAFEBABE", "CFFAEDFE"


def _up_to(n: Column) -> Column:
    """[0 .. n), empty where n is null or 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def _name(content: Column, at: Column, size: int) -> Column:
    return F.regexp_replace(F.decode(F.substring(content, (at + 1).cast("int"), F.lit(size)), "ISO-8859-1"), "(?s)\\x00.*", "")


def _at(content: Column, at: Column, size: int, big: Column | None = None) -> Column:
    return uint(content, at.cast("int"), size, big)


def _elf_table(binaries: DataFrame, wide_at: tuple, narrow_at: tuple) -> DataFrame:
    """A row per entry of an ELF table: its place, where it starts (``at``), and how numbers are to be read."""
    c = F.col("content")
    wide, big = uint(c, 4, 1) == 2, uint(c, 5, 1) == 2
    pick = lambda i: F.when(wide, uint(c, *wide_at[i], big).cast("long")).otherwise(uint(c, *narrow_at[i], big))
    rows = binaries.where("format = 'elf'").select(
        "binary_id", c, wide.alias("wide"), big.alias("big"), *[pick(i).alias(n) for i, n in enumerate(("table", "step", "n"))],
        F.when(wide, uint(c, 62, 2, big)).otherwise(uint(c, 50, 2, big)).alias("names"),
    )
    fits = F.floor((F.octet_length("content") - F.col("table")) / F.col("step"))
    rows = rows.where("step > 0 AND table > 0").withColumn("place", F.explode(_up_to(F.least("n", fits))))
    return rows.withColumn("at", F.col("table") + F.col("step") * F.col("place"))


def _elf_field(at: Column, wide: tuple, narrow: tuple) -> Column:
    """A field at (offset, size) in entries of 64-bit and of 32-bit files."""
    c, big = F.col("content"), F.col("big")
    kind = "decimal(20,0)" if wide[1] == 8 else "long"
    return F.when(F.col("wide"), _at(c, at + wide[0], wide[1], big)).otherwise(_at(c, at + narrow[0], narrow[1], big).cast(kind))


def elf_sections(binaries: DataFrame) -> DataFrame:
    """(binary_id, place, name, type, flags, addr, file_at, size) of the sections of ELF files."""
    rows = _elf_table(binaries, ((40, 8), (58, 2), (60, 2)), ((32, 4), (46, 2), (48, 2)))
    c, at, big = F.col("content"), F.col("at"), F.col("big")
    low = lambda wide, narrow, base=at: _elf_low(base, wide, narrow)
    names = low(24, 16, F.col("table") + F.col("step") * F.col("names"))
    return rows.select(
        "binary_id",
        "place",
        _name(c, names + _at(c, at, 4, big), 64).alias("name"),
        _at(c, at + 4, 4, big).alias("type"),
        low(8, 8).alias("flags"),
        _elf_field(at, (16, 8), (12, 4)).alias("addr"),
        low(24, 16).alias("file_at"),
        low(32, 20).alias("size"),
    )


def _elf_low(at: Column, wide: int, narrow: int) -> Column:
    """Sizes and places inside files: the low seven bytes of 64-bit fields are enough."""
    c, big = F.col("content"), F.col("big")
    long = F.when(big, _at(c, at + wide + 1, 7, big)).otherwise(_at(c, at + wide, 7))
    return F.when(F.col("wide"), long).otherwise(_at(c, at + narrow, 4, big))


def elf_segments(binaries: DataFrame) -> DataFrame:
    """(binary_id, place, type, flags, file_at, addr, file_size, size) of the segments of ELF files."""
    rows = _elf_table(binaries, ((32, 8), (54, 2), (56, 2)), ((28, 4), (42, 2), (44, 2)))
    c, at, big = F.col("content"), F.col("at"), F.col("big")
    return rows.select(
        "binary_id",
        "place",
        _at(c, at, 4, big).alias("type"),
        F.when(F.col("wide"), _at(c, at + 4, 4, big)).otherwise(_at(c, at + 24, 4, big)).alias("flags"),
        _elf_low(at, 8, 4).alias("file_at"),
        _elf_field(at, (16, 8), (8, 4)).alias("addr"),
        _elf_low(at, 32, 16).alias("file_size"),
        _elf_low(at, 40, 20).alias("size"),
    )


def elf_code_areas(sections: DataFrame) -> DataFrame:
    from ferrule.operators.ranges import merge_areas

    held = sections.where((F.col("flags").bitwiseAND(F.lit(ELF_EXECUTE)) != 0) & (F.col("size") > 0))
    return merge_areas(held.select("binary_id", F.col("addr").alias("start"), (F.col("addr") + F.col("size")).alias("end")), ("binary_id",))


def macho_slices(binaries: DataFrame) -> DataFrame:
    """Each architecture of Mach-O files: fat files give a row per slice, thin ones one row with ``slice`` 0."""
    c = F.col("content")
    big = lambda at: F.conv(F.hex(F.substring(c, at.cast("int") + 1, F.lit(4))), 16, 10).cast("long")
    files = binaries.where("format = 'macho'")
    fat = F.hex(F.substring(c, 1, 4)) == FAT_MAGIC
    count = F.when(fat, F.least(big(F.lit(4)), F.floor((F.octet_length("content") - 8) / 20))).otherwise(F.lit(1).cast("long"))
    rows = files.select("binary_id", c, fat.alias("_fat"), F.explode(_up_to(count)).alias("slice"))
    at = 8 + 20 * F.col("slice")
    part = F.substring(c, big(at + 8).cast("int") + 1, big(at + 12).cast("int"))
    return rows.select("binary_id", "slice", F.when(F.col("_fat"), part).otherwise(c).alias("content"))


def macho_segments(slices: DataFrame) -> DataFrame:
    """(binary_id, slice, cpu, name, addr, size, file_at, file_size, executable) of the segments of each slice."""
    c = F.col("content")
    wide = F.hex(F.substring(c, 1, 4)) == MACHO_64
    n = F.least(uint(c, 16, 4), F.floor(F.octet_length("content") / 8))
    start = F.struct(F.when(wide, 32).otherwise(28).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found"))

    def step(acc, _):
        size = _at(c, acc["at"] + 4, 4)
        return F.struct((acc["at"] + F.coalesce(size, F.lit(0))).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))

    commands = F.aggregate(_up_to(n), start, step, lambda acc: F.array_distinct(acc["found"]))
    rows = slices.select("binary_id", "slice", c, wide.alias("wide"), uint(c, 4, 4).alias("cpu"), F.explode(commands).alias("at"))
    at = F.col("at")
    rows = rows.where(_at(c, at, 4) == F.when(F.col("wide"), SEGMENT_64).otherwise(SEGMENT_32))
    field = lambda a, b: F.when(F.col("wide"), _at(c, at + a, 7)).otherwise(_at(c, at + b, 4))
    protect = F.when(F.col("wide"), _at(c, at + 60, 4)).otherwise(_at(c, at + 44, 4))
    return rows.select(
        "binary_id",
        "slice",
        "cpu",
        _name(c, at + 8, 16).alias("name"),
        F.when(F.col("wide"), _at(c, at + 24, 8)).otherwise(_at(c, at + 24, 4).cast("decimal(20,0)")).alias("addr"),
        field(32, 28).alias("size"),
        field(40, 32).alias("file_at"),
        field(48, 36).alias("file_size"),
        (protect.bitwiseAND(F.lit(PROTECT_EXECUTE)) != 0).alias("executable"),
    )


def dex_headers(binaries: DataFrame) -> DataFrame:
    """Counts and places that the header of DEX files states."""
    c = F.col("content")
    fields = {"file_size": 32, "map_at": 52, "n_strings": 56, "n_types": 64, "n_protos": 72, "n_fields": 80, "n_methods": 88, "n_classes": 96}
    version = F.regexp_extract(F.decode(F.substring(c, 5, 3), "ISO-8859-1"), "[0-9]+", 0)
    return binaries.where("format = 'dex'").withColumns({"version": version} | {n: uint(c, at, 4) for n, at in fields.items()})


def dex_map(headers: DataFrame) -> DataFrame:
    """(binary_id, place, type, n, file_at): the map list of DEX files."""
    c, at = F.col("content"), F.col("map_at")
    n = F.least(_at(c, at, 4), F.floor((F.octet_length("content") - at) / 12))
    rows = headers.where("map_at > 0").select("binary_id", c, at, F.explode(_up_to(n)).alias("place"))
    spot = at + 4 + 12 * F.col("place")
    return rows.select("binary_id", "place", _at(c, spot, 2).alias("type"), _at(c, spot + 4, 4).alias("n"), _at(c, spot + 8, 4).alias("file_at"))


def pdata_functions(headers: DataFrame) -> DataFrame:
    """(binary_id, start, end, unwind): function ranges that the exception table (.pdata) of 64-bit PE files states."""
    c = F.col("content")
    found = headers.where("machine = 34404").select("binary_id", c, "image_base", F.explode("sections").alias("s")).where("s.name = '.pdata'")
    size = F.least(F.col("s.raw_size"), F.octet_length("content") - F.col("s.raw_at"))
    rows = found.withColumn("i", F.explode(_up_to(F.floor(size / 12))))
    at = F.col("s.raw_at") + 12 * F.col("i")
    begin, end = _at(c, at, 4), _at(c, at + 4, 4)
    rows = rows.where((begin > 0) & (end > begin))
    base = F.col("image_base")
    return rows.select("binary_id", (base + begin).alias("start"), (base + end).alias("end"), (base + _at(c, at + 8, 4)).alias("unwind"))

"""Binaries as tables: files or any frame with a binary column, format dispatch and header fields.

Everything here is a Catalyst expression over the ``content`` column; numbers are read little-endian by swapping hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of Spark's ``binaryFile`` source, needed for streams.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

#: Fixed magic number of fat Mach-O files, and the least number after it that is a version of a Java class file instead of a
#: count of slices.
FAT_MAGIC, JAVA_FROM = "CAFEBABE", 0x2B
#: Fixed magic numbers at the start of a file, in order of dispatch.
MAGIC = (("pe", "4D5A"), ("elf", "7F454C46"), ("macho", "CFFAEDFE"), ("macho", "CEFAEDFE"), ("macho", FAT_MAGIC), ("dex", "6465780A"))
#: Fixed machine numbers of PE files with their bitness.
PE_MACHINES = ((0x14C, 32), (0x8664, 64), (0xAA64, 64))
#: Fixed numbers of ELF ABIs.
ELF_ABIS = ((0, "sysv"), (3, "linux"), (6, "solaris"), (9, "freebsd"), (12, "openbsd"))
PE_EXECUTE, PE_PAGE = 0x20000000, 0x1000


def uint(content: Column, at: Column | int, size: int, big: Column | None = None) -> Column:
    """Unsigned number at a byte offset, little-endian unless ``big``; null beyond the end. Eight bytes give a decimal."""
    at = F.lit(at) if isinstance(at, int) else at
    whole = F.substring(content, at + 1, F.lit(size)) if isinstance(at, Column) else F.substring(content, at + 1, size)
    digits = F.hex(whole)
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    ordered = swapped if big is None else F.when(big, digits).otherwise(swapped)
    kind = "long" if size < 8 else "decimal(20,0)"
    return F.when(F.length(digits) == 2 * size, F.conv(ordered, 16, 10).cast(kind))


def dispatch(content: Column) -> Column:
    """Name of the format, or null. Java class files share the magic number of fat Mach-O files and are none."""
    out = None
    for name, magic in MAGIC:
        hit = F.hex(F.substring(content, 1, len(magic) // 2)) == magic
        if magic == FAT_MAGIC:
            hit &= F.coalesce(uint(content, 4, 4, F.lit(True)) < JAVA_FROM, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def with_identity(files: DataFrame) -> DataFrame:
    """Adds binary_id (SHA-256), sha1, md5, size, format, and the base address that a name like ``x_0x00400000`` states."""
    base = F.regexp_extract(F.col("path"), "_0x([0-9a-fA-F]{8,16})", 1)
    return files.withColumns(
        {
            "binary_id": F.sha2("content", 256),
            "sha1": F.sha1("content"),
            "md5": F.md5("content"),
            "binary_size": F.octet_length("content").cast("long"),
            "format": dispatch(F.col("content")),
            "named_base": F.when(base != "", F.conv(base, 16, 10).cast("decimal(20,0)")),
        }
    )


def read_binaries(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return with_identity(reader.load(path))


def pe_headers(binaries: DataFrame) -> DataFrame:
    """Machine, bitness, image base, entry point and sections of the PE files among ``binaries``."""
    c = F.col("content")
    pe = binaries.where("format = 'pe'").withColumn("_nt", uint(c, 0x3C, 4))
    pe = pe.where(F.hex(F.substring(c, F.col("_nt") + 1, F.lit(4))) == "50450000")
    nt = F.col("_nt")
    machine = uint(c, nt + 4, 2)
    bits = F.coalesce(*[F.when(machine == m, b) for m, b in PE_MACHINES])
    wide = uint(c, nt + 24, 2) == 0x20B
    table = nt + 24 + uint(c, nt + 20, 2)

    def section(i: Column) -> Column:
        at = table + 40 * i
        name = F.regexp_replace(F.decode(F.substring(c, at + 1, F.lit(8)), "ISO-8859-1"), "\\x00.*", "")
        fields = {"vsize": 8, "rva": 12, "raw_size": 16, "raw_at": 20, "flags": 36}
        return F.struct(name.alias("name"), *[uint(c, at + o, 4).alias(n) for n, o in fields.items()])

    count = uint(c, nt + 6, 2)
    return pe.withColumns(
        {
            "machine": machine,
            "bitness": bits,
            "image_base": F.when(wide, uint(c, nt + 48, 8)).otherwise(uint(c, nt + 52, 4).cast("decimal(20,0)")),
            "entry_rva": uint(c, nt + 40, 4),
            "abi": F.lit(""),  # the format states none
            "sections": F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), section)).otherwise(F.array()),
        }
    ).drop("_nt")


def pe_code_areas(headers: DataFrame) -> DataFrame:
    """(binary_id, start, end) of executable sections, sizes rounded up to a page, merged where they touch."""
    from ferrule.operators.ranges import merge_areas

    s = headers.select("binary_id", "image_base", F.explode("sections").alias("s")).where(F.col("s.flags").bitwiseAND(F.lit(PE_EXECUTE)) != 0)
    size = F.ceil(F.greatest("s.vsize", "s.raw_size") / PE_PAGE) * PE_PAGE
    start = F.col("image_base") + F.col("s.rva")
    return merge_areas(s.select("binary_id", start.alias("start"), (start + size).alias("end")), ("binary_id",))


def elf_headers(binaries: DataFrame) -> DataFrame:
    c = F.col("content")
    wide, big = uint(c, 4, 1) == 2, uint(c, 5, 1) == 2
    pick = lambda a, b: F.when(wide, uint(c, *a, big).cast("decimal(20,0)")).otherwise(uint(c, *b, big).cast("decimal(20,0)"))
    abi = uint(c, 7, 1)
    return binaries.where("format = 'elf'").withColumns(
        {
            "bitness": F.when(wide, 64).otherwise(32),
            "big_endian": big,
            "machine": uint(c, 18, 2, big),
            "abi": F.coalesce(*[F.when(abi == number, name) for number, name in ELF_ABIS]),
            "entry": pick((24, 8), (24, 4)),
            "n_segments": pick((56, 2), (44, 2)).cast("long"),
        }
    )


def words(images: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """(binary_id, addr, word): the aligned 32-bit words of images (binary_id, base, image), chunk by chunk."""
    n = F.octet_length("image")
    cut = images.where(n >= 4).select(
        "binary_id", "base", "image", F.explode(F.sequence(F.lit(0), n - 4, F.lit(chunk))).alias("_at")
    )
    part = cut.select("binary_id", "base", "_at", F.substring("image", F.col("_at") + 1, F.lit(chunk)).alias("_part"))
    spots = F.sequence(F.lit(0), F.octet_length("_part") - 4, F.lit(4))
    each = part.where(F.octet_length("_part") >= 4).select("binary_id", "base", "_at", "_part", F.explode(spots).alias("_i"))
    return each.select(
        "binary_id",
        (F.col("base") + F.col("_at") + F.col("_i")).cast("long").alias("addr"),
        uint(F.col("_part"), F.col("_i"), 4).alias("word"),
    )

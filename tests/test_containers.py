"""Container tables and scalar helpers on files built field by field."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ferrule.functions import scalars
from ferrule.operators.blocks import derive_blocks, next_boundary
from ferrule.sources import binaries, containers


def identified(spark, *contents: bytes):
    rows = [(f"f{i}", bytearray(c)) for i, c in enumerate(contents)]
    return binaries.with_identity(spark.createDataFrame(rows, "path string, content binary"))


def elf_file() -> bytes:
    names = b"\0.text\0.data\0.shstrtab\0"
    head = bytearray(64)
    head[:6] = b"\x7fELF\x02\x01"
    table = 64 + len(names)
    struct.pack_into("<Q", head, 40, table)
    struct.pack_into("<HHH", head, 58, 64, 4, 3)
    rows = [(0, 0, 0, 0, 0, 0), (1, 1, 6, 0x1000, 0, 0x20), (7, 1, 3, 0x2000, 0, 0x10), (13, 3, 0, 0, 64, len(names))]
    return bytes(head) + names + b"".join(struct.pack("<IIQQQQ24x", *r) for r in rows)


def macho_file() -> bytes:
    segment = struct.pack("<II16sQQQQIIII", 0x19, 72, b"__TEXT", 0x100000000, 0x4000, 0, 0x4000, 5, 5, 0, 0)
    other = struct.pack("<II16sQQQQIIII", 0x19, 72, b"__DATA", 0x100004000, 0x4000, 0x4000, 0x10, 3, 3, 0, 0)
    uuid = struct.pack("<II16x", 0x1B, 24)
    return struct.pack("<IIIIIIII", 0xFEEDFACF, 0x100000C, 0, 2, 3, 168, 0, 0) + segment + uuid + other


def test_elf_sections_and_areas(spark):
    found = containers.elf_sections(identified(spark, elf_file(), b"\x7fELF", elf_file()[:90]))
    rows = [(r.name, r.flags, r.addr, r.size) for r in found.orderBy("place").collect()]
    assert rows == [("", 0, 0, 0), (".text", 6, 0x1000, 0x20), (".data", 3, 0x2000, 0x10), (".shstrtab", 0, 0, 23)]
    assert [(r.start, r.end) for r in containers.elf_code_areas(found).collect()] == [(0x1000, 0x1020)]


def test_macho_thin_and_fat(spark):
    thin = macho_file()
    fat = struct.pack(">II", 0xCAFEBABE, 2) + b"".join(struct.pack(">IIIII", 1, 0, 48 + k * len(thin), len(thin), 0) for k in range(2)) + thin * 2
    slices = containers.macho_slices(identified(spark, thin, fat))
    segments = containers.macho_segments(slices)
    assert slices.count() == 3 and segments.count() == 6
    assert {(r.name, r.addr, r.size, r.executable, r.cpu) for r in segments.collect()} == {
        ("__TEXT", 0x100000000, 0x4000, True, 0x100000C),
        ("__DATA", 0x100004000, 0x4000, False, 0x100000C),
    }
    cut = containers.macho_segments(containers.macho_slices(identified(spark, thin[:40])))
    assert all(r.name == "__TEXT"[: len(r.name)] for r in cut.collect())


def test_dex_header_and_map(spark):
    head = bytearray(112)
    head[:8] = b"dex\n035\0"
    struct.pack_into("<I", head, 52, 112)
    struct.pack_into("<I", head, 88, 7)
    entries = struct.pack("<I", 2) + struct.pack("<HHII", 0, 0, 1, 0) + struct.pack("<HHII", 0x2001, 0, 9, 64)
    headers = containers.dex_headers(identified(spark, bytes(head) + entries))
    assert (headers.first().version, headers.first().n_methods) == ("035", 7)
    assert [(r.type, r.n, r.file_at) for r in containers.dex_map(headers).orderBy("place").collect()] == [(0, 1, 0), (0x2001, 9, 64)]


def test_pdata_functions(spark):
    content = b"\0" * 8 + struct.pack("<IIIIII", 0x1000, 0x1040, 0x5000, 0, 0, 0)
    rows = [("b", bytearray(content), 0x8664, 0x140000000, [(".pdata", 8, 24)])]
    schema = "binary_id string, content binary, machine long, image_base long, sections array<struct<name:string,raw_at:long,raw_size:long>>"
    got = containers.pdata_functions(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [("b", 0x140001000, 0x140001040, 0x140005000)]


def test_scalars(spark):
    image = b"\0hello\0w\0o\0\0\0\xe5\x8e\x26\x7f"
    row = spark.createDataFrame([(bytearray(image),)], "i binary").select(
        scalars.ascii_length(F.col("i"), F.lit(1)).alias("a"),
        scalars.ascii_length(F.col("i"), F.lit(14)).alias("none"),
        scalars.utf16_length(F.col("i"), F.lit(7)).alias("w"),
        scalars.uleb128(F.col("i"), F.lit(13)).alias("u"),
        scalars.uleb128(F.col("i"), F.lit(16)).alias("one"),
        (scalars.version_key(F.lit("v1.10")) > scalars.version_key(F.lit("1.9.9"))).alias("later"),
        scalars.flag_names(F.lit(0x19)).alias("flags"),
    )
    assert tuple(row.first()) == (5, 0, 2, 624485, 127, True, "public static final")


def test_blocks_without_targets_and_boundaries_at_ends(spark):
    code = spark.createDataFrame([(1, 0, 4, False), (1, 4, 4, True), (1, 8, 4, False)], "fn long, addr long, size int, ends boolean")
    none = spark.createDataFrame([], "fn long, dst long")
    assert [r.block for r in derive_blocks(code, none, "fn", F.col("ends")).orderBy("addr").collect()] == [0, 0, 8]
    points, starts = spark.createDataFrame([(3,), (8,), (9,)], "at long"), spark.createDataFrame([(3,), (8,)], "s long")
    assert {r["at"]: r.following for r in next_boundary(points, starts, "at", "s").collect()} == {3: 8, 8: None, 9: None}


def test_java_class_files_are_no_fat_files(spark):
    rows = [("fat", "CAFEBABE00000002"), ("java", "CAFEBABE00000034"), ("preview", "CAFEBABEFFFF0041"), ("cut", "CAFEBABE")]
    found = spark.createDataFrame(rows, "name string, code string").select("name", binaries.dispatch(F.unhex("code")).alias("format"))
    assert {r.name: r.format for r in found.collect()} == {"fat": "macho", "java": None, "preview": None, "cut": None}

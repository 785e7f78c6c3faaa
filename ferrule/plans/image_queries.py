"""Queries on bytes: files and images are built from rows of the standard tables, then read by the engine's operators.

The oracles state what the rows put into the bytes, so a reader that errs by a byte shows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import scalars, sql
from ferrule.operators import hashes, ranges, scans, text
from ferrule.operators.escapes import little_endian
from ferrule.plans.registry import query, table
from ferrule.session import checkpoint_dir, staged
from ferrule.sources import binaries, containers, images, reports, sinks
from ferrule.streaming import ingest

BASE = 0x400000


def longs(sql: str, *columns: str) -> str:
    """The oracle with columns of literals widened to what the engine returns."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in columns)}) FROM ({sql})"


def le(value: Column | int, size: int) -> Column:
    return little_endian(F.lit(value).cast("long") if isinstance(value, int) else value.cast("long"), size)


def zeros(n: int) -> Column:
    return F.lit("00" * n)


def ascii_hex(name: str, size: int) -> Column:
    return F.lit(name.encode().hex().ljust(2 * size, "0"))


def joined(*parts: Column) -> Column:
    return F.unhex(F.concat(*parts))


def _files(df: DataFrame, key: str, content: Column) -> DataFrame:
    """The built files, written to the shared folder and scanned, so that building them is no part of reading them."""
    made = df.select(F.col(key).alias("binary_id"), content.alias("content"), *[c for c in df.columns if c != key])
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    made.write.parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path).withColumn("format", binaries.dispatch(F.col("content")))


def _parts(spark, sf_dir: str) -> DataFrame:
    """Dealt over all cores: few bytes, which are read as one piece, but much to build from them."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name").repartition(4 * spark.sparkContext.defaultParallelism)


# --- ELF


def _elf(spark, sf_dir: str) -> DataFrame:
    """64-bit files with a segment and two sections; the code is the part's name, the entry has its top bytes set."""
    code, k = F.hex(F.encode("p_name", "UTF-8")), F.col("p_partkey")
    n = F.length(code) / 2
    machine = F.when(F.col("p_size") % 2 == 0, 62).otherwise(183)
    head = F.concat(
        F.lit("7F454C46020101"), le(F.col("p_size") % 4, 1), zeros(8), le(2, 2), le(machine, 2), le(1, 4), le(k, 5), F.lit("80FFFF"),
        le(64, 8), le(120, 8), le(0, 4), le(64, 2), le(56, 2), le(1, 2), le(64, 2), le(2, 2), le(1, 2),
    )
    segment = F.concat(le(1, 4), le(5, 4), le(0, 8), le(BASE, 8), le(BASE, 8), le(n + 264, 8), le(n + 264, 8), le(4096, 8))
    body = lambda name, kind, flags, addr, at, size: F.concat(le(name, 4), le(kind, 4), le(flags, 8), le(addr, 8), le(at, 8), le(size, 8), zeros(24))
    sections = F.concat(body(1, 1, 6, BASE + 264, 264, n), body(7, 3, 0, 0, 248, F.lit(16)))
    return _files(_parts(spark, sf_dir), "p_partkey", joined(head, segment, sections, ascii_hex("\0.text\0.names", 16), code))


@query(
    "elf_headers",
    longs(
        f"""SELECT p_partkey AS binary_id, CAST(64 AS INTEGER) AS bitness, CASE WHEN p_size % 2 = 0 THEN 62 ELSE 183 END AS machine,
        CAST(CAST(p_partkey AS HUGEINT) + 18446603336221196288 AS VARCHAR) AS entry, CASE p_size % 4 WHEN 0 THEN 'sysv' WHEN 3 THEN 'linux' END AS abi,
        1 AS n_segments FROM part""",
        "machine", "n_segments",
    ),
)
def elf_headers(spark, sf_dir):
    found = binaries.elf_headers(_elf(spark, sf_dir))
    return found.select("binary_id", "bitness", "machine", F.col("entry").cast("string").alias("entry"), "abi", "n_segments")


@query(
    "elf_sections",
    longs(
        f"""SELECT p_partkey AS binary_id, '.text' AS name, 6 AS flags, {BASE + 264} AS addr, 264 AS file_at, length(p_name) AS size FROM part
        UNION ALL SELECT p_partkey, '.names', 0, 0, 248, 16 FROM part""",
        "flags", "addr", "file_at", "size",
    ),
)
def elf_sections(spark, sf_dir):
    found = containers.elf_sections(_elf(spark, sf_dir))
    return found.select("binary_id", "name", "flags", F.col("addr").cast("long").alias("addr"), "file_at", "size")


@query("elf_code_areas", f'SELECT p_partkey AS binary_id, CAST({BASE + 264} AS BIGINT) AS "start", {BASE + 264} + length(p_name) AS "end" FROM part')
def elf_code_areas(spark, sf_dir):
    found = containers.elf_code_areas(containers.elf_sections(_elf(spark, sf_dir)))
    return found.select("binary_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("elf_bounds", f"SELECT p_partkey AS binary_id, CAST({BASE} AS BIGINT) AS base, CAST({BASE} AS BIGINT) AS low, {BASE + 264} + length(p_name) AS high FROM part")
def elf_bounds(spark, sf_dir):
    files = _elf(spark, sf_dir)
    found = images.elf_bounds(containers.elf_sections(files), containers.elf_segments(files))
    return found.select("binary_id", *[F.col(c).cast("long").alias(c) for c in ("base", "low", "high")])


@query("elf_map", f"SELECT p_partkey AS binary_id, {264} + length(p_name) AS size, p_name AS code, CAST(263 AS BIGINT) AS zero_at FROM part")
def elf_map(spark, sf_dir):
    files = _elf(spark, sf_dir)
    mapped = images.map_elf(files, containers.elf_sections(files), containers.elf_segments(files))
    zero = F.when(images.number_at(F.col("image"), F.col("base"), F.lit(BASE + 263), 1) == 0, F.lit(263).cast("long"))
    code = F.decode(F.substring("image", F.lit(265), F.octet_length("image")), "UTF-8")
    return mapped.select("binary_id", F.octet_length("image").cast("long").alias("size"), code.alias("code"), zero.alias("zero_at"))


@query(
    "header_bytes",
    "SELECT p_partkey AS binary_id, CAST(114 AS BIGINT) AS size, '7F454C46' AS magic FROM part",
)
def header_bytes(spark, sf_dir):
    found = images.header_region(_elf(spark, sf_dir))
    return found.select("binary_id", F.octet_length("header").cast("long").alias("size"), F.hex(F.substring("header", 1, 4)).alias("magic"))


# --- PE


def _pe(spark, sf_dir: str) -> DataFrame:
    """64-bit files with one executable section; the time stamp is the part's size, the image base has its top byte set."""
    code = F.hex(F.encode("p_name", "UTF-8"))
    n = F.length(code) / 2
    head = F.concat(F.lit("4D5A"), zeros(58), le(0x80, 4), zeros(64), F.lit("50450000"), le(0x8664, 2), le(1, 2), le(F.col("p_size"), 4), zeros(8), le(240, 2), zeros(2))
    option = F.concat(le(0x20B, 2), zeros(14), le(0x1000, 4), zeros(4), le(F.col("p_partkey"), 6), F.lit("00F1"), zeros(28), le(512, 4), zeros(176))
    section = F.concat(ascii_hex(".text", 8), le(n, 4), le(0x1000, 4), le(n, 4), le(512, 4), zeros(12), le(0x60000020, 4))
    return _files(_parts(spark, sf_dir), "p_partkey", joined(head, option, section, zeros(80), code))


PE_BASE = 0xF1 << 56


@query(
    "pe_headers",
    longs(
        f"""SELECT p_partkey AS binary_id, 34404 AS machine, CAST(64 AS INTEGER) AS bitness, CAST(CAST(p_partkey AS HUGEINT) + {PE_BASE} AS VARCHAR) AS image_base,
        4096 AS entry_rva, '.text' AS name, length(p_name) AS vsize, '' AS abi FROM part""",
        "machine", "entry_rva",
    ),
)
def pe_headers(spark, sf_dir):
    found = binaries.pe_headers(_pe(spark, sf_dir))
    return found.select(
        "binary_id", "machine", "bitness", F.col("image_base").cast("string").alias("image_base"), "entry_rva",
        F.col("sections")[0]["name"].alias("name"), F.col("sections")[0]["vsize"].alias("vsize"), "abi",
    )


@query(
    "pe_code_areas",
    f"""SELECT p_partkey AS binary_id, CAST(CAST(p_partkey AS HUGEINT) + {PE_BASE + 4096} AS VARCHAR) AS "start",
        CAST(CAST(p_partkey AS HUGEINT) + {PE_BASE + 8192} AS VARCHAR) AS "end" FROM part""",
)
def pe_code_areas(spark, sf_dir):
    found = binaries.pe_code_areas(binaries.pe_headers(_pe(spark, sf_dir)))
    text_of = lambda c: F.col(c).cast("decimal(20,0)").cast("string").alias(c)
    return found.select("binary_id", text_of("start"), text_of("end"))


@query("pe_map", "SELECT p_partkey AS binary_id, 4096 + length(p_name) AS size, p_name AS code FROM part")
def pe_map(spark, sf_dir):
    mapped = images.map_pe(binaries.pe_headers(_pe(spark, sf_dir)))
    code = F.decode(F.substring("image", F.lit(4097), F.octet_length("image")), "UTF-8")
    return mapped.select("binary_id", F.octet_length("image").cast("long").alias("size"), code.alias("code"))


@query("pe_header_hash", "SELECT length(p_name) AS size, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS hashes FROM part GROUP BY ALL")
def pe_header_hash(spark, sf_dir):
    """Headers that differ in time stamp and base only: with both zeroed, one hash per size of the section."""
    header = images.header_region(_pe(spark, sf_dir))
    digest = hashes.pe_header_hash(F.col("header"), [(0x88, 4), (0xB0, 8)])
    size = F.octet_length("content").cast("long") - 512
    return header.select(size.alias("size"), digest.alias("h")).groupBy("size").agg(F.count("*").alias("n"), F.countDistinct("h").alias("hashes"))


@query(
    "pdata_functions",
    "SELECT o_orderkey AS binary_id, o_orderkey + o_custkey AS \"start\", o_orderkey + o_custkey + 16 AS \"end\", o_orderkey + 7 AS unwind FROM orders WHERE o_custkey > 0",
)
def pdata_functions(spark, sf_dir):
    """The exception table of a section at the file's start: one entry per file."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    entry = joined(le(F.col("o_custkey"), 4), le(F.col("o_custkey") + 16, 4), le(7, 4))
    section = F.struct(F.lit(".pdata").alias("name"), F.lit(12).cast("long").alias("raw_size"), F.lit(0).cast("long").alias("raw_at"))
    headers = orders.select(
        F.col("o_orderkey").alias("binary_id"), entry.alias("content"), F.lit(34404).alias("machine"), F.col("o_orderkey").alias("image_base"), F.array(section).alias("sections")
    )
    return containers.pdata_functions(headers)


# --- DEX, Mach-O, identity


def _dex(spark, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    head = F.concat(F.lit("6465780A30333500"), zeros(24), le(140, 4), zeros(16), le(112, 4), le(k, 4), zeros(4), le(s, 4), zeros(4), le(1, 4), zeros(4), le(2, 4), zeros(4), le(3, 4), zeros(4), le(4, 4), zeros(12))
    entries = F.concat(le(2, 4), le(1, 2), zeros(2), le(k, 4), le(112, 4), le(0x2000, 2), zeros(2), le(s, 4), le(200, 4))
    return _files(parts, "p_partkey", joined(head, entries))


@query(
    "dex_headers",
    longs(
        """SELECT p_partkey AS binary_id, '035' AS version, 140 AS file_size, 112 AS map_at, p_partkey AS n_strings, p_size AS n_types,
       3 AS n_methods, 4 AS n_classes FROM part""",
        "file_size", "map_at", "n_types", "n_methods", "n_classes",
    ),
)
def dex_headers(spark, sf_dir):
    return containers.dex_headers(_dex(spark, sf_dir)).select("binary_id", "version", "file_size", "map_at", "n_strings", "n_types", "n_methods", "n_classes")


@query(
    "dex_map",
    longs(
        """SELECT p_partkey AS binary_id, 0 AS place, 1 AS type, p_partkey AS n, 112 AS file_at FROM part
       UNION ALL SELECT p_partkey, 1, 8192, p_size, 200 FROM part""",
        "place", "type", "file_at", "n",
    ),
)
def dex_map(spark, sf_dir):
    return containers.dex_map(containers.dex_headers(_dex(spark, sf_dir)))


@query(
    "macho_segments",
    longs(
        """SELECT p_partkey AS binary_id, i AS slice, 16777223 + i AS cpu, '__TEXT' AS name, p_partkey * 4096 AS addr, p_size AS size, i = 1 AS executable
       FROM part, (VALUES (0), (1)) AS v(i)""",
        "slice", "cpu", "size",
    ),
)
def macho_segments(spark, sf_dir):
    """Fat files of two slices, each with one segment; the second one's is executable."""
    k, s = F.col("p_partkey"), F.col("p_size")
    big = lambda v: F.lit(f"{v:08X}")

    def thin(i: int) -> Column:
        segment = F.concat(le(0x19, 4), le(72, 4), ascii_hex("__TEXT", 16), le(k * 4096, 8), le(s, 8), le(0, 8), le(s, 8), le(7, 4), le(4 * i, 4), zeros(8))
        return F.concat(F.lit("CFFAEDFE"), le(16777223 + i, 4), zeros(8), le(1, 4), le(72, 4), zeros(8), segment)

    arch = lambda i: F.concat(zeros(8), big(48 + 104 * i), big(104), zeros(4))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    files = _files(parts, "p_partkey", joined(big(0xCAFEBABE), big(2), arch(0), arch(1), thin(0), thin(1)))
    found = containers.macho_segments(containers.macho_slices(files))
    return found.select("binary_id", "slice", "cpu", "name", F.col("addr").cast("long").alias("addr"), "size", "executable")


@query(
    "binary_identity",
    """SELECT doc_id, sha256(text) AS binary_id, sha1(text) AS sha1, md5(text) AS md5, strlen(text) AS binary_size, 4194304 + doc_id AS named_base
       FROM documents WHERE text IS NOT NULL""",
)
def binary_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    name = F.concat(F.lit("dump_0x"), F.lower(F.lpad(F.hex(F.col("doc_id") + BASE), 8, "0")))
    found = binaries.with_identity(docs.select("doc_id", F.encode("text", "UTF-8").alias("content"), name.alias("path")))
    return found.select("doc_id", "binary_id", "sha1", "md5", "binary_size", F.col("named_base").cast("long").alias("named_base"))


@query("magic_dispatch", "SELECT format, CAST(count(*) AS BIGINT) AS n FROM part, (VALUES ('pe'), ('elf'), ('dex')) AS v(format) GROUP BY format")
def magic_dispatch(spark, sf_dir):
    every = [f(spark, sf_dir).select("format") for f in (_pe, _elf, _dex)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("format").agg(F.count("*").alias("n"))


@query(
    "raw_dumps",
    "SELECT p_partkey AS binary_id, 'dalvik' AS architecture, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 16 ELSE -1 END AS base FROM part",
)
def raw_dumps(spark, sf_dir):
    dumps = _dex(spark, sf_dir).withColumnRenamed("binary_id", "path").select("path", "content")
    facts = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") * 16).alias("base"), F.lit(None).cast("string").alias("architecture"))
    return images.raw_dumps(dumps, facts).select(F.col("path").alias("binary_id"), "architecture", F.coalesce("base", F.lit(-1).cast("long")).alias("base"))


# --- images, words and scans


@query(
    "segment_assembly",
    """SELECT l_orderkey AS binary_id, CAST(10 * max(l_linenumber) + 4 AS BIGINT) AS size, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS held
       FROM lineitem GROUP BY l_orderkey""",
)
def segment_assembly(spark, sf_dir):
    """Four bytes of each line at ten times its number; the rest is zeros."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    at = (F.col("l_linenumber") * 10).cast("long")
    pieces = lines.select(F.col("l_orderkey").alias("binary_id"), F.lit(0).cast("long").alias("base"), at.alias("start"), F.unhex(F.lit("AABBCCDD")).alias("chunk"), F.lit(0).alias("layer"))
    whole = images.assemble(pieces, ["binary_id"])
    digits = F.hex("image")
    held = (F.length(digits) - F.length(F.replace(digits, F.lit("AABBCCDD"), F.lit("")))) / 8
    return whole.select("binary_id", F.octet_length("image").cast("long").alias("size"), held.cast("long").alias("held"))


@query(
    "memory_reads",
    """SELECT o_orderkey, CASE WHEN k <= 11 THEN CAST(o_orderkey % 256 AS BIGINT) ELSE -1 END AS byte, CASE WHEN k <= 8 THEN o_orderkey % 256 * 16843009 ELSE -1 END AS dword,
       CASE WHEN k <= 4 THEN CAST(CAST(o_orderkey % 256 AS HUGEINT) * 72340172838076673 AS VARCHAR) ELSE '-1' END AS qword
       FROM (SELECT o_orderkey, o_custkey % 16 AS k FROM orders)""",
)
def memory_reads(spark, sf_dir):
    image = F.unhex(F.repeat(F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0"), F.lit(12)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", image.alias("image"), F.lit(BASE).alias("base"), (BASE + F.col("o_custkey") % 16).alias("at"))
    number = lambda n: images.number_at(F.col("image"), F.col("base"), F.col("at"), n)
    none = F.lit(-1).cast("long")
    return rows.select("o_orderkey", F.coalesce(number(1), none).alias("byte"), F.coalesce(number(4), none).alias("dword"), F.coalesce(number(8).cast("string"), F.lit("-1")).alias("qword"))


def _words(spark, sf_dir: str) -> DataFrame:
    """Images of eight words: calls ahead and back, a frame save, addresses of a page and near, a signed return, the address of
    the second word as far as 32 bits hold it, and noise that may look like any of them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 1000
    parts = (0x94000000 + c, 0xA9BF7BFD, 0x90000000 + 32 * c, (k * 65536 + 4) % (1 << 32), 0x97FFFFFF - c, k * 40503 % (1 << 32), 0x10000000 + 32 * c, 0xD503233F)
    image = joined(*[le(p, 4) for p in parts])
    return table(spark, sf_dir, "orders").select(k.alias("binary_id"), (k * 65536).alias("base"), image.alias("image"), c.alias("c"))


#: All words of these images; a call's distance and a page's number have 26 and 21 signed bits.
WORDS_SQL = """(SELECT binary_id, base + 4 * (i - 1) AS addr, w[i] AS word, base, n FROM (
    SELECT o_orderkey AS binary_id, o_orderkey * 65536 AS base, CAST(8 AS BIGINT) AS n, unnest(range(1, 9)) AS i,
    [2483027968 + o_custkey % 1000, 2847898621, 2415919104 + 32 * (o_custkey % 1000), (o_orderkey * 65536 + 4) % 4294967296,
     2550136831 - o_custkey % 1000, o_orderkey * 40503 % 4294967296, 268435456 + 32 * (o_custkey % 1000), 3573752639] AS w FROM orders))"""


@query("image_words", f"SELECT binary_id, addr, word FROM {WORDS_SQL}")
def image_words(spark, sf_dir):
    return binaries.words(_words(spark, sf_dir))


@query(
    "a64_calls",
    f"""SELECT binary_id, addr AS src, addr + 4 * (CASE WHEN word % 67108864 >= 33554432 THEN word % 67108864 - 67108864 ELSE word % 67108864 END) AS dst
        FROM {WORDS_SQL} WHERE word // 67108864 = 37""",
)
def a64_calls(spark, sf_dir):
    return scans.a64_calls(binaries.words(_words(spark, sf_dir)))


@query("a64_prologues", f"SELECT binary_id, addr FROM {WORDS_SQL} WHERE word = 3573752639 OR word & 4290805759 = 2843769853")
def a64_prologues(spark, sf_dir):
    return scans.a64_prologues(binaries.words(_words(spark, sf_dir)))


@query(
    "a64_addresses",
    f"""WITH p AS (SELECT *, word // 32 % 524288 * 4 + word // 536870912 % 4 AS raw FROM {WORDS_SQL} WHERE word // 16777216 % 32 = 16),
        q AS (SELECT *, CASE WHEN raw >= 1048576 THEN raw - 2097152 ELSE raw END AS d FROM p)
        SELECT binary_id, addr AS src, CASE WHEN word >= 2147483648 THEN addr // 4096 * 4096 + d * 4096 ELSE addr + d END AS dst FROM q""",
)
def a64_addresses(spark, sf_dir):
    return scans.a64_addresses(binaries.words(_words(spark, sf_dir)))


@query(
    "data_pointers",
    f"SELECT DISTINCT binary_id, addr AS src, word AS dst FROM {WORDS_SQL} WHERE binary_id % 2 = 0 AND word >= base AND word < base + 4 * n",
)
def data_pointers(spark, sf_dir):
    images = _words(spark, sf_dir)
    code = images.where("binary_id % 2 = 0").select("binary_id", F.col("base").alias("start"), (F.col("base") + F.octet_length("image")).alias("end"))
    return scans.data_pointers(binaries.words(images), code)


def _x86(spark, sf_dir: str) -> DataFrame:
    """Images: a call over ``c`` NOPs to a frame set-up, two import stubs, and padding before a return."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("int")
    image = joined(F.lit("E8"), le(c, 4), F.repeat(F.lit("90"), c), F.lit("558BEC"), F.lit("FF2511223344FF2555667788"), F.lit("CCCC90C3"))
    return table(spark, sf_dir, "orders").select(k.alias("binary_id"), (k * 4096).alias("base"), image.alias("image"), c.alias("c"))


X86_SQL = "(SELECT o_orderkey AS binary_id, o_orderkey * 4096 AS base, o_custkey % 50 AS c FROM orders)"


@query("x86_calls", f"SELECT binary_id, base AS src, base + 5 + c AS dst FROM {X86_SQL} WHERE c > 0")
def x86_calls(spark, sf_dir):
    return scans.x86_calls(_x86(spark, sf_dir))


@query("x86_prologues", f"SELECT binary_id, base + 5 + c AS addr, '558BEC' AS pattern FROM {X86_SQL}")
def x86_prologues(spark, sf_dir):
    return scans.byte_patterns(_x86(spark, sf_dir), scans.X86_PROLOGUES + scans.X64_PROLOGUES)


@query("stub_chains", f"SELECT binary_id, base + 8 + c + 6 * i AS addr FROM {X86_SQL}, (VALUES (0), (1)) AS v(i)")
def stub_chains(spark, sf_dir):
    return scans.stub_chains(_x86(spark, sf_dir))


@query("gap_starts", f"SELECT binary_id, base + 23 + c AS addr FROM {X86_SQL}")
def gap_starts(spark, sf_dir):
    rows = _x86(spark, sf_dir)
    end = F.col("base") + F.octet_length("image")
    gaps = rows.select("binary_id", (end - 4).alias("gap_start"), end.alias("gap_end"))
    return scans.gap_starts(rows.select("binary_id", "base", "image"), gaps)


#: Fillers by their place: NOPs, moves and address loads without effect, prefixes, traps.
FILLERS = ("660F1F440000", "0F1F00", "8D742600", "89F68DBC2700000000", "EB00", "662E0F1F840000000000", "F4", "666690", "8BFF", "0F1F8000000000", "8DB600000000", "66660F1F840000000000")


@query(
    "gap_fillers",
    f"""WITH g AS (SELECT *, (['{"', '".join(FILLERS)}'])[CAST(o_custkey % {len(FILLERS)} + 1 AS INTEGER)] AS filler FROM orders)
        SELECT o_orderkey AS binary_id, o_orderkey * 4096 + length(filler) // 2 * (o_orderkey % 90) + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS addr FROM g""",
)
def gap_fillers(spark, sf_dir):
    """Up to 89 fillers in a row before a function with a patch place, which only 32-bit images have; the gap goes on behind it."""
    filler = F.element_at(F.array(*map(F.lit, FILLERS)), (F.col("o_custkey") % len(FILLERS) + 1).cast("int"))
    image = joined(F.repeat(filler, (F.col("o_orderkey") % 90).cast("int")), F.lit("8BFF558BEC9090C3"))
    bits = F.when(F.col("o_orderkey") % 3 == 0, 64).otherwise(32)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("binary_id"), (F.col("o_orderkey") * 4096).alias("base"), image.alias("image"), bits.alias("bits"))
    gaps = rows.select("binary_id", F.col("base").alias("gap_start"), (F.col("base") + F.octet_length("image")).alias("gap_end"))
    return scans.gap_starts(rows, gaps, F.col("bits"))


@query("start_scores", f"SELECT binary_id, CASE WHEN c % 3 = 0 THEN 50 WHEN c % 3 = 1 THEN 30 ELSE 0 END AS start_score FROM {X86_SQL}")
def start_scores(spark, sf_dir):
    code = F.when(F.col("c") % 3 == 0, "8BFF558BEC").when(F.col("c") % 3 == 1, "558BEC9090").otherwise("0000000000")
    scores = spark.createDataFrame([("8BFF558BEC", 50), ("558BEC", 30), ("8B", 5)], "prefix string, score int")
    return scans.start_scores(_x86(spark, sf_dir).select("binary_id", code.alias("code")), scores).select("binary_id", "start_score")


@query("bitness_probe", f"SELECT binary_id, CAST(CASE WHEN c = 0 THEN 32 WHEN c % 2 = 0 THEN 64 ELSE 32 END AS INTEGER) AS bitness FROM {X86_SQL}")
def bitness_probe(spark, sf_dir):
    """Calls reach 0x55 (worth 32 bits) or, at even distances, 0x48 (64 bits)."""
    rows = _x86(spark, sf_dir)
    first = F.when(F.col("c") % 2 == 0, F.lit("48")).otherwise(F.lit("55"))
    image = F.unhex(F.concat(F.lit("E8"), le(F.col("c"), 4), F.repeat(F.lit("90"), F.col("c")), first, F.lit("909090")))
    rows = rows.select("binary_id", "base", image.alias("image"))
    scores = spark.createDataFrame([(0x55, 0.5, 0.1), (0x48, 0.0, 0.4), (0x8B, 0.2, 0.0)], "first long, s32 double, s64 double")
    return images.probe_bitness(scans.x86_calls(rows), rows, scores)


# --- scalars on bytes and strings


@query("leb128", "SELECT p_partkey, p_partkey AS up, -p_partkey AS down FROM part")
def leb128(spark, sf_dir):
    def groups(v: Column) -> Column:
        part = lambda i: F.shiftright(v, 7 * i).bitwiseAND(F.lit(127))
        return joined(le(part(0) + 128, 1), le(part(1) + 128, 1), le(part(2) + 128, 1), le(part(3), 1))

    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.uleb128(groups(k), F.lit(0)).alias("up"), scalars.sleb128(groups(-k), F.lit(0)).alias("down"))


@query(
    "string_lengths",
    """SELECT doc_id, CASE WHEN length(t) <= 4096 AND regexp_full_match(t, '[\\x09-\\x0d -~]*') THEN length(t) ELSE 0 END AS ascii_n,
       CASE WHEN length(t) <= 4096 AND regexp_full_match(t, '[\\x09-\\x0d -~]*') THEN length(t) ELSE 0 END AS wide_n
       FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def string_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    plain, wide = F.concat(F.encode("t", "UTF-8"), F.unhex(F.lit("00"))), F.concat(F.encode("t", "UTF-16LE"), F.unhex(F.lit("0000")))
    return docs.select("doc_id", scalars.ascii_length(plain, F.lit(0)).cast("long").alias("ascii_n"), scalars.utf16_length(wide, F.lit(0)).cast("long").alias("wide_n"))


@query(
    "read_strings",
    # the first character of a wide text is a narrow text of its own, which is tried first
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN substring(p_name, 1, 1) END AS found FROM part""",
)
def read_strings(spark, sf_dir):
    narrow = F.concat(F.unhex(F.lit("0102")), F.encode("p_name", "UTF-8"), F.unhex(F.lit("00")))
    wide = F.concat(F.unhex(F.lit("0102")), F.encode("p_name", "UTF-16LE"), F.unhex(F.lit("0000")))
    image = F.when(F.col("p_size") % 3 == 0, narrow).when(F.col("p_size") % 3 == 1, wide).otherwise(F.unhex(F.lit("0102FE00")))
    return _parts(spark, sf_dir).select("p_partkey", scalars.read_string(image, F.lit(2)).alias("found"))


@query("go_strings", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN substring(p_name, 1, 5) END AS found FROM part")
def go_strings(spark, sf_dir):
    pointer = F.when(F.col("p_size") % 2 == 0, BASE + 16).otherwise(5)
    image = F.concat(joined(le(pointer, 8), le(5, 8)), F.encode("p_name", "UTF-8"))
    return _parts(spark, sf_dir).select("p_partkey", scalars.go_string(image, F.lit(BASE), F.lit(0), F.lit(True)).alias("found"))


@query(
    "sql_functions",
    """SELECT o_orderkey, (o_orderkey + 15) // 16 * 16 AS up, o_orderkey // 16 * 16 AS down, CAST(o_custkey AS BIGINT) AS number, 'k.dll!f' || o_custkey AS api FROM orders""",
)
def sql_functions(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("ferrule_orders")
    return spark.sql(
        "SELECT o_orderkey, align_up(o_orderkey, 16) AS up, align_down(o_orderkey, 16) AS down, "
        "hex_value(concat('[0x', lower(hex(o_custkey)), ']')) AS number, api_name('k.dll', concat('f', o_custkey)) AS api FROM ferrule_orders"
    )


@query("signed_hex", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN -o_orderkey WHEN o_custkey % 3 = 1 THEN o_orderkey ELSE 0 END AS value FROM orders")
def signed_hex(spark, sf_dir):
    digits = F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey")), F.lit("]"))
    way = F.col("o_custkey") % 3
    operands = F.when(way == 0, F.concat(F.lit("qword ptr [rip - "), digits)).when(way == 1, F.concat(F.lit("[rax + "), digits)).otherwise("eax, ebx")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.signed_hex(operands).cast("long").alias("value"))


@query("report_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') AS stamp FROM orders")
def report_times(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.report_timestamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


@query(
    "dex_type_names",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'La/b' || p_size || ';' WHEN 2 THEN 'Lx/y;' WHEN 3 THEN '[B' ELSE 'J' END AS name FROM part""",
)
def dex_type_names(spark, sf_dir):
    way = F.col("p_partkey") % 5
    name = F.when(way == 0, "int").when(way == 1, F.concat(F.lit("a.b"), F.col("p_size").cast("string"))).when(way == 2, "Lx/y;").when(way == 3, "[B").otherwise("J")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.dex_type_name(name).alias("name"))


#: Control characters without a letter of their own, each replaced by its code.
_CONTROLS = [i for i in (*range(32), 127) if i not in (9, 10, 13)]


@query(
    "dex_escaped",
    "SELECT doc_id, sha256(" + "replace(" * len(_CONTROLS)
    + r"""replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
    + "".join(rf", chr({i}), '\u{i:04x}')" for i in _CONTROLS) + ") AS escaped FROM documents WHERE text IS NOT NULL",
)
def dex_escaped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.sha2(scalars.dex_escaped(F.col("text")), 256).alias("escaped"))


@query(
    "language_names",
    longs(
        """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '.net' WHEN 1 THEN 'delphi' ELSE 'go' END AS name,
       CASE WHEN p_size % 3 = 0 THEN greatest(p_size, 7) ELSE 7 END AS best FROM part""",
        "best",
    ),
)
def language_names(spark, sf_dir):
    way = F.col("p_size") % 3
    name = F.when(way == 0, " CIL").when(way == 1, "delphi_kb_file").otherwise("Go")
    key = F.when(way == 0, "cil").when(way == 1, "_hidden").otherwise("go")
    scores = F.map_from_arrays(F.array(key, F.lit(".net")), F.array(F.col("p_size"), F.lit(7).cast("long")))
    best = F.element_at(scalars.language_map(scores), ".net")
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_language(name).alias("name"), best.alias("best"))


# --- reports, sinks, streams


@query(
    "report_statistics",
    """SELECT CAST(l_orderkey AS VARCHAR) AS binary_id, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS num_functions, CAST(count(*) AS BIGINT) AS num_instructions,
       CAST(2 * count(*) AS BIGINT) AS binweight, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS num_function_calls FROM lineitem GROUP BY l_orderkey""",
)
def report_statistics(spark, sf_dir):
    """Reports as JSON text, an order each: suppliers are functions of one block, lines their instructions, and each calls itself once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("fn"), "l_linenumber", "l_partkey")
    row = F.array((F.col("l_linenumber") * 4).cast("string"), F.lit("90c3"), F.lit("nop"), F.col("l_partkey").cast("string"))
    fns = lines.groupBy("l_orderkey", "fn").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    key = F.col("fn").cast("string")
    one = F.struct(F.col("fn").alias("offset"), F.create_map(key, F.col("rows")).alias("blocks"), F.create_map(key, F.array("fn")).alias("outrefs"))
    docs = fns.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(key, one))).alias("xcfg"))
    texts = docs.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("sha256"), "xcfg")).alias("json"))
    # staged, as instructions, references to code and to APIs would each write and parse every report again
    functions = staged(reports.functions_of(texts.select(F.from_json("json", reports.SCHEMA).alias("r")).select("r.*")), "functions")
    found = reports.statistics(reports.instructions_of(functions), reports.code_refs_of(functions), reports.api_refs_of(functions))
    return found.select("binary_id", "num_functions", "num_instructions", "binweight", "num_function_calls")


@query("written_tables", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def written_tables(spark, sf_dir):
    """Tables written through the sink, partitioned, and read again from the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_tables({"nation": rows}, path, "n_regionkey")
    back = spark.read.schema(rows.schema).parquet(f"{path}/nation")
    return back.select("n_nationkey", "n_name", "n_regionkey")


@query(
    "windowed_counts",
    """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""",
)
def windowed_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    found = ingest.windowed_counts(events, "ts", "event_type", "1 hour", "1 hour")
    return found.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n")


@query(
    "in_image",
    "SELECT CAST(count(*) FILTER (o_totalprice >= 1000 AND o_totalprice < 51000) AS BIGINT) AS n FROM orders",
)
def in_image(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_if(ranges.in_image(F.col("o_totalprice"), F.lit(1000), F.lit(50000))).alias("n"))

"""Queries on symbol, import and export tables: a file per order, whose tables hold the order's line items.

Every table is followed by bytes that are no part of it, chains differ in length down to none, and the oracles state what
the rows put in.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.plans.built_files import Built, built
from ferrule.plans.registry import query, table
from ferrule.sources import binaries, dex_names, elf_symbols, pe_tables

#: Where the one section of a PE file lies in memory and in the file, and the bases of 64-bit and 32-bit files.
RVA, RAW, WIDE, NARROW = 0x2000, 512, 0x140000000, 0x400000


def line_items(spark, sf_dir: str) -> DataFrame:
    """(k, n, items): per order its line items (p, s) in a fixed order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).alias("x"))
    return rows.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("items"), F.count("*").alias("n"))


#: The same rows for the oracles, with each item's place ``i`` in its order of ``n``.
ITEMS = """WITH it AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, count(*) OVER (PARTITION BY l_orderkey) AS n,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
f AS (SELECT *, k % 2 = 0 AS wide, CASE WHEN k % 2 = 0 THEN 5368709120 + k * 65536 ELSE 4194304 END AS base FROM it)"""


def files_of(spark, sf_dir: str, build) -> DataFrame:
    """The files that ``build`` makes of orders. They are not staged: they are as fast to build as to read again, and larger
    than the tables by far."""
    made = built(line_items(spark, sf_dir), build).select(F.col("k").alias("binary_id"), F.col("c").alias("content"))
    return made.withColumn("format", binaries.dispatch(F.col("content")))


def _pe_files(spark, sf_dir: str) -> DataFrame:
    """32-bit and 64-bit files: three libraries by supplier (the third without a lookup table), a delay-loaded one, exports
    (some forwarded, some unnamed, some empty), and COFF symbols with auxiliary records."""
    return files_of(spark, sf_dir, _pe_file)


def _pe_file(k, n, f, i, p, s) -> Built:
    wide = k % 2 == 0
    base = np.where(wide, WIDE + k * 65536, NARROW)
    size = 8 * (n + 1) + 16  # of a table of slots, with what follows it
    names = 96 + 6 * size
    delay = names + 32 * n + 48
    export = delay + 112
    m = n // 2
    strings = export + 56 + 4 * n + 6 * m
    end = strings + 24 * m
    records = n + n // 3 * 3 + np.where(n % 3 == 2, 1, 0)  # with 0, 1, 2, 0 .. auxiliary ones
    out = Built(RAW + end + 18 * records + 4 + 24 * n)
    e = out.each

    # header
    out.text(e, 0, b"MZ")
    out.number(e, 0x3C, 0x80, 4)
    out.text(e, 0x80, b"PE")
    for at, value, bytes_ in ((0x84, np.where(wide, 0x8664, 0x14C), 2), (0x86, 1, 2), (0x8C, RAW + end, 4), (0x90, records, 4), (0x94, np.where(wide, 240, 224), 2), (0x98, np.where(wide, 0x20B, 0x10B), 2), (0xA8, 0x1000, 4)):
        out.number(e, at, value, bytes_)
    out.sized(e, np.where(wide, 0xB0, 0xB4), base, wide)
    first = np.where(wide, 0x108, 0xF8)
    for at, value in ((-4, 16), (0, RVA + export), (4, 56), (8, RVA), (12, 80), (104, RVA + delay), (108, 64), (136, end), (140, RVA), (144, end), (148, RAW), (164, 0x60000020)):
        out.number(e, first + at, value, 4)
    out.text(e, first + 128, b".all")

    # imports
    for lib in range(3):
        at = RAW + 20 * lib
        out.number(e, at, 0 if lib == 2 else RVA + 96 + size * lib, 4)
        out.number(e, at + 12, RVA + names + 32 * n + 16 * lib, 4)
        out.number(e, at + 16, RVA + 96 + size * (3 + lib), 4)
        out.text(e, RAW + names + 32 * n + 16 * lib, f"Lib{lib}.DLL".encode())
    out.fill(e, RAW + 80, 16, 0xEE)
    out.fill(e, RAW + 96, 6 * size, 0xF1)
    top = np.where(wide[f], 0x80 << 56, 0x80 << 24)
    slot = np.where(i % 3 == 2, p % 65536 + top.astype(np.uint64).astype(np.int64), RVA + names[f] + 32 * i)
    step = np.where(wide, 8, 4)
    for lib in range(3):
        own = s % 3 == lib
        held = np.bincount(f[own], minlength=len(k))
        place = np.arange(own.sum()) - np.repeat(np.cumsum(held) - held, held)
        for table in (lib, lib + 3):
            out.sized(f[own], RAW + 96 + size[f[own]] * table + step[f[own]] * place, slot[own], wide)
            out.sized(e, RAW + 96 + size * table + step * held, 0, wide)
    out.number(f, RAW + names[f] + 32 * i, i, 2)
    out.numbered(f, RAW + names[f] + 32 * i + 2, b"fn_", p)

    # delay imports; a third of the files state addresses instead of relative ones in the old way
    old = ~wide & (k % 3 == 0)
    own = lambda at: at + RVA + np.where(old, NARROW, 0)
    for at, value in ((0, np.where(old, 0, 1)), (4, own(delay + 96)), (12, own(delay + 80)), (16, own(delay + 64)), (64, RVA + names)):
        out.number(e, RAW + delay + at, value, 4)
    out.text(e, RAW + delay + 96, b"Late.dll")

    # exports
    for at, value in ((16, 7), (20, n), (24, m), (28, RVA + export + 56), (32, RVA + export + 56 + 4 * n), (36, RVA + export + 56 + 4 * n + 4 * m)):
        out.number(e, RAW + export + at, value, 4)
    out.text(e, RAW + export + 40, b"Other.fn")
    leads = np.where(i % 4 == 3, RVA + export[f] + 40, np.where(i % 5 == 4, 0, 0x3000 + 16 * (i - i % 2)))
    out.number(f, RAW + export[f] + 56 + 4 * i, leads, 4)
    odd = i % 2 == 1
    g, j = f[odd], i[odd] // 2
    out.number(g, RAW + export[g] + 56 + 4 * n[g] + 4 * j, RVA + strings[g] + 24 * j, 4)
    out.number(g, RAW + export[g] + 56 + 4 * n[g] + 4 * m[g] + 2 * j, i[odd], 2)
    out.numbered(g, RAW + strings[g] + 24 * j, b"ex_", p[odd])

    # symbols
    at = RAW + end[f] + 18 * (i + i // 3 * 3 + np.where(i % 3 == 2, 1, 0))
    out.numbered(f[~odd], at[~odd], b"s", i[~odd])
    out.number(f[odd], at[odd] + 4, 4 + 24 * i[odd], 4)
    for to, value, bytes_ in ((8, 0x1000 + 16 * (i - i % 2), 4), (12, np.where(i % 7 == 6, 0xFFFF, 1), 2), (14, np.where(i % 4 < 3, 0x20, 0), 2), (16, 2, 1), (17, i % 3, 1)):
        out.number(f, at + to, value, bytes_)
    for more in (1, 2):  # reads as a symbol with a record of its own
        own = i % 3 >= more
        out.fill(f[own], at[own] + 18 * more, 17, 0x66)
        out.number(f[own], at[own] + 18 * more + 17, 1, 1)
    table = RAW + end + 18 * records
    out.number(e, table, 4 + 24 * n, 4)
    out.numbered(f, table[f] + 4 + 24 * i, b"long_symbol_", p)
    return out


def _pe(spark, sf_dir: str) -> DataFrame:
    return binaries.pe_headers(_pe_files(spark, sf_dir))


_AS_TEXT = "CAST(CAST({} AS HUGEINT) AS VARCHAR)"


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


_SLOT = "base + 8192 + 96 + (3 + s % 3) * (8 * (n + 1) + 16) + (CASE WHEN wide THEN 8 ELSE 4 END) * (row_number() OVER (PARTITION BY k, s % 3 ORDER BY i) - 1)"
PE_IMPORTS = f"""{ITEMS}
SELECT k AS binary_id, 'lib' || s % 3 || '.dll' AS dll, CASE WHEN i % 3 < 2 THEN 'fn_' || p END AS name, CASE WHEN i % 3 = 2 THEN CAST(p % 65536 AS VARCHAR) END AS ordinal,
  {_AS_TEXT.format(_SLOT)} AS slot, false AS delayed FROM f
UNION ALL SELECT k, 'late.dll', 'fn_' || p, NULL, {_AS_TEXT.format('base + 8192 + 96 + 6 * (8 * (n + 1) + 16) + 32 * n + 48 + 80')}, true FROM f WHERE i = 0"""


@query("pe_imports", PE_IMPORTS)
def pe_imports(spark, sf_dir):
    return _texts(pe_tables.pe_imports(_pe(spark, sf_dir)), "slot", "ordinal")


@query(
    "named_ordinals",
    f"""WITH x AS ({PE_IMPORTS}), names AS (SELECT 'lib' || d || '.dll' AS dll, CAST(p_partkey % 65536 AS VARCHAR) AS ordinal, any_value(p_name) AS name
      FROM part, range(2) AS r(d) WHERE p_partkey % 2 = 0 GROUP BY ALL HAVING count(*) = 1)
    SELECT binary_id, dll, coalesce(x.name, names.name, '#' || ordinal) AS name, slot FROM x LEFT JOIN names USING (dll, ordinal)""",
)
def named_ordinals(spark, sf_dir):
    """Numbers of the first two libraries are named by a table, where it has one name for them."""
    part = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select((F.col("p_partkey") % 65536).alias("ordinal"), F.col("p_name").alias("name"))
    part = part.groupBy("ordinal").agg(F.first("name").alias("name"), F.count("*").alias("c")).where("c = 1")
    names = part.select(F.explode(F.array(F.lit("lib0.dll"), F.lit("lib1.dll"))).alias("dll"), "ordinal", "name")
    found = pe_tables.named_ordinals(pe_tables.pe_imports(_pe(spark, sf_dir)), names)
    return _texts(found.select("binary_id", "dll", "name", "slot"), "slot")


@query(
    "import_chains",
    f"""{ITEMS}, o AS (SELECT DISTINCT k FROM it)
    SELECT k AS binary_id, false AS delayed, NULL AS dll, CAST(3 AS BIGINT) AS n, true AS ended FROM o UNION ALL SELECT k, true, NULL, 1, true FROM o
    UNION ALL SELECT k, true, 'late.dll', 1, true FROM o
    UNION ALL SELECT o.k, false, 'lib' || d || '.dll', count(it.k), true FROM o CROSS JOIN range(3) AS r(d) LEFT JOIN it ON it.k = o.k AND it.s % 3 = d GROUP BY o.k, d""",
)
def import_chains(spark, sf_dir):
    return pe_tables.import_chains(_pe(spark, sf_dir))


PE_EXPORTS = f"""{ITEMS}, e AS (SELECT k AS binary_id, i + 7 AS ordinal, CASE WHEN i % 2 = 1 THEN 'ex_' || p END AS name,
  CASE WHEN i % 4 <> 3 THEN base + 12288 + 16 * (i - i % 2) END AS address, CASE WHEN i % 4 = 3 THEN 'Other.fn' END AS forwarded, k, i
  FROM f WHERE i % 4 = 3 OR i % 5 <> 4)"""


@query("pe_exports", f"{PE_EXPORTS} SELECT binary_id, ordinal, name, CAST(address AS VARCHAR) AS address, forwarded FROM e")
def pe_exports(spark, sf_dir):
    return _texts(pe_tables.pe_exports(_pe(spark, sf_dir)), "address")


@query(
    "coff_symbols",
    f"""{ITEMS} SELECT k AS binary_id, CAST(i AS BIGINT) AS place, CASE WHEN i % 2 = 0 THEN 's' || i ELSE 'long_symbol_' || p END AS name,
    CAST(4096 + 16 * (i - i % 2) AS BIGINT) AS value, CAST(CASE WHEN i % 7 = 6 THEN -1 ELSE 1 END AS BIGINT) AS section,
    CAST(CASE WHEN i % 4 < 3 THEN 32 ELSE 0 END AS BIGINT) AS kind, CAST(2 AS BIGINT) AS class FROM f""",
)
def coff_symbols(spark, sf_dir):
    return pe_tables.coff_symbols(_pe(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(
    "pe_function_symbols",
    f"""{PE_EXPORTS}, s AS (SELECT k AS binary_id, base + 4096 AS address, '{pe_tables.ENTRY_POINT}' AS name, 0 AS r FROM f WHERE i = 0
      UNION ALL SELECT binary_id, address, name, 100 + i FROM e WHERE name IS NOT NULL AND forwarded IS NULL
      UNION ALL SELECT k, base + 12288 + 16 * (i - i % 2), CASE WHEN i % 2 = 0 THEN 's' || i ELSE 'long_symbol_' || p END, 1000 - i FROM f WHERE i % 4 < 3 AND i % 7 <> 6)
    SELECT binary_id, CAST(address AS VARCHAR) AS address, arg_max(name, r) AS name FROM s GROUP BY binary_id, address""",
)
def pe_function_symbols(spark, sf_dir):
    """Entry point, exports and symbols; pairs of symbols share an address, and symbols lie on exports."""
    return _texts(pe_tables.pe_function_symbols(_pe(spark, sf_dir)), "address")


# --- ELF

#: Start of the sections' bytes, and addresses that the oracles know: of dynamic and static symbols, slots and stubs.
FIRST, DYNAMIC, STATIC, SLOTS, STUBS = 704, 0x10000, 0x20000, 0x30000, 0x40000


def _elf(spark, sf_dir: str) -> DataFrame:
    """Files of both classes and byte orders by order number: static and dynamic symbols, relocations with versions, stubs.

    Pairs of dynamic symbols and triples of static ones share an address; some are undefined, absolute, data, thread-local
    or local, and an undefined one may have a value.
    """
    return files_of(spark, sf_dir, _elf_file)


def _elf_file(k, n, f, i, p, s) -> Built:
    wide, big = k % 2 == 0, k % 4 >= 2
    names = ".dynsym .dynstr .symtab .strtab .rel .versym .verneed .plt .shstrtab".split()
    listed = b"\0" + b"".join(x.encode() + b"\0" for x in names)
    step, relocation = np.where(wide, 24, 16), np.where(wide, 24, 8)
    sizes = [step * (n + 1), 1 + 24 * n + 16, step * (n + 1), 1 + 24 * n, relocation * n, 2 * (n + 1), np.full(len(k), 112), 16 * n, np.full(len(k), len(listed))]
    starts = FIRST + np.cumsum([np.zeros(len(k), np.int64), *sizes], 0)
    out = Built(starts[-1], big)
    e = out.each
    dynamic, dynamic_names, static, static_names, slots, versions, needs, stubs, last = starts[:-1]

    # header and sections; a field lies at one place in wide files and at another in the others
    pick = lambda far, near: np.where(wide, far, near)
    out.text(e, 0, b"\x7fELF")
    for at, value, size in ((4, pick(2, 1), 1), (5, np.where(big, 2, 1), 1), (6, 1, 1), (16, 2, 2), (18, np.where(wide & ~big, 62, 8), 2), (20, 1, 4)):
        out.number(e, at, value, size)
    out.sized(e, 24, k + 0x50000, wide)
    out.sized(e, pick(40, 32), 64, wide)
    for far, near, value in ((52, 40, 64), (58, 46, pick(64, 40)), (60, 48, 10), (62, 50, 9)):
        out.number(e, pick(far, near), value, 2)
    kinds, links = (11, 3, 2, 3, pick(4, 9), 0x6FFFFFFF, 0x6FFFFFFE, 1, 3), (2, 0, 4, 0, 1, 1, 2, 0, 0)
    for j, (kind, link) in enumerate(zip(kinds, links, strict=True)):
        at = 64 + (j + 1) * pick(64, 40)
        for far, near, value in ((0, 0, 1 + sum(len(x) + 1 for x in names[:j])), (4, 4, kind), (40, 24, link), (44, 28, 2 if j == 6 else 0)):
            out.number(e, at + pick(far, near), value, 4)
        for far, near, value in ((16, 12, STUBS if j == 7 else 0), (24, 16, starts[j]), (32, 20, sizes[j]), (48, 32, 1)):
            out.sized(e, at + pick(far, near), value, wide)
    out.text(e, last, listed)

    # symbols
    far = lambda a, b: np.where(wide[f], a, b)
    tables = (
        (dynamic, np.where(i % 6 == 0, 0, DYNAMIC + 16 * (i - i % 2)), np.where(i % 7 == 6, 6, np.where(i % 4 == 3, 1, 2)), np.where(i % 11 == 10, 0, 1 + i % 2), np.where(i % 3 == 0, 0, np.where(i % 5 == 4, 0xFFF1, 1))),
        (static, STATIC + 16 * (i // 3), 2 - i % 2, 0, 1),
    )
    for table, value, kind, bind, section in tables:
        at = table[f] + step[f] * (i + 1)
        out.number(f, at, 1 + 24 * i, 4)
        out.number(f, at + far(4, 12), bind * 16 + kind, 1)
        out.number(f, at + far(6, 14), section, 2)
        out.sized(f, at + far(8, 4), value, wide)
        out.sized(f, at + far(16, 8), 4, wide)
    out.numbered(f, dynamic_names[f] + 1 + 24 * i, b"dyn_", p)
    out.text(e, dynamic_names + 1 + 24 * n, b"V_2\0V_3\0V_4\0V_5\0")
    out.numbered(f, static_names[f] + 1 + 24 * i, b"st_", p)

    # relocations, versions and stubs
    at = slots[f] + relocation[f] * i
    out.sized(f, at, SLOTS + 8 * i, wide)
    w = wide[f]
    order = big[f][w]
    out.number(f[w], at[w] + np.where(order, 8, 12), i[w] + 1, 4)
    out.number(f[w], at[w] + np.where(order, 12, 8), 7, 4)
    out.number(f[~w], at[~w] + 4, (i[~w] + 1) * 256 + 7, 4)
    # odd symbols have no version; the top bit only hides a version
    out.number(f, versions[f] + 2 * (i + 1), np.where(i % 2 == 0, 2 + s % 4 + np.where(i % 4 == 0, 0x8000, 0), 1), 2)
    for to, count, more in ((0, 3, 80), (80, 1, 0)):
        for field, value, size in ((0, 1, 2), (2, count, 2), (8, 16, 4), (12, more, 4)):
            out.number(e, needs + to + field, value, size)
    for to, version, more in ((16, 2, 32), (48, 3, 16), (64, 4, 0), (96, 5, 0)):
        for field, value, size in ((6, version, 2), (8, 1 + 24 * n + 4 * (version - 2), 4), (12, more, 4)):
            out.number(e, needs + to + field, value, size)
    out.fill(e, needs + 32, 16, 0xAB)
    at = stubs[f] + 16 * i
    out.text(f, at, bytes.fromhex("F30F1EFAF2FF25"))
    out.number(f, at + 7, SLOTS + 8 * i - (STUBS + 16 * i + 11), 4, little=True)
    out.text(f, at + 11, bytes.fromhex("0F1F440000"))
    return out


ELF = f"""{ITEMS}, d AS (SELECT k, i, p, s, 'dyn_' || p AS name, CASE WHEN i % 6 = 0 THEN 0 ELSE {DYNAMIC} + 16 * (i - i % 2) END AS value,
  CASE WHEN i % 7 = 6 THEN 6 WHEN i % 4 = 3 THEN 1 ELSE 2 END AS kind, CASE WHEN i % 11 = 10 THEN 0 ELSE 1 + i % 2 END AS bind,
  CASE WHEN i % 3 = 0 THEN 0 WHEN i % 5 = 4 THEN 65521 ELSE 1 END AS section FROM it),
t AS (SELECT k, i, 'st_' || p AS name, {STATIC} + 16 * (i // 3) AS value, 2 - i % 2 AS kind FROM it)"""


@query(
    "elf_symbols",
    f"""{ELF} SELECT k AS binary_id, true AS dynamic, i + 1 AS place, name, CAST(value AS VARCHAR) AS value, CAST(kind AS BIGINT) AS kind, CAST(bind AS BIGINT) AS bind, CAST(section AS BIGINT) AS section FROM d
    UNION ALL SELECT k, false, i + 1, name, CAST(value AS VARCHAR), kind, 0, 1 FROM t""",
)
def elf_symbols_(spark, sf_dir):
    found = elf_symbols.elf_symbols(_elf(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))
    return _texts(found.drop("size"), "value")


@query(
    "elf_function_symbols",
    f"""{ELF}, x AS (SELECT k, k + {0x50000} AS value, '{pe_tables.ENTRY_POINT}' AS name, 0 AS r FROM d WHERE i = 0
      UNION ALL SELECT k, value, name, 1 + i FROM t WHERE kind = 2
      UNION ALL SELECT k, value, name, 1000 + i FROM d WHERE kind = 2 AND section = 1 AND value > 0)
    SELECT k AS binary_id, CAST(value AS VARCHAR) AS address, arg_max(name, r) AS name FROM x GROUP BY k, value""",
)
def elf_function_symbols(spark, sf_dir):
    return _texts(elf_symbols.elf_function_symbols(_elf(spark, sf_dir)), "address")


@query(
    "elf_exported_symbols",
    f"{ELF} SELECT k AS binary_id, CAST(value AS VARCHAR) AS address, arg_min(name, i) AS name FROM d WHERE section = 1 AND kind <> 6 GROUP BY k, value",
)
def elf_exported_symbols(spark, sf_dir):
    return _texts(elf_symbols.elf_exported_symbols(_elf(spark, sf_dir)), "address")


_IMPORTED = f"""SELECT k AS binary_id, CAST({SLOTS} + 8 * i AS VARCHAR) AS slot, CASE WHEN i % 2 = 0 THEN 'V_' || 2 + s % 4 END AS version, name
  FROM d WHERE section = 0 AND kind = 2 AND bind > 0"""


@query("elf_imports", f"{ELF} {_IMPORTED}")
def elf_imports(spark, sf_dir):
    return _texts(elf_symbols.elf_imports(elf_symbols.elf_relocations(_elf(spark, sf_dir))), "slot")


@query(
    "elf_stubs",
    f"{ELF}, m AS ({_IMPORTED}) SELECT binary_id, CAST({STUBS} + 2 * (CAST(slot AS BIGINT) - {SLOTS}) AS VARCHAR) AS stub, slot, version, name FROM m WHERE binary_id % 4 = 0",
)
def elf_stubs(spark, sf_dir):
    """Stub -> slot -> import, in the files for x86."""
    files = _elf(spark, sf_dir)
    found = elf_symbols.named_stubs(elf_symbols.linkage_stubs(files), elf_symbols.elf_imports(elf_symbols.elf_relocations(files)))
    return _texts(found, "stub", "slot")


# --- DEX

#: Bytes of a string's place; strings before those of the items.
TEXT, FIXED = 160, ("V", "I", "Ljava/lang/Object;")


def _dex(spark, sf_dir: str) -> DataFrame:
    """Files whose pools hold, per item, a class, a name with characters of one to four bytes, a short or long shorty, a
    prototype of up to two parameters, a field, and a method of the next item's class."""
    return files_of(spark, sf_dir, _dex_file)


def _dex_file(k, n, f, i, p, s) -> Built:
    types = 112 + 4 * (3 + 3 * n)
    protos = types + 4 * (3 + n)
    fields = protos + 12 * n
    methods = fields + 8 * n
    lists = methods + 8 * n
    data = lists + 8 * n
    out = Built(data + TEXT * (3 + 3 * n))
    e = out.each
    out.text(e, 0, b"dex\n035\0")
    for j, value in enumerate((3 + 3 * n, 112, 3 + n, types, n, protos, n, fields, n, methods)):
        out.number(e, 56 + 4 * j, value, 4)
    out.fill(e, data, TEXT * (3 + 3 * n), 0xEE)
    for j, text in enumerate(FIXED):
        out.number(e, 112 + 4 * j, data + TEXT * j, 4)
        out.number(e, types + 4 * j, j, 4)
        out.text(e, data + TEXT * j, bytes([len(text)]) + text.encode() + b"\0")
    out.number(f, types[f] + 12 + 4 * i, 3 + 3 * i, 4)
    for table, size, rows in (
        (protos, 12, ((0, 5 + 3 * i, 4), (4, np.where(i % 2 == 0, 0, 3 + i), 4), (8, np.where(i % 3 == 0, 0, lists[f] + 8 * i), 4))),
        (fields, 8, ((0, 3 + i, 2), (2, 1 + i % 2, 2), (4, 4 + 3 * i, 4))),
        (methods, 8, ((0, 3 + (i + 1) % n[f], 2), (2, i, 2), (4, 4 + 3 * i, 4))),
        (lists, 8, ((0, i % 3, 4), (4, 1, 2), (6, 3 + i, 2))),
    ):
        for at, value, bytes_ in rows:
            out.number(f, table[f] + size * i + at, value, bytes_)

    at = [data[f] + TEXT * (3 + 3 * i + j) for j in range(3)]
    for j in range(3):
        out.number(f, 112 + 4 * (3 + 3 * i + j), at[j], 4)
    size = out.numbered(f, at[0] + 1, b"Lc/", p)
    out.text(f, at[0] + 1 + size, b";\0")
    out.number(f, at[0], size + 1, 1)
    size = out.numbered(f, at[1] + 1, b"m", s)
    ends = bytes.fromhex("C3A9E282ACEDA0BDEDB880")  # four characters, the last as two surrogates
    more = i % 3 == 0
    out.number(f, at[1], size + np.where(more, 4, 0), 1)
    out.text(f[more], (at[1] + 1 + size)[more], ends)
    out.number(f, at[1] + 1 + size + np.where(more, len(ends), 0), 0, 1)
    long = i % 4 == 1
    out.text(f[~long], at[2][~long], b"\2VI\0")
    out.text(f[long], at[2][long], bytes([131 % 128 + 128, 131 // 128]) + b"V" + b"I" * 130 + b"\0")
    return out


@query(
    "dex_names",
    f"""{ITEMS}, x AS (SELECT k, i, n, 'Lc/' || p || ';' AS own, 'm' || s || CASE WHEN i % 3 = 0 THEN 'é€😀' ELSE '' END AS name,
      'V' || repeat('I', CASE WHEN i % 4 = 1 THEN 130 ELSE 1 END) AS shorty FROM it),
    y AS (SELECT *, '(' || CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'I' ELSE 'I' || own END || ')' || CASE WHEN i % 2 = 0 THEN 'V' ELSE own END AS proto,
      lead(own, 1, NULL) OVER (PARTITION BY k ORDER BY i) AS nxt, first_value(own) OVER (PARTITION BY k ORDER BY i) AS one FROM x),
    o AS (SELECT DISTINCT k FROM it), w AS (SELECT * FROM (VALUES (0, 'V'), (1, 'I'), (2, 'Ljava/lang/Object;')) v(j, t))
    SELECT k AS binary_id, 'string' AS kind, CAST(j AS BIGINT) AS number, t AS name FROM o, w UNION ALL SELECT k, 'type', j, t FROM o, w
    UNION ALL SELECT k, 'string', 3 + 3 * i, own FROM y UNION ALL SELECT k, 'string', 4 + 3 * i, name FROM y UNION ALL SELECT k, 'string', 5 + 3 * i, shorty FROM y
    UNION ALL SELECT k, 'type', 3 + i, own FROM y UNION ALL SELECT k, 'proto', i, proto FROM y
    UNION ALL SELECT k, 'field', i, own || '->' || name || ':' || CASE WHEN i % 2 = 0 THEN 'I' ELSE 'Ljava/lang/Object;' END FROM y
    UNION ALL SELECT k, 'method', i, coalesce(nxt, one) || '->' || name || proto FROM y""",
)
def dex_names_(spark, sf_dir):
    return dex_names.dex_names(_dex(spark, sf_dir)).withColumn("number", F.col("number").cast("long"))

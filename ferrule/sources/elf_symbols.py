"""Symbols, relocation slots, versions and linkage stubs of ELF files, both classes and byte orders.

As for PE files, a slice of files is read at once (``batches``): sections are arrays over the slice, a table finds its strings by
the section that it links to, and only finished entries leave the slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.sources.batches import Files, decimals, longs, read_files
from ferrule.sources.pe_tables import ENTRY_POINT, behind, spread

#: Fixed numbers of the format: section types, symbol kinds and bindings, reserved section numbers, machines.
SYMTAB, STRTAB, RELA, REL, DYNSYM, VERSYM, VERNEED = 2, 3, 4, 9, 11, 0x6FFFFFFF, 0x6FFFFFFE
FUNCTION, THREAD_LOCAL = 2, 6
OUTSIDE = (1, 2)
RESERVED = 0xFF00
I386, X86_64 = 3, 62
#: Fixed names of sections that hold linkage stubs, and a stub's size.
STUBS, STUB_SIZE = (".plt", ".plt.sec", ".plt.got"), 16


class Elf(Files):
    """ELF files with their header's fields and their sections: one entry each in arrays over all files (``of`` tells whose)."""

    def __init__(self, contents: pa.Array):
        super().__init__(contents)
        f = self.each()
        self.wide, self.big = self.number(f, f * 0 + 4, 1) == 2, self.number(f, f * 0 + 5, 1) == 2
        self.machine = self.read(f, f * 0 + 18, 2)
        self.entry = self.address(f, f * 0, 24, 24)
        at = self.place(f, f * 0, 40, 32)
        step, n, self.names = (self.field(f, f * 0, wide, narrow, 2) for wide, narrow in ((58, 46), (60, 48), (62, 50)))
        self.n_sections = np.where((at > 0) & (step > 0), np.maximum(np.minimum(n, (self.size - at) // np.maximum(step, 1)), 0), 0)
        self.first = np.cumsum(self.n_sections) - self.n_sections
        self.of, i = spread(self.n_sections)
        here = at[self.of] + step[self.of] * i
        self.name, self.type = self.read(self.of, here, 4), self.read(self.of, here + 4, 4)
        self.addr, _ = self.address(self.of, here, 16, 12)
        self.file_at, self.bytes, self.step = (self.place(self.of, here, *at) for at in ((24, 16), (32, 20), (56, 36)))
        self.link, self.info = self.field(self.of, here, 40, 24, 4), self.field(self.of, here, 44, 28, 4)

    def read(self, f, at, size: int) -> np.ndarray:
        return self.number(f, at, size, self.big[f])

    def field(self, f, at, wide: int, narrow: int, size: int) -> np.ndarray:
        """A field of entries that 64-bit and 32-bit files have at different places."""
        return self.read(f, behind(at, np.where(self.wide[f], wide, narrow)), size)

    def address(self, f, at, wide: int, narrow: int) -> tuple[np.ndarray, np.ndarray]:
        """A field of eight bytes in 64-bit and of four in 32-bit files, and where it is there."""
        far, known = self.long(f, behind(at, wide), self.big[f])
        near = self.read(f, behind(at, narrow), 4)
        return np.where(self.wide[f], far, np.maximum(near, 0).astype(np.uint64)), np.where(self.wide[f], known, near >= 0)

    def place(self, f, at, wide: int, narrow: int) -> np.ndarray:
        """A place or size inside the file: -1 where it is beyond any file."""
        value, known = self.address(f, at, wide, narrow)
        return np.where(known & (value < 1 << 31), value, 0).astype(np.int64) - np.where(known & (value < 1 << 31), 0, 1)

    def section(self, f, number) -> np.ndarray:
        """Of a file's section its place in the arrays; -1 where the file has none of this number."""
        return np.where((number >= 0) & (number < self.n_sections[f]), self.first[f] + number, -1)

    def of_section(self, section, values: np.ndarray) -> np.ndarray:
        return np.where(section >= 0, np.append(values, -1)[section], -1)

    def rows(self, section, least) -> tuple[np.ndarray, np.ndarray]:
        """Entry size and how many entries a section holds; entries may be larger than the format asks for."""
        at, size = self.of_section(section, self.file_at), self.of_section(section, self.bytes)
        f = np.append(self.of, 0)[section]
        step, fit = np.maximum(self.of_section(section, self.step), least), self.size[f] - at if len(self.size) else at
        return step, np.where(at >= 0, np.maximum(np.where(size >= 0, np.minimum(size, fit), fit) // step, 0), 0)

    def string(self, f, strings, at) -> pa.Array:
        start = self.of_section(strings, self.file_at)
        return self.text(f, np.where((at >= 0) & (at < self.of_section(strings, self.bytes)) & (start >= 0), start + at, -1))

    def symbol_size(self, f) -> np.ndarray:
        return np.where(self.wide[f], 24, 16)

    def symbols(self):
        """Of each entry of the symbol tables its file, table, number and place."""
        tables = np.flatnonzero((self.type == SYMTAB) | (self.type == DYNSYM))
        step, n = self.rows(tables, self.symbol_size(self.of[tables]))
        t, i = spread(n)
        t, i = t[i > 0], i[i > 0]
        return self.of[tables[t]], tables[t], i, self.file_at[tables[t]] + i * step[t]

    def symbol(self, f, at):
        """Kind, binding and section of symbols."""
        info = self.field(f, at, 4, 12, 1)
        return np.where(info >= 0, info & 15, -1), np.where(info >= 0, info >> 4, -1), self.field(f, at, 6, 14, 2)

    def symbol_names(self, f, table, at) -> pa.Array:
        return self.string(f, self.section(f, self.of_section(table, self.link)), self.read(f, at, 4))


def elf_files(binaries: DataFrame) -> DataFrame:
    return binaries.where("format = 'elf'")


def _present(names: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.greater(pc.binary_length(names), 0), False), bool)


def elf_symbols(binaries: DataFrame) -> DataFrame:
    """(binary_id, dynamic, place, name, value, size, kind, bind, section): entries of the static and dynamic symbol tables."""

    def read(contents):
        elf = Elf(contents)
        f, table, i, at = elf.symbols()
        numbers = [decimals(*elf.address(f, at, wide, narrow)) for wide, narrow in ((8, 4), (16, 8))]
        return f, [pa.array(elf.type[table] == DYNSYM), pa.array(i.astype(np.int32)), elf.symbol_names(f, table, at), *numbers, *[longs(v, v >= 0) for v in elf.symbol(f, at)]]

    return read_files(elf_files(binaries), "dynamic boolean, place int, name string, value decimal(20,0), size decimal(20,0), kind long, bind long, section long", read)


def defined(section: np.ndarray) -> np.ndarray:
    """Section numbers of what the file itself defines: neither undefined nor reserved (absolute, common)."""
    return (section > 0) & (section < RESERVED)


def elf_function_symbols(binaries: DataFrame) -> DataFrame:
    """(binary_id, address, name): the entry point, exported functions over it, then static and dynamic function symbols.

    Of several at one address the last of the last table counts.
    """

    def read(contents):
        elf = Elf(contents)
        f, table, i, at = elf.symbols()
        value, known = elf.address(f, at, 8, 4)
        kind, _, section = elf.symbol(f, at)
        kept = np.flatnonzero((kind == FUNCTION) & defined(section) & known & (value > 0))
        names = elf.symbol_names(f[kept], table[kept], at[kept])
        kept, names = kept[_present(names)], names.filter(pa.array(_present(names)))
        every = np.concatenate([elf.each(), f[kept]])
        start, there = elf.entry
        address = decimals(np.concatenate([start, value[kept]]), np.concatenate([there, known[kept]]))
        rank = np.concatenate([np.zeros(elf.n), np.where(elf.type[table[kept]] == DYNSYM, 3, 2)])
        place = np.concatenate([np.zeros(elf.n), i[kept]])
        return every, [address, pa.concat_arrays([pa.array([ENTRY_POINT] * elf.n, pa.utf8()), names]), pa.array(rank.astype(np.int32)), pa.array(place.astype(np.int32))]

    every = read_files(elf_files(binaries), "address decimal(20,0), name string, rank int, place int", read)
    return every.groupBy("binary_id", "address").agg(F.max_by("name", F.struct("rank", "place")).alias("name"))


def elf_exported_symbols(binaries: DataFrame) -> DataFrame:
    """(binary_id, address, name): what the dynamic table defines, functions and data; of aliases the first.

    Thread-local symbols are left out: their value is no address.
    """

    def read(contents):
        elf = Elf(contents)
        f, table, i, at = elf.symbols()
        kind, _, section = elf.symbol(f, at)
        kept = np.flatnonzero((elf.type[table] == DYNSYM) & defined(section) & (kind != THREAD_LOCAL))
        names = elf.symbol_names(f[kept], table[kept], at[kept])
        kept, names = kept[_present(names)], names.filter(pa.array(_present(names)))
        return f[kept], [decimals(*elf.address(f[kept], at[kept], 8, 4)), names, pa.array(i[kept].astype(np.int32))]

    own = read_files(elf_files(binaries), "address decimal(20,0), name string, place int", read)
    return own.groupBy("binary_id", "address").agg(F.min_by("name", "place").alias("name"))


def _steps(elf: Elf, f, at, n) -> tuple[np.ndarray, np.ndarray]:
    """Of chains the number and the places of up to ``n`` entries, each of which tells at 12 how far the next one is."""
    open_, found = np.flatnonzero((at >= 0) & (n > 0)), []
    at, i = at[open_], 0
    while len(open_):
        found.append((open_, np.full(len(open_), i), at))
        far = elf.read(f[open_], at + 12, 4)
        onward = (far > 0) & (far < 1 << 31) & (n[open_] > i + 1)
        open_, at, i = open_[onward], (at + far)[onward], i + 1
    chains, places, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((places, chains))
    return chains[order], at[order]


def _needed_versions(elf: Elf) -> tuple[np.ndarray, pa.Array]:
    """Sorted keys (file and number) and names of versions: two chains, of libraries and of each library's versions."""
    needs = np.flatnonzero(elf.type == VERNEED)
    most = np.where(elf.bytes[needs] >= 0, elf.bytes[needs] // 16, 1 << 31)
    c, at = _steps(elf, elf.of[needs], elf.file_at[needs], np.minimum(elf.info[needs], most))
    f = elf.of[needs[c]]
    ahead = elf.read(f, at + 8, 4)
    d, spot = _steps(elf, f, np.where(ahead >= 0, at + ahead, -1), np.minimum(elf.read(f, at + 2, 2), most[c]))
    f, section = f[d], needs[c[d]]
    names = elf.string(f, elf.section(f, elf.link[section]), elf.read(f, spot + 8, 4))
    key = (f << 17) + elf.read(f, spot + 6, 2) + 1
    order = np.argsort(key, kind="stable")
    return key[order], names.take(pa.array(order))


def elf_relocations(binaries: DataFrame) -> DataFrame:
    """(binary_id, slot, kind, symbol, version, and of the symbol: name, value, bind, symbol_kind, section) of relocation entries.

    ``version`` is the name of the version that the symbol is asked for in, where the file states one.
    """

    def read(contents):
        elf = Elf(contents)
        keys, versions = _needed_versions(elf)
        tables = np.flatnonzero((elf.type == RELA) | (elf.type == REL))
        owner, link = elf.of[tables], elf.link[tables]
        rela, wide = elf.type[tables] == RELA, elf.wide[owner]
        step, n = elf.rows(tables, np.where(wide, np.where(rela, 24, 16), np.where(rela, 12, 8)))
        symbols = elf.section(owner, link)
        symbol_step, n_symbols = elf.rows(symbols, elf.symbol_size(owner))
        # version numbers stand in the first such section with the table's link
        lists = np.flatnonzero((elf.type == VERSYM) & (elf.link >= 0))
        linked = (elf.of[lists] << 32) + elf.link[lists]
        order = np.argsort(linked, kind="stable")
        asked = (owner << 32) + np.maximum(link, 0)
        spot = np.minimum(np.searchsorted(linked[order], asked), max(len(lists) - 1, 0))
        numbers = np.where(linked[order][spot] == asked, lists[order][spot], -1) if len(lists) else np.full(len(tables), -1)

        t, i = spread(n)
        f, at = owner[t], elf.file_at[tables[t]] + i * step[t]
        # 64-bit: two halves, in the file's order; 32-bit: 24 bits and 8 bits
        packed, near, far = elf.read(f, at + 4, 4), elf.read(f, at + 8, 4), elf.read(f, at + 12, 4)
        symbol = np.where(elf.wide[f], np.where(elf.big[f], near, far), packed >> 8)
        kind = np.where(elf.wide[f], np.where(elf.big[f], far, near), packed & 255)
        known = (symbol > 0) & (symbol < n_symbols[t])
        here = np.where(known, elf.of_section(symbols[t], elf.file_at) + symbol * symbol_step[t], -1)
        start = elf.of_section(numbers[t], elf.file_at)
        number = elf.read(f, np.where(known & (start >= 0), start + 2 * symbol, -1), 2)
        key = (f << 17) + (number & 0x7FFF) + 1
        spot = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        hit = (number >= 0) & (keys[spot] == key) if len(keys) else np.zeros(len(f), bool)
        version = versions.take(pa.array(np.where(hit, spot, 0), mask=~hit))
        own = [longs(v, v >= 0) for v in elf.symbol(f, here)]
        names = elf.symbol_names(f, symbols[t], here)
        return f, [decimals(*elf.address(f, at, 0, 0)), longs(kind), longs(symbol), version, names, decimals(*elf.address(f, here, 8, 4)), own[1], own[0], own[2]]

    return read_files(elf_files(binaries), "slot decimal(20,0), kind long, symbol long, version string, name string, value decimal(20,0), bind long, symbol_kind long, section long", read)


def elf_imports(relocations: DataFrame) -> DataFrame:
    """(binary_id, slot, version, name): functions of other files that a slot is to hold; of several the last one."""
    asked = (F.col("section") == 0) & (F.col("symbol_kind") == FUNCTION) & F.col("bind").isin(*OUTSIDE) & (F.col("name") != "")
    held = relocations.where(asked).groupBy("binary_id", "slot").agg(F.max_by(F.struct("version", "name"), F.struct("symbol", "kind")).alias("x"))
    return held.select("binary_id", "slot", "x.version", "x.name")


def linkage_stubs(binaries: DataFrame) -> DataFrame:
    """(binary_id, stub, slot) of x86 files: the slot whose address a stub of a linkage section jumps to.

    A stub is 16 bytes with one indirect jump (FF 25), behind a landing pad or a prefix; the operand is relative to the next
    instruction in 64-bit code and absolute in 32-bit code.
    """

    def read(contents):
        elf = Elf(contents)
        x86 = np.flatnonzero(np.isin(elf.machine[elf.of], (I386, X86_64)))
        f = elf.of[x86]
        named = elf.string(f, elf.section(f, elf.names[f]), elf.name[x86])
        held = x86[np.asarray(pc.fill_null(pc.is_in(named, pa.array(STUBS)), False), bool)]
        # stubs are as large as the format says, whatever the section states
        at = elf.file_at[held]
        fit = elf.size[elf.of[held]] - at
        n = np.where(at >= 0, np.maximum(np.where(elf.bytes[held] >= 0, np.minimum(elf.bytes[held], fit), fit) // STUB_SIZE, 0), 0)
        t, i = spread(n)
        f, at = elf.of[held[t]], at[t] + STUB_SIZE * i
        ahead = np.full(len(f), STUB_SIZE)
        for b in reversed(range(STUB_SIZE - 1)):
            ahead[elf.number(f, at + b, 2) == 0x25FF] = b
        there = ahead <= STUB_SIZE - 6
        f, at, i, ahead, section = f[there], at[there], i[there], ahead[there], held[t][there]
        raw = elf.number(f, at + ahead + 2, 4)
        own, known = elf.addr[section], np.ones(len(f), bool)
        signed = np.where(raw >= 1 << 31, raw - (1 << 32), raw)
        relative = elf.machine[f] == X86_64
        slot = decimals(np.where(relative, own, 0).astype(np.uint64), known, np.where(relative, STUB_SIZE * i + ahead + 6 + signed, raw))
        return f, [decimals(own, known, STUB_SIZE * i), slot]

    return read_files(elf_files(binaries), "stub decimal(20,0), slot decimal(20,0)", read)


def named_stubs(stubs: DataFrame, imports: DataFrame) -> DataFrame:
    """(binary_id, stub, slot, version, name): stub -> slot -> import."""
    return stubs.join(imports, ["binary_id", "slot"]).select("binary_id", "stub", "slot", "version", "name")

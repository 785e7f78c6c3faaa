"""Import, delay-import, export and symbol tables of PE files.

Files are read slice by slice (``batches``): relative addresses go to places in the file by the file's own sections, chains end
where their terminator stands, and only finished entries leave a slice. A chain is read up to ``MOST`` entries; one that has
not ended by then, or runs out of the file, keeps the entries so far and is told by ``import_chains``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.batches import Files, chain, decimals, longs, read_files

#: Fixed values of the format: PE32+ magic, data directories, their descriptors' sizes, COFF symbols and derived types.
WIDE_MAGIC, EXPORTS, IMPORTS, DELAYED = 0x20B, 0, 1, 13
IMPORT_SIZE, DELAY_SIZE, SYMBOL_SIZE, FUNCTION_TYPE = 20, 32, 18, 2
#: Fixed name of an entry point.
ENTRY_POINT = "original_entry_point"
#: Entries of one chain that are read; bytes of a name.
MOST, NAME = 1 << 16, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(n: Column) -> Column:
    """[0 .. n), empty where n is null or not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def c_string(content: Column, at: Column, most: int = NAME) -> Column:
    """The text at a place up to its NUL; null past the end."""
    return F.regexp_replace(F.decode(F.substring(content, at + 1, F.lit(most)), "ISO-8859-1"), "(?s)\\x00.*", "")


def swapped(digits: Column, size: int, start: int = 0) -> Column:
    """The little-endian number of ``size`` bytes in hex digits, from a byte on; up to seven bytes."""
    parts = [F.substring(digits, 2 * (start + i) + 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def number(content: Column, at: Column, size: int) -> Column:
    """The little-endian number at a place, null beyond the end; its bytes are taken once, so that numbers can name places."""
    return let(F.hex(F.substring(content, at + 1, F.lit(size))), lambda d: F.when(F.length(d) == 2 * size, swapped(d, size)))


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the entries of runs of ``n``: the number of its run, and its place there."""
    n = np.maximum(n, 0)
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


class Pe(Files):
    """PE files with their header's fields, sections and data directories."""

    def __init__(self, contents: pa.Array):
        super().__init__(contents)
        f = self.each()
        self.nt = self.number(f, np.full(self.n, 0x3C), 4)
        self.wide = self._head(24, 2) == WIDE_MAGIC
        far, known = self.long(f, self.place(48))
        near = self._head(52, 4)
        self.base, self.based = np.where(self.wide, far, near.astype(np.uint64)), np.where(self.wide, known, near >= 0)
        self.n_sections, self.table = self._head(6, 2), np.where(self.nt >= 0, self.nt + 24 + self._head(20, 2), -1)
        self.first = np.full(self.n, np.iinfo(np.int64).max)
        for i in range(max(self.n_sections.max(initial=0), 0)):
            held = np.flatnonzero((self.n_sections > i) & (self.table + 40 * i + 16 <= self.size))
            if not len(held):
                break
            self.first[held] = np.minimum(self.first[held], self.section(held, i, 12))

    def place(self, at: int) -> np.ndarray:
        return np.where(self.nt >= 0, self.nt + at, -1)

    def _head(self, at: int, size: int) -> np.ndarray:
        return self.number(self.each(), self.place(at), size)

    def section(self, f, i, at: int) -> np.ndarray:
        return self.number(f, np.where(self.table[f] >= 0, self.table[f] + 40 * i + at, -1), 4)

    def place_of(self, f, rva) -> np.ndarray:
        """Where a relative address lies in the file: in the first section that holds it, or in the headers; -1 elsewhere."""
        out = np.where((rva >= 0) & (rva < self.first[f]), rva, -1)
        left, i = np.flatnonzero(rva >= 0), 0
        while True:
            left = left[(self.n_sections[f[left]] > i) & (self.table[f[left]] + 40 * i + 16 <= self.size[f[left]])]
            if not len(left):
                break
            g, r = f[left], rva[left]
            start, raw_size, raw_at = (self.section(g, i, at) for at in (12, 16, 20))
            hit = (start >= 0) & (r >= start) & (r < start + np.maximum(self.section(g, i, 8), raw_size))
            out[left[hit]] = np.where((r - start < raw_size) & (raw_at >= 0), raw_at + r - start, -1)[hit]
            left, i = left[~hit], i + 1
        return np.where(out < self.size[f], out, -1)

    def directory(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Relative address and size of a data directory, where the file has it."""
        first = np.where(self.wide, 112, 96) + 24
        n = self.number(self.each(), np.where(self.nt >= 0, self.nt + first - 4, -1), 4)
        held = np.where((n > i) & (self.nt >= 0), self.nt + first + 8 * i, -1)
        return tuple(self.number(self.each(), np.where(held >= 0, held + at, -1), 4) for at in (0, 4))


def behind(at: np.ndarray, more) -> np.ndarray:
    """A place further on; none stays none."""
    return np.where(at >= 0, at + more, -1)


class _Libraries:
    """The libraries that the import or delay-import tables of files list: their file, name, slots, entries."""

    def __init__(self, pe: Pe, delayed: bool):
        size = DELAY_SIZE if delayed else IMPORT_SIZE
        rva, _ = pe.directory(DELAYED if delayed else IMPORTS)
        self.at = pe.place_of(pe.each(), np.where(rva > 0, rva, -1))
        self.n, self.ended = chain(pe, pe.each(), self.at, np.full(pe.n, size), MOST)
        self.f, i = spread(self.n)
        here = self.at[self.f] + size * i
        field = lambda at: pe.number(self.f, here + at, 4)
        if delayed:
            # old tables hold addresses, today's hold them relative to the base
            less = np.where(field(0) & 1 == 1, 0, pe.base[self.f].astype(np.int64))
            name, self.slots, table = (field(at) - less for at in (4, 12, 16))
        else:
            name, self.slots, names = field(12), field(16), field(0)
            table = np.where(names > 0, names, self.slots)
        self.dll = pc.utf8_lower(pe.text(self.f, pe.place_of(self.f, name)))
        self.step = np.where(pe.wide[self.f], 8, 4)
        self.entries = pe.place_of(self.f, table)
        self.n_entries, self.entries_ended = chain(pe, self.f, self.entries, self.step, MOST)


def _imports(pe: Pe, delayed: bool):
    libs = _Libraries(pe, delayed)
    lib, i = spread(libs.n_entries)
    f, step = libs.f[lib], libs.step[lib]
    at = libs.entries[lib] + step * i
    by_number = pe.number(f, at + step - 1, 1) >= 0x80
    hint = pe.place_of(f, pe.number(f, at, 4) & 0x7FFFFFFF)
    name = pe.text(f, np.where(by_number, -1, behind(hint, 2)))
    kept = by_number | np.asarray(pc.fill_null(pc.greater(pc.binary_length(name), 0), False))
    slot = decimals(pe.base[f], pe.based[f], libs.slots[lib] + step * i)
    columns = [libs.dll.take(pa.array(lib)), name, longs(pe.number(f, at, 2), by_number), slot, pa.array(np.full(len(f), delayed))]
    return f[kept], [c.filter(pa.array(kept)) for c in columns]


def _both(one, other):
    return np.concatenate([one[0], other[0]]), [pa.concat_arrays(pair) for pair in zip(one[1], other[1], strict=True)]


def pe_imports(headers: DataFrame) -> DataFrame:
    """(binary_id, dll, name, ordinal, slot, delayed): what each slot of the import and delay-import tables is to hold.

    An import has a name or an ordinal; ``slot`` is its address in memory, the file loaded at its own base.
    """

    def read(contents):
        pe = Pe(contents)
        return _both(_imports(pe, False), _imports(pe, True))

    return read_files(headers, "dll string, name string, ordinal long, slot decimal(20,0), delayed boolean", read)


def import_chains(headers: DataFrame) -> DataFrame:
    """(binary_id, delayed, dll, n, ended) of each chain that imports are read from; the table of libraries itself has no dll."""

    def chains(pe: Pe, delayed: bool):
        libs = _Libraries(pe, delayed)
        own = np.flatnonzero(libs.at >= 0)
        f = np.concatenate([own, libs.f])
        columns = [
            pa.array(np.full(len(f), delayed)), pa.concat_arrays([pa.nulls(len(own), pa.utf8()), libs.dll]),
            longs(np.concatenate([libs.n[own], libs.n_entries])), pa.array(np.concatenate([libs.ended[own], libs.entries_ended])),
        ]
        return f, columns

    def read(contents):
        pe = Pe(contents)
        return _both(chains(pe, False), chains(pe, True))

    return read_files(headers, "delayed boolean, dll string, n long, ended boolean", read)


def named_ordinals(imports: DataFrame, names: DataFrame) -> DataFrame:
    """``imports`` with every entry named: by itself, by ``names`` (dll, ordinal, name), or by its number as ``#n``."""
    known = names.select("dll", "ordinal", F.col("name").alias("_known"))
    joined = imports.join(known, ["dll", "ordinal"], "left")
    name = F.coalesce("name", "_known", F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    return joined.withColumn("name", name).select(*imports.columns)


def _exports(pe: Pe):
    """Files, indices, names, relative addresses and whether they lead into another library."""
    rva, size = pe.directory(EXPORTS)
    at = pe.place_of(pe.each(), np.where(rva > 0, rva, -1))
    n, n_names, *tables = (pe.number(pe.each(), behind(at, o), 4) for o in (20, 24, 28, 32, 36))
    functions, names, ordinals = (pe.place_of(pe.each(), t) for t in tables)
    fit = lambda n, at, size: np.where(at >= 0, np.minimum(n, (pe.size - at) // size), 0)
    f, j = spread(np.where(names >= 0, np.minimum(fit(n_names, names, 4), fit(n_names, ordinals, 2)), 0))
    index = pe.number(f, ordinals[f] + 2 * j, 2)
    held = index < n[f]
    f, j, index = f[held], j[held], index[held]
    name = pe.text(f, pe.place_of(f, pe.number(f, names[f] + 4 * j, 4)))
    g, bare = spread(fit(n, functions, 4))
    # functions that a name has led to are not listed again
    free = ~np.isin((g << 32) + bare, (f << 32) + index)
    f, index = np.concatenate([f, g[free]]), np.concatenate([index, bare[free]])
    name = pa.concat_arrays([name, pa.nulls(int(free.sum()), pa.utf8())])
    to = pe.number(f, behind(functions[f], 4 * index), 4)
    there = to > 0
    f, index, to, name = f[there], index[there], to[there], name.filter(pa.array(there))
    return f, index, name, to, (to >= rva[f]) & (to < rva[f] + size[f]), pe.number(f, behind(at[f], 16), 4) + index


def pe_exports(headers: DataFrame) -> DataFrame:
    """(binary_id, ordinal, name, address, forwarded): exported functions; one row per name, or without a name.

    ``forwarded`` is where an entry leads that another library holds; such an entry has no address.
    """

    def read(contents):
        pe = Pe(contents)
        f, _, name, to, forward, ordinal = _exports(pe)
        forwarded = pe.text(f, pe.place_of(f, np.where(forward, to, -1)))
        return f, [longs(ordinal), name, decimals(pe.base[f], pe.based[f] & ~forward, to), forwarded]

    return read_files(headers, "ordinal long, name string, address decimal(20,0), forwarded string", read)


def _symbols(pe: Pe):
    """Files, places in the list and in the file, and names of the records of COFF symbol tables."""
    at, n = pe._head(12, 4), pe._head(16, 4)
    n = np.where(at > 0, np.minimum(n, (pe.size - at) // SYMBOL_SIZE), 0)
    open_, spot, found = np.flatnonzero(n > 0), at[n > 0], []
    end, i = at + SYMBOL_SIZE * n, 0
    while len(open_):
        found.append((open_, np.full(len(open_), i), spot))
        # a record tells how many auxiliary ones follow it
        spot = spot + SYMBOL_SIZE * (1 + pe.number(open_, spot + SYMBOL_SIZE - 1, 1))
        more = spot < end[open_]
        open_, spot, i = open_[more], spot[more], i + 1
    f, place, spot = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    far = pe.number(f, spot, 4) == 0
    own, other = pe.text(f, spot, 8), pe.text(f, np.where(far, end[f] + pe.number(f, spot + 4, 4), -1))
    return f, place, spot, pc.if_else(pa.array(far), other, own)


def _signed(value: np.ndarray) -> np.ndarray:
    return np.where(value >= 0x8000, value - 0x10000, value)


def coff_symbols(headers: DataFrame) -> DataFrame:
    """(binary_id, place, name, value, section, kind, class): the COFF symbol table; auxiliary records are skipped."""

    def read(contents):
        pe = Pe(contents)
        f, place, spot, name = _symbols(pe)
        value, section, kind, storage = (pe.number(f, spot + o, s) for o, s in ((8, 4), (12, 2), (14, 2), (16, 1)))
        return f, [pa.array(place.astype(np.int32)), name, longs(value), longs(_signed(section)), longs(kind), longs(storage)]

    return read_files(headers, "place int, name string, value long, section long, kind long, class long", read)


def printable(name: Column) -> Column:
    return name.rlike("^[ -~]+$")


def pe_function_symbols(headers: DataFrame) -> DataFrame:
    """(binary_id, address, name): the entry point, exported functions over it, and function symbols of the file over both.

    Names are printable ASCII; of several exports at one address the last counts, of several symbols the first.
    """

    def read(contents):
        pe = Pe(contents)
        entry = pe._head(40, 4)
        start = np.flatnonzero(pe.based & (entry >= 0))
        f, _, name, to, forward, ordinal = _exports(pe)
        exported = np.flatnonzero(~forward)
        g, place, spot, own = _symbols(pe)
        section, kind, value = _signed(pe.number(g, spot + 12, 2)), pe.number(g, spot + 14, 2), pe.number(g, spot + 8, 4)
        rva = np.where((section > 0) & (section <= pe.n_sections[g]), pe.section(g, section - 1, 12), -1)
        functions = np.flatnonzero(((kind >> 4) & 3 == FUNCTION_TYPE) & (rva >= 0))
        every = np.concatenate([start, f[exported], g[functions]])
        address = decimals(pe.base[every], pe.based[every], np.concatenate([entry[start], to[exported], (rva + value)[functions]]))
        rank = np.repeat([0, 1, 2], [len(start), len(exported), len(functions)])
        names = pa.concat_arrays([pa.array([ENTRY_POINT] * len(start), pa.utf8()), name.take(pa.array(exported)), own.take(pa.array(functions))])
        order = np.concatenate([np.zeros(len(start), np.int64), ordinal[exported], -place[functions]])
        return every, [address, names, pa.array(rank.astype(np.int32)), longs(order)]

    every = read_files(headers, "address decimal(20,0), name string, rank int, place long", read).where(printable(F.col("name")))
    return every.groupBy("binary_id", "address").agg(F.max_by("name", F.struct("rank", "place")).alias("name"))

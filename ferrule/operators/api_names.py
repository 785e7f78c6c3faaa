"""Names of library functions whose addresses stand in memory dumps.

A database lists what libraries exported on some system: (os, place, entry, base, bitness, name, ordinal, address), where
``os`` orders the systems, ``place`` the entries, and addresses count from a library's base. It holds systems, not the
corpus, and Spark decides how to join it. Dumps come as the aligned words of their pages. A dump of another machine has its
libraries elsewhere: ``library_shifts`` finds, for each library, by how much, from the words alone. The distinct differences of
one dump are counted in one worker's memory, whatever the number of dumps.

Rows without binary_id or word, and words below ``LOW`` (never mapped, and most of any image), name nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.sources.batches import Files, decimals, flat
from ferrule.sources.pages import PAGE

#: Fixed: libraries are loaded at multiples of this, and nothing below it is mapped.
LOW = 1 << 16
#: Pages that are cut at once; pairs of words and exports and rows that are looked at at once; exports that a worker holds.
PAGES, PAIRS, ROWS, EXPORTS = 1024, 1 << 20, 1 << 16, 1 << 23
_MODULE = "map<string, struct<base_address: decimal(20,0), bitness: int, exports: array<struct<name: string, ordinal: long, address: decimal(20,0)>>>>"


def database_exports(documents: DataFrame) -> DataFrame:
    """The database (os, place, entry, base, bitness, name, ordinal, address) of JSON documents (os, content), one for a system.

    A document's ``dlls`` maps entries to base_address, bitness and exports; entries keep their order as ``place``.
    """
    parsed = documents.select("os", F.posexplode(F.from_json("content", f"dlls {_MODULE}")["dlls"]).alias("at", "entry", "m"))
    each = parsed.select("os", "at", "entry", "m", F.posexplode("m.exports").alias("i", "e"))
    place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("i")
    return each.select("os", place.alias("place"), "entry", F.col("m.base_address").alias("base"), F.col("m.bitness").alias("bitness"), "e.name", "e.ordinal", "e.address")


def named_exports(database: DataFrame) -> DataFrame:
    """(os, dll, api, address): absolute addresses, one export each, the last one listed; without a name ``None<ordinal>``.

    An entry's name is made of its third part and those behind it, parts being set apart by underscores.
    """
    parts = F.split("entry", "_")
    dll = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "_")
    api = F.coalesce("name", F.concat(F.lit("None<"), F.col("ordinal").cast("string"), F.lit(">")))
    at = (F.col("base") + F.col("address")).cast("decimal(20,0)")
    rows = database.select("os", "place", dll.alias("dll"), api.alias("api"), at.alias("address")).where("address IS NOT NULL")
    return rows.groupBy("os", "address").agg(F.max_by(F.struct("dll", "api"), "place").alias("e")).select("os", "e.dll", "e.api", "address")


def _cut_words(size: int):
    """Cuts Arrow batches of (binary_id, page, bytes) into words, few of which are left; most of a page is zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                files = Files(part.column(2))
                n = files.size // size
                f = np.repeat(np.arange(files.n), n)
                data = files.data[flat(files.start, n * size)].view(f"<u{size}").astype(np.uint64)
                held = np.flatnonzero(data >= LOW)
                i = held - (np.cumsum(n) - n)[f[held]]
                own = pa.array(f[held])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), pa.array(i.astype(np.int32)), decimals(data[held], np.ones(len(held), bool))], names=["binary_id", "page", "i", "word"]
                )

    return run


def page_words(pages: DataFrame, layout: DataFrame, size: int) -> DataFrame:
    """(binary_id, addr, word): the aligned words of ``size`` bytes of pages, those below ``LOW`` left out."""
    kind = pages.schema["binary_id"].dataType.simpleString()
    cut = pages.select("binary_id", F.col("page").cast("long").alias("page"), "bytes").mapInArrow(_cut_words(size), f"binary_id {kind}, page long, i int, word decimal(20,0)")
    bases = layout.where("fault IS NULL").select("binary_id", F.col("base").cast("decimal(20,0)").alias("base"))
    addr = (F.col("base") + F.col("page") * PAGE + F.col("i") * size).cast("decimal(20,0)")
    return cut.join(bases, "binary_id").select("binary_id", addr.alias("addr"), "word")


def resolve_apis(words: DataFrame, exports: DataFrame) -> DataFrame:
    """``words`` (binary_id, word and others) that are addresses of exports, with ``dll`` and ``api``; of systems the first counts."""
    first = exports.groupBy("address").agg(F.min_by(F.struct("dll", "api"), "os").alias("e")).select(F.col("address").alias("word"), "e.dll", "e.api")
    return words.withColumn("word", F.col("word").cast("decimal(20,0)")).where(F.col("word") >= LOW).join(first, "word").select(*words.columns, "dll", "api")


class _Exports:
    """Different exports by the lower 16 bits of their addresses; what lies above is counted from each library's least."""

    def __init__(self, rows: pa.Table):
        coded = [rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("_os", "_dll")]
        codes = [np.asarray(c.indices, np.int64) for c in coded]
        names, first, lib = np.unique(codes[0] * (len(coded[1].dictionary) + 1) + codes[1], return_index=True, return_inverse=True)
        self.names = [c.take(pa.array(first)).dictionary_decode() for c in coded]
        self.libs, high = len(names), np.asarray(rows["_high"], np.int64)
        self.least = np.full(self.libs, np.iinfo(np.int64).max)
        np.minimum.at(self.least, lib, high)
        offset = high - self.least[lib]
        self.span = int(offset.max()) + 1
        # places beyond 63 bits need libraries that lie all over the address space
        self.kind = np.int64 if LOW * self.libs * self.span < 1 << 62 else object
        self.place = np.unique(self._place(np.asarray(rows["_low"], np.int64), lib, offset))
        group, self.offset = (x.astype(np.int64) for x in (self.place // self.span, self.place % self.span))
        self.lib = group % self.libs
        self.start = np.searchsorted(group // self.libs, np.arange(LOW + 1))

    def _place(self, low, lib, offset):
        return (low.astype(self.kind) * self.libs + lib) * self.span + offset

    def shifts(self, dump, low, high, least: int):
        """(dump, lib, shift, n): each dump's best shift of each library, of different words in the order of dump and high.

        Words that vote for one shift lie within a library's span, so a dump falls into clusters, and a cluster of few words
        has no shift. The cells of a dump are those of each library, in which each cluster has as many as it has shifts.
        """
        apart = (np.diff(dump, prepend=-1) != 0) | (np.diff(high, prepend=0) >= self.span)
        size = np.diff(np.append(np.flatnonzero(apart), len(dump)))
        dump, low, high, apart = (x[np.repeat(size >= least, size)] for x in (dump, low, high, apart))
        n = self.start[low + 1] - self.start[low]
        found = []
        if len(dump):
            first, of = np.flatnonzero(apart), np.cumsum(apart) - 1
            bottom = high[first]
            width = high[np.append(first[1:], len(dump)) - 1] - bottom + self.span
            owners, held = np.unique(dump[first], return_index=True)
            kind = object if int(width.astype(object).sum()) * self.libs >= 1 << 62 else np.int64
            ends = np.cumsum(width.astype(kind))
            begin = ends - width
            origin, size = begin[held], np.diff(np.append(begin[held], ends[-1]))
            own = np.searchsorted(owners, dump)
            cell = origin[own] * (self.libs - 1) + begin[of] + high - bottom[of] + (self.span - 1)
            votes, at, seen = [], 0, np.cumsum(n)
            while at < len(dump):
                until = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + PAIRS, "right")))
                few, e = n[at:until], flat(self.start[low[at:until]], n[at:until])
                votes.append(_counted(np.repeat(cell[at:until], few) + self.lib[e] * np.repeat(size[own[at:until]], few) - self.offset[e]))
                if len(votes) > 1 and sum(len(v[0]) for v in votes[1:]) > len(votes[0][0]):
                    votes = [_merged(votes)]
                at = until
            cells, count = _merged(votes) if len(votes) > 1 else votes[0]
            cells, count = cells[count >= least], count[count >= least]
            own = np.searchsorted(origin * self.libs, cells, "right") - 1
            rest = cells - origin[own] * self.libs
            lib, rest = (rest // size[own]).astype(np.int64), rest % size[own]
            of = np.searchsorted(begin, origin[own] + rest, "right") - 1
            shift = (origin[own] + rest - begin[of]).astype(np.int64) - (self.span - 1) + bottom[of] - self.least[lib]
            found = [owners[own], lib, shift, count]
        if not found or not len(found[0]):
            return (np.zeros(0, np.int64),) * 4
        dump, lib, shift, count = found
        first = np.flatnonzero((np.diff(dump, prepend=-1) != 0) | (np.diff(lib, prepend=-1) != 0))
        size = np.diff(np.append(first, len(dump)))
        top = np.maximum.reduceat(count, first)
        # of equal ones the nearest, then the lower
        near = np.minimum.reduceat(np.where(count == np.repeat(top, size), 2 * np.abs(shift) + (shift > 0), np.iinfo(np.int64).max), first)
        return dump[first], lib[first], np.where(near & 1, near >> 1, -(near >> 1)), top

    def resolved(self, dump, low, high, shifts):
        """(row, number of the shift) of the rows that are exports of a library at its shift."""
        first, last = (np.searchsorted(shifts[0], dump, side) for side in ("left", "right"))
        rows, s = np.repeat(np.arange(len(dump)), last - first), flat(first, last - first)
        lib = shifts[1][s]
        offset = high[rows] - shifts[2][s] - self.least[lib]
        within = np.flatnonzero((offset >= 0) & (offset < self.span))
        rows, s = rows[within], s[within]
        asked = self._place(low[rows], lib[within], offset[within])
        known = self.place[np.minimum(np.searchsorted(self.place, asked), len(self.place) - 1)] == asked
        return rows[known], s[known]


def _counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different cells in their order, and how often each is met."""
    if cells.dtype == np.int64 and len(cells):
        least = cells.min()
        if cells.max() - least < 1 << 32:  # half as many bytes to sort
            found, n = _counted_sorted(np.sort((cells - least).astype(np.uint32)))
            return found.astype(np.int64) + least, n
    return _counted_sorted(np.sort(cells))


def _counted_sorted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
    return cells[first], np.diff(np.append(first, len(cells)))


def _merged(votes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, count = (np.concatenate(v) for v in zip(*votes))
    order = np.argsort(cells, kind="stable")
    found, n = _counted_sorted(cells[order])
    return found, np.add.reduceat(count[order], np.cumsum(n) - n) if len(found) else n


def _dumps(kind: str, names: list[str], least: int, resolve: bool):
    """Reads a part: its exports, then its words by dump. Dumps are looked at many at once, a large one by itself."""

    def looked_at(exports: _Exports, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["binary_id"].combine_chunks()
        new = np.append(True, np.asarray(pc.not_equal(ids[1:], ids[:-1]), bool))
        dump, low, high = np.cumsum(new) - 1, np.asarray(rows["_low"], np.int64), np.asarray(rows["_high"], np.int64)
        other = new | (np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0)
        pairs = np.cumsum(np.where(other, exports.start[low + 1] - exports.start[low], 0))
        first = np.append(np.flatnonzero(new), len(dump))
        after = np.append(0, pairs[first[1:] - 1])
        at = 0
        while at < len(first) - 1:
            until = max(at + 1, int(np.searchsorted(after, after[at] + PAIRS, "right")) - 1)
            part = slice(first[at], first[until])
            words = np.flatnonzero(other[part])
            d, lo, hi = dump[part], low[part], high[part]
            found = exports.shifts(d[words], lo[words], hi[words], least)
            if resolve:
                row, s = exports.resolved(d, lo, hi, found)
                cut = rows.slice(part.start, len(d)).select(names).take(pa.array(row)).combine_chunks()
                left = [cut[c].combine_chunks() if len(row) else pa.array([], cut[c].type) for c in names]
            else:
                s, left = np.arange(len(found[0])), [ids.take(pa.array(first[:-1][found[0]]))]
            own = [c.take(pa.array(found[1][s])) for c in exports.names]
            if len(s):
                yield pa.RecordBatch.from_arrays([*left, *own, pa.array(found[2][s]), pa.array(found[3][s].astype(np.int64))], names=[*(names if resolve else ["binary_id"]), "_os", "_dll", "_shift", "_n"])
            at = until

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []
        exports, waiting, n = None, [], 0
        for batch in batches:
            exported = batch.column("binary_id").null_count
            if exported:
                known.append(batch.slice(0, exported).select(["_os", "_dll", "_low", "_high"]))
            batch = batch.slice(exported)
            if not batch.num_rows:
                continue
            if exports is None and not known:
                return
            if exports is None:
                exports, known = _Exports(pa.Table.from_batches(known)), []
            waiting.append(batch)
            n += batch.num_rows
            if n < ROWS or waiting[0].column("binary_id")[0] == batch.column("binary_id")[-1]:
                continue
            rows = pa.Table.from_batches(waiting)
            ids = batch.column("binary_id")
            # the last dump may go on
            open_ = pc.sum(pc.equal(ids, ids[-1])).as_py()
            if open_ == batch.num_rows:
                open_ = pc.sum(pc.equal(rows["binary_id"], ids[-1])).as_py()
            yield from looked_at(exports, rows.slice(0, len(rows) - open_))
            waiting, n = rows.slice(len(rows) - open_).to_batches(), open_
        if waiting:
            yield from looked_at(exports, pa.Table.from_batches(waiting))

    return run


def _shifted(words: DataFrame, exports: DataFrame, least: int, resolve: bool) -> DataFrame:
    """Dumps are dealt into a fixed number of parts, each of which reads all exports first, and votes where its words are.

    Pairs of words and exports with equal lower 16 bits are counted in slices and never become rows. Where the exports are more
    than ``EXPORTS``, libraries are dealt too.
    """
    high = lambda c: F.expr(f"CAST({c} AS DECIMAL(20,0)) DIV {LOW}").alias("_high")
    low = lambda c: F.expr(f"CAST(CAST({c} AS DECIMAL(20,0)) % {LOW} AS INT)").alias("_low")
    named = exports.where("address >= 0").select(F.col("os").alias("_os"), F.col("dll").alias("_dll"), low("address"), high("address"))
    parts, shares = 2 * words.sparkSession.sparkContext.defaultParallelism, 1 + named.count() // EXPORTS
    dealt = lambda first, step, n: F.explode(F.sequence(first, first + step * (n - 1), F.lit(step))).alias("_part")
    known = named.select("*", dealt(F.pmod(F.hash("_os", "_dll"), F.lit(shares)), shares, parts))
    seen = words.where(f"binary_id IS NOT NULL AND word >= {LOW}").select("*", low("word"), high("word"), dealt(F.pmod(F.hash("binary_id"), F.lit(parts)) * shares, 1, shares))
    rows = known.unionByName(seen, allowMissingColumns=True).repartitionById(parts * shares, "_part").drop("_part")
    # exports have no binary_id and come first
    rows = rows.sortWithinPartitions(F.col("binary_id").asc_nulls_first(), "_high", "_low")
    kept = words.columns if resolve else ["binary_id"]
    kinds = {f.name: f.dataType.simpleString() for f in (*words.schema, *named.schema)}
    made = ", ".join(f"`{c}` {kinds[c]}" for c in [*kept, "_os", "_dll"]) + ", _shift long, _n long"
    if not resolve:
        rows = rows.select("binary_id", "_os", "_dll", "_low", "_high")
    return rows.mapInArrow(_dumps(kinds["binary_id"], kept, least, resolve), made)


def library_shifts(words: DataFrame, exports: DataFrame, least: int = 2) -> DataFrame:
    """(binary_id, os, dll, shift, n_apis): how far each library of a dump lies from where the database has it.

    Libraries move by multiples of ``LOW``, so a word and an export may belong together if their lower 16 bits agree; a word
    meets one export of 65,536. Each pair votes for its difference; the one that most different exports agree on, ``least``
    or more, is the shift, of equal ones the nearest, then the lower.
    """
    found = _shifted(words.select("binary_id", "word"), exports, least, False)
    return found.select("binary_id", F.col("_os").alias("os"), F.col("_dll").alias("dll"), (F.col("_shift") * LOW).cast("decimal(20,0)").alias("shift"), F.col("_n").alias("n_apis"))


def resolve_shifted(words: DataFrame, exports: DataFrame, least: int = 2) -> DataFrame:
    """``words`` (binary_id, word and others) that are exports of libraries at their shifts, with ``os``, ``dll`` and ``api``.

    Only words that are exports leave the parts, to be joined with the names.
    """
    words = words.withColumn("word", F.col("word").cast("decimal(20,0)"))
    found = _shifted(words, exports, least, True)
    address = (F.col("word") - F.col("_shift").cast("decimal(20,0)") * LOW).cast("decimal(20,0)")
    met = found.select(*words.columns, F.col("_os").alias("os"), F.col("_dll").alias("dll"), address.alias("address"))
    return met.join(exports, ["os", "dll", "address"]).select(*words.columns, "os", "dll", "api")

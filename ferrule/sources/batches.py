"""Numbers and texts at places of many files at once: a few NumPy gathers over the contents of an Arrow batch.

Readers of tables in files run as ``mapInArrow`` over (binary_id, content): Spark deals the files, and a slice of some
megabytes of them is read by one call each for a field, whatever number of entries has it. -1 stands for what is not there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes and number of files that are read at once; bytes of a name.
SLICE, FILES, NAME = 4 << 20, 4096, 4096


class Files:
    """Contents one after the other; ``f`` is always the number of a file, ``at`` a place in it."""

    def __init__(self, contents: pa.Array):
        self.n = len(contents)
        raw = contents.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        held = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if self.n and raw.buffers()[2] else np.zeros(0, np.uint8)
        self.data = np.concatenate([held, np.zeros(8, np.uint8)])
        self.start, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.zeros = np.flatnonzero(self.data == 0)

    def each(self) -> np.ndarray:
        return np.arange(self.n)

    def _bytes(self, f, at, size: int):
        known = (at >= 0) & (at + size <= self.size[f])
        return known, np.where(known, self.start[f] + at, 0)

    def number(self, f, at, size: int, big=None) -> np.ndarray:
        """Unsigned number of up to seven bytes, little-endian unless ``big``; -1 beyond the end."""
        known, spot = self._bytes(f, at, size)
        return np.where(known, self._value(spot, size, big).astype(np.int64), -1)

    def long(self, f, at, big=None) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned numbers of eight bytes, and which of them are there."""
        known, spot = self._bytes(f, at, 8)
        return np.where(known, self._value(spot, 8, big), 0).astype(np.uint64), known

    def _value(self, spot, size: int, big) -> np.ndarray:
        little = sum(self.data[spot + i].astype(np.uint64) << np.uint64(8 * i) for i in range(size))
        if big is None:
            return little
        return np.where(big, sum(self.data[spot + i].astype(np.uint64) << np.uint64(8 * (size - 1 - i)) for i in range(size)), little)

    def text(self, f, at, most: int = NAME) -> pa.Array:
        """Latin-1 texts up to their NUL, the end of the file or ``most`` bytes; null where there is no place."""
        known = at >= 0
        spot = self.start[f] + np.where(known, np.minimum(at, self.size[f]), 0)
        end = np.append(self.zeros, len(self.data))[np.searchsorted(self.zeros, spot)]
        end = np.minimum(np.minimum(end, spot + most), self.start[f] + self.size[f])
        size = np.where(known, end - spot, 0)
        return latin(self.data[flat(spot, size)], size, known)


def flat(start, size) -> np.ndarray:
    """start, start + 1 .. start + size - 1 of each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def latin(data: np.ndarray, size: np.ndarray, known: np.ndarray) -> pa.Array:
    """Texts of ``size`` Latin-1 bytes each."""
    high = data >= 128
    if high.any():
        ends = np.cumsum(size)
        more = np.concatenate([[0], np.cumsum(high)])
        size = size + more[ends] - more[ends - size]
        wide = np.repeat(data, 1 + high)
        first = np.cumsum(1 + high) - (1 + high)
        wide[first[high]], wide[first[high] + 1] = 0xC0 | (data[high] >> 6), 0x80 | (data[high] & 0x3F)
        data = wide
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.utf8(), len(size), [mask(known), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def mask(known: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(known, bitorder="little"))


def longs(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int64), mask=None if known is None else ~known)


def decimals(low: np.ndarray, known: np.ndarray, add: np.ndarray | int = 0) -> pa.Array:
    """decimal(20,0) of unsigned numbers with something added, which may exceed eight bytes or fall below zero."""
    add = np.broadcast_to(np.asarray(add, np.int64), low.shape)
    total = low + add.astype(np.uint64)
    carry = np.where(add >= 0, (total < low).astype(np.int64), -(total > low).astype(np.int64))
    words = np.stack([total, carry.astype(np.uint64)], 1)
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(low), [mask(known), pa.py_buffer(np.ascontiguousarray(words))])


def chain(files: Files, f, at, step, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of ``step`` bytes before the first of nothing but zeros, and whether that one was found, of each chain."""
    n, ended, open_ = np.zeros(len(f), np.int64), np.zeros(len(f), bool), np.flatnonzero(at >= 0)
    for i in range(most):
        place = at[open_] + i * step[open_]
        open_, place = (x[place + step[open_] <= files.size[f[open_]]] for x in (open_, place))
        if not len(open_):
            break
        # an entry is empty if no byte that is not zero lies before its end
        spot = files.start[f[open_]] + place
        empty = np.ones(len(open_), bool)
        for b in range(int(step[open_].max())):
            empty &= (files.data[spot + np.minimum(b, step[open_] - 1)]) == 0
        ended[open_[empty]] = True
        open_ = open_[~empty]
        n[open_] += 1
    return n, ended


def read_files(files: DataFrame, schema: str, read: Callable[[pa.Array], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """(binary_id, and the columns of ``schema``) of the entries that ``read`` finds: their files' numbers and columns."""
    kind = files.schema["binary_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = batch.column(0), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(contents), 0), np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(ids):
                most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right"))
                until = min(max(most, at + 1), at + FILES, len(ids))
                f, columns = read(contents.slice(at, until - at))
                own = ids.slice(at, until - at).take(pa.array(f))
                yield pa.RecordBatch.from_arrays([own, *columns], names=names)
                at = until

    result = f"binary_id {kind}, {schema}"
    names = ["binary_id", *[c.split()[0] for c in schema.split(", ")]]
    return files.select("binary_id", "content").mapInArrow(run, result)


def whole_binaries(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of whole binaries, whose rows come one after the other: ``rows`` rows or ``size`` bytes, or one binary, and more."""
    waiting, n, held = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        n, held, ids = n + batch.num_rows, held + batch.nbytes, batch.column("binary_id")
        if (n < rows and held < size) or waiting[0].column("binary_id")[0] == ids[-1]:
            continue
        table = pa.Table.from_batches(waiting)
        # the last binary may go on
        open_ = pc.sum(pc.equal(ids, ids[-1])).as_py()
        if open_ == batch.num_rows:
            open_ = pc.sum(pc.equal(table["binary_id"], ids[-1])).as_py()
        yield table.slice(0, len(table) - open_)
        table = table.slice(len(table) - open_)
        waiting, n, held = table.to_batches(), open_, table.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting)

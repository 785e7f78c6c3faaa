"""Names in DEX files: strings, types, prototypes, fields and methods, each pool an index into the ones before it.

A slice of files is read at once (``batches``): its pools are arrays, so that following an index is an array access and no join,
and only finished names leave the slice. Strings are modified UTF-8: UTF-16 units of one to three bytes each, NUL as two bytes, and characters beyond 16 bits
as two surrogates.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.batches import Files, flat, latin, read_files
from ferrule.sources.pe_tables import let, spread

#: Fixed places in the header of each pool's count (its start follows), and sizes of the pools' entries.
POOLS = {"strings": (56, 4), "types": (64, 4), "protos": (72, 12), "fields": (80, 8), "methods": (88, 8)}
#: What stands for a name that an index does not lead to.
UNKNOWN = "<?>"


def mutf8(raw: Column, units: Column) -> Column:
    """Text of the first ``units`` UTF-16 units of modified UTF-8; what is no such text becomes U+FFFD."""
    plain = F.regexp_extract(F.decode(raw, "ISO-8859-1"), "^[\\x01-\\x7f]*", 0)

    def bits(d: Column, at: int, mask: int) -> Column:
        return F.conv(F.substring(d, at, 2), 16, 10).cast("int").bitwiseAND(F.lit(mask))

    def unit(d: Column) -> Column:
        two = bits(d, 1, 31) * 64 + bits(d, 3, 63)
        three = bits(d, 1, 15) * 4096 + bits(d, 3, 63) * 64 + bits(d, 5, 63)
        value = F.when(F.length(d) == 6, three).when(F.length(d) == 4, two).when(d < "80", bits(d, 1, 127))
        return F.lpad(F.hex(F.coalesce(value, F.lit(0xFFFD)).cast("long")), 4, "0")

    def decoded(hexed: Column) -> Column:
        found = F.slice(F.regexp_extract_all(hexed, F.lit("([0-7].|[CD].[89AB].|E.[89AB].[89AB].|..)"), F.lit(1)), F.lit(1), units)
        joined = F.array_join(F.transform(found, unit), " ")
        whole = F.regexp_replace(joined, "D[89AB]..(?! D[C-F])|(?<!D[89AB].. )D[C-F]..", "FFFD")
        return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")

    return F.when(F.length(plain) >= units, F.substring(plain, F.lit(1), units)).otherwise(let(F.hex(raw), decoded))


_UNIT = re.compile(rb"[\x00-\x7f]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|.", re.S)


@lru_cache(1 << 14)
def _text(raw: bytes, units: int) -> str:
    """What ``mutf8`` gives, of one text."""
    out = bytearray()
    for d in _UNIT.findall(raw)[:units]:
        if len(d) == 1:
            value = d[0] if d[0] < 128 else 0xFFFD
        else:
            value = (d[0] & 31) << 6 | d[1] & 63 if len(d) == 2 else (d[0] & 15) << 12 | (d[1] & 63) << 6 | d[2] & 63
        out += value.to_bytes(2, "little")
    return re.sub("[\ud800-\udfff]", "\ufffd", out.decode("utf-16-le", "surrogatepass"))


class Dex(Files):
    """DEX files with the names of their pools: per pool how many entries each file has, and all of them in a row."""

    def __init__(self, contents: pa.Array):
        super().__init__(contents)
        self.counts, self.names = {}, {}
        for pool in POOLS:
            f, at = self._entries(pool)
            self.names[pool] = getattr(self, f"_{pool}")(f, at)

    def _entries(self, pool: str) -> tuple[np.ndarray, np.ndarray]:
        """Files and places of the entries of a pool that lie in the file."""
        head, size = POOLS[pool]
        f = self.each()
        n, start = self.number(f, f * 0 + head, 4), self.number(f, f * 0 + head + 4, 4)
        self.counts[pool] = np.where(start > 0, np.maximum(np.minimum(n, (self.size - start) // size), 0), 0)
        f, i = spread(self.counts[pool])
        return f, start[f] + size * i

    def _name(self, pool: str, f, index, unknown: str = UNKNOWN) -> pa.Array:
        n = self.counts[pool]
        held = (index >= 0) & (index < n[f])
        at = np.where(held, (np.cumsum(n) - n)[f] + index, 0)
        return pc.fill_null(self.names[pool].take(pa.array(at, mask=~held)), unknown)

    def _strings(self, f, at) -> pa.Array:
        data = self.number(f, at, 4)
        data = np.where(data < self.size[f], data, -1)
        # a LEB128 number of up to three bytes
        byte = [self.number(f, np.where(data >= 0, data + i, -1), 1) for i in range(3)]
        there = [(b >= 0) & (b < 128) for b in byte]
        one, two = there[0], (byte[0] >= 128) & there[1]
        three = (byte[0] >= 128) & (byte[1] >= 128) & there[2]
        known, size = one | two | three, np.where(one, 1, np.where(two, 2, 3))
        low = lambda b: b & 127
        units = np.where(one, byte[0], np.where(two, low(byte[0]) + 128 * byte[1], low(byte[0]) + 128 * low(byte[1]) + 16384 * byte[2]))
        units = np.where(known, units, 0)
        spot, end = self.start[f] + np.where(known, data + size, 0), self.start[f] + self.size[f]
        odd = np.concatenate([[0], np.cumsum((self.data == 0) | (self.data >= 128))])
        until = np.minimum(spot + units, end)
        plain = known & (spot + units <= end) & (odd[until] == odd[np.minimum(spot, until)])
        length = np.where(plain, units, 0)
        names = latin(self.data[flat(spot, length)], length, plain)
        rest = np.flatnonzero(known & ~plain)
        texts = [_text(self.data[a : min(a + 3 * u, e)].tobytes(), u) for a, u, e in zip(spot[rest].tolist(), units[rest].tolist(), end[rest].tolist(), strict=True)]
        order = np.arange(len(f))
        order[rest] = len(f) + np.arange(len(rest))
        return pa.concat_arrays([names, pa.array(texts, pa.utf8())]).take(pa.array(order))

    def _types(self, f, at) -> pa.Array:
        return self._name("strings", f, self.number(f, at, 4))

    def _protos(self, f, at) -> pa.Array:
        where = self.number(f, at + 8, 4)
        held = (where > 0) & (where < self.size[f])
        n, fit = self.number(f, np.where(held, where, -1), 4), (self.size[f] - where) // 2
        n = np.where(held, np.where(n >= 0, np.minimum(n, fit), fit), 0)
        entry, i = spread(n)
        g = f[entry]
        parameters = self._name("types", g, self.number(g, where[entry] + 4 + 2 * i, 2))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), parameters)
        return pc.binary_join_element_wise("(", pc.binary_join(listed, ""), ")", self._name("types", f, self.number(f, at + 4, 4)), "")

    def _fields(self, f, at) -> pa.Array:
        own, kind = (self._name("types", f, self.number(f, at + o, 2)) for o in (0, 2))
        return pc.binary_join_element_wise(own, "->", self._name("strings", f, self.number(f, at + 4, 4)), ":", kind, "")

    def _methods(self, f, at) -> pa.Array:
        prototype = self._name("protos", f, self.number(f, at + 2, 2), f"(){UNKNOWN}")
        return pc.binary_join_element_wise(self._name("types", f, self.number(f, at, 2)), "->", self._name("strings", f, self.number(f, at + 4, 4)), prototype, "")


def dex_names(binaries: DataFrame) -> DataFrame:
    """(binary_id, kind, number, name) of every entry of the five pools; methods and fields are written out in full."""

    def read(contents):
        dex = Dex(contents)
        each = [spread(dex.counts[pool]) for pool in POOLS]
        f, i = (np.concatenate(x) for x in zip(*each, strict=True))
        kinds = pa.array([pool[:-1] for pool in POOLS]).take(pa.array(np.repeat(np.arange(len(POOLS)), [len(x) for x, _ in each])))
        return f, [kinds, pa.array(i.astype(np.int32)), pa.concat_arrays([dex.names[pool] for pool in POOLS])]

    return read_files(binaries.where("format = 'dex'"), "kind string, number int, name string", read)


def resolved(references: DataFrame, names: DataFrame) -> DataFrame:
    """``references`` (binary_id, kind, number, ...) with ``name``; a number that leads nowhere is named ``kind@number``."""
    found = references.join(names, ["binary_id", "kind", "number"], "left")
    return found.withColumn("name", F.coalesce("name", F.concat("kind", F.lit("@"), F.col("number").cast("string"))))

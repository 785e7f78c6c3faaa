"""DEX names built byte by byte, and modified UTF-8 against Python's own reading."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from ferrule.sources import binaries, dex_names


def leb(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + leb(n >> 7)


def units_of(text: str) -> list[int]:
    raw = text.encode("utf-16-be", "surrogatepass")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


def modified(text: str) -> bytes:
    out = bytearray()
    for u in units_of(text):
        if 0 < u < 0x80:
            out.append(u)
        elif u < 0x800:
            out += bytes([0xC0 | u >> 6, 0x80 | u & 63])
        else:
            out += bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 63, 0x80 | u & 63])
    return bytes(out)


def dex(strings, types, protos, fields, methods) -> bytes:
    sizes = (len(strings) * 4, len(types) * 4, len(protos) * 12, len(fields) * 8, len(methods) * 8)
    starts = [112]
    for s in sizes:
        starts.append(starts[-1] + s)
    data, at, lists, texts = b"", starts[-1], [], []
    for _, _, params in protos:
        lists.append(at + len(data) if params else 0)
        data += struct.pack("<I", len(params)) + b"".join(struct.pack("<H", p) for p in params)
    for t in strings:
        texts.append(at + len(data))
        data += leb(len(units_of(t))) + modified(t) + b"\0"
    pools = b"".join(struct.pack("<II", len(p), s) for p, s in zip((strings, types, protos, fields, methods), starts, strict=False))
    body = b"".join(struct.pack("<I", t) for t in texts) + b"".join(struct.pack("<I", t) for t in types)
    body += b"".join(struct.pack("<III", s, r, where) for (s, r, _), where in zip(protos, lists, strict=True))
    body += b"".join(struct.pack("<HHI", *f) for f in fields) + b"".join(struct.pack("<HHI", *m) for m in methods)
    return b"dex\n035\0".ljust(56, b"\0") + pools.ljust(56, b"\0") + body + data


def named(spark, *files: bytes) -> dict:
    frame = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "binary_id int, content binary")
    found = dex_names.dex_names(frame.withColumn("format", binaries.dispatch(frame.content)))
    return {(r.binary_id, r.kind, r.number): r["name"] for r in found.collect()}


def test_names(spark):
    strings = ["V", "Lmain/A;", "run", "[J", "x" * 20000, "nul\0 and 😀", "", "é" * 130, "\ud83d alone"]
    got = named(spark, dex(strings, [0, 1, 3, 99], [(0, 0, []), (0, 2, [2, 1, 3]), (0, 9, [])], [(1, 2, 2), (7, 3, 50)], [(1, 1, 2), (1, 8, 99)]))
    read = [t.replace("\ud83d", "�") if t.endswith("alone") else t for t in strings]
    assert [got[0, "string", i] for i in range(len(strings))] == read
    assert [got[0, "type", i] for i in range(4)] == ["V", "Lmain/A;", "[J", "<?>"]
    assert [got[0, "proto", i] for i in range(3)] == ["()V", "([JLmain/A;<?>)[J", "()<?>"]
    assert [got[0, "field", i] for i in range(2)] == ["Lmain/A;->run:[J", "<?>-><?>:<?>"]
    assert [got[0, "method", i] for i in range(2)] == ["Lmain/A;->run([JLmain/A;<?>)[J", "Lmain/A;-><?>()<?>"]


def test_broken_files(spark):
    whole = dex(["V", "run"], [0], [(0, 0, [])], [], [(0, 0, 1)])
    beyond = bytearray(whole)
    struct.pack_into("<I", beyond, 56, 1 << 30)  # more strings than the file can hold
    got = named(spark, whole[:130], b"dex\n035\0", bytes(beyond), dex([], [], [], [], []))
    assert {k[0] for k in got} <= {0, 2} and got[2, "method", 0] == "V->run()V"


def test_modified_utf8(spark):
    rng = random.Random(4)
    pool = ["a", "\0", "é", "߿", "ࠀ", "€", "￿", "😀", "𐀀", "\udbff", "\udc00"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(i, bytearray(modified(t)), len(units_of(t))) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, raw binary, n int").select("i", dex_names.mutf8(F.col("raw"), F.col("n")).alias("t")).collect()
    for r in got:
        # a lone surrogate is one U+FFFD; joined halves are a character, as in UTF-16
        assert r.t == clean(units_of(texts[r.i]))


def clean(units: list[int]) -> str:
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            out.append(chr(0x10000 + (u - 0xD800) * 1024 + units[i + 1] - 0xDC00))
            i += 2
            continue
        out.append("�" if 0xD800 <= u < 0xE000 else chr(u))
        i += 1
    return "".join(out)


def test_references(spark):
    names = spark.createDataFrame([("b", "method", 0, "A->f()V")], "binary_id string, kind string, number int, name string")
    refs = spark.createDataFrame([("b", "method", 0, 4), ("b", "type", 7, 8)], "binary_id string, kind string, number int, addr int")
    assert {(r.addr, r["name"]) for r in dex_names.resolved(refs, names).collect()} == {(4, "A->f()V"), (8, "type@7")}


def test_pools_are_read_for_many_files_at_once(spark):
    """No expression is interpreted for each entry, also of texts with other characters, and a broken number ends no job."""
    whole = dex(["V", "né\0😀"], [1], [], [], [])
    broken = bytearray(whole)
    struct.pack_into("<I", broken, 120, 0xFFFFFFFF)  # a type whose string lies above 2 ** 31
    assert named(spark, whole, bytes(broken)) == {(i, "string", j): t for i in range(2) for j, t in enumerate(["V", "né\0😀"])} | {(0, "type", 0): "né\0😀", (1, "type", 0): "<?>"}
    frame = spark.createDataFrame([(0, bytearray(whole), "dex")], "binary_id int, content binary, format string")
    text = dex_names.dex_names(frame)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "lambda" not in text

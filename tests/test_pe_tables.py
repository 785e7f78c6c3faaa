"""PE tables built byte by byte: chains that do not end, old delay tables, broken places, names that are no names."""

from __future__ import annotations

import struct

import pytest

from ferrule.sources import binaries, pe_tables

BASE = 0x400000


def pe(body: bytes, directories: dict[int, tuple[int, int]], symbols: bytes = b"", n_symbols: int = 0, wide: bool = False) -> bytes:
    """One section at 0x1000 that holds ``body``, and a symbol table behind it."""
    size = 240 if wide else 224
    dirs = b"".join(struct.pack("<II", *directories.get(i, (0, 0))) for i in range(16))
    if wide:
        option = struct.pack("<H14xI4xQ76xI", 0x20B, 0x1000, BASE, 16) + dirs
    else:
        option = struct.pack("<H14xI8xI60xI", 0x10B, 0x1000, BASE, 16) + dirs
    at = 0x400 + len(body) if symbols else 0
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664 if wide else 0x14C, 1, 0, at, n_symbols, size, 0)
    section = struct.pack("<8sIIII12xI", b".all", len(body), 0x1000, len(body), 0x400, 0x60000020)
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x80)
    return (head.ljust(0x80, b"\0") + coff + option + section).ljust(0x400, b"\0") + body + symbols


@pytest.fixture(scope="module")
def headers(spark):
    def made(*files: bytes):
        frame = spark.createDataFrame([(f"f{i}", bytearray(f)) for i, f in enumerate(files)], "path string, content binary")
        return binaries.pe_headers(binaries.with_identity(frame).withColumn("binary_id", frame.path))

    return made


def descriptor(lookup, name, slots):
    return struct.pack("<IIIII", lookup, 0, 0, name, slots)


@pytest.mark.parametrize("wide", [False, True])
def test_imports(headers, wide):
    step, top = (8, 1 << 63) if wide else (4, 1 << 31)
    pack = "<Q" if wide else "<I"
    table = descriptor(0x1100, 0x1180, 0x1140) + descriptor(0, 0x1190, 0x1160) + bytes(20) + b"\xff" * 40
    body = bytearray(table.ljust(0x100, b"\xee") + b"\xee" * 0x200)
    for at, values in ((0x100, (0x11A0, top | 7, 0)), (0x140, (1, 2, 0)), (0x160, (0x11C0, 0))):
        body[at : at + step * len(values)] = b"".join(struct.pack(pack, v) for v in values)
    body[0x180:0x190], body[0x190:0x1A0] = b"One.DLL\0" + b"x" * 8, b"two.dll\0" + b"y" * 8
    body[0x1A0:0x1B0], body[0x1C0:0x1D0] = b"\5\0first\0" + bytes(8), b"\0\0second\0" + bytes(7)
    found = {(r.dll, r.name, r.ordinal, int(r.slot), r.delayed) for r in pe_tables.pe_imports(headers(pe(bytes(body), {1: (0x1000, 60)}, wide=wide))).collect()}
    assert found == {("one.dll", "first", None, BASE + 0x1140, False), ("one.dll", None, 7, BASE + 0x1140 + step, False), ("two.dll", "second", None, BASE + 0x1160, False)}


def test_chains_that_do_not_end(headers):
    body = descriptor(0x1040, 0x1030, 0x1040) + descriptor(0x9000, 0x1030, 0x1040)  # no terminator: the file ends
    body = body.ljust(0x30, b"\x01")[:0x30] + b"lib.dll\0".ljust(16, b"\0") + struct.pack("<III", 0x1030, 0x1031, 0x1032)
    files = headers(pe(body, {1: (0x1000, 40)}), pe(b"", {1: (0x9000, 40)}), pe(bytes(64), {1: (0x1000, 40)}), pe(bytes(64), {}))
    found = sorted((r.binary_id, r.dll or "", r.n, r.ended) for r in pe_tables.import_chains(files).collect())
    mine = [f for f in found if f[0] == "f0"]
    assert ("f0", "", 3, False) in mine and ("f0", "lib.dll", 3, False) in mine
    # a table of nothing has ended; a directory that leads nowhere, or none, is no table
    assert [f for f in found if f[0] != "f0"] == [("f2", "", 0, True)]


def test_old_delay_tables_state_addresses(headers):
    body = bytearray(0x100)
    body[0:32] = struct.pack("<IIIIIIII", 0, BASE + 0x1080, 0, BASE + 0x1060, BASE + 0x1050, 0, 0, 0)
    body[0x50:0x58] = struct.pack("<II", 0x1090, 0)
    body[0x80:0x88], body[0x90:0x98] = b"old.dll\0", b"\0\0late\0\0"
    found = pe_tables.pe_imports(headers(pe(bytes(body), {13: (0x1000, 32)}))).collect()
    assert [(r.dll, r.name, int(r.slot), r.delayed) for r in found] == [("old.dll", "late", BASE + 0x1060, True)]


def test_exports_and_symbols(headers):
    body = bytearray(0x200)
    body[0:40] = struct.pack("<16xIIIIII", 10, 4, 3, 0x1060, 0x1070, 0x1080)
    body[40:50] = b"a.forward\0"
    body[0x60:0x70] = struct.pack("<IIII", 0x1100, 0x1000 + 40, 0x1110, 0)
    body[0x70:0x7C], body[0x80:0x86] = struct.pack("<III", 0x1090, 0x1098, 0x10A0), struct.pack("<HHH", 0, 0, 9)
    body[0x90:0x98], body[0x98:0xA0] = b"alias\0\0\0", b"caf\xe9\0\0\0\0"
    record = lambda name, value, section, kind, more=0: struct.pack("<8sIhHBB", name, value, section, kind, 2, more)
    symbols = record(b"first\0", 0x100, 1, 0x20, 1) + record(b"notme\0", 0x110, 1, 0x20, 200) + record(b"second\0", 0x100, 1, 0x20)
    symbols += record(b"\0\0\0\0\4\0\0\0", 0x120, 1, 0x20) + record(b"data\0", 0x130, 1, 0) + record(b"gone\0", 0x140, 0, 0x20) + record(b"far\0", 0x150, 9, 0x20)
    symbols += struct.pack("<I", 24) + b"a_name_of_length\0\0\0\0"
    files = headers(pe(bytes(body), {0: (0x1000, 50)}, symbols, 7))
    rows = pe_tables.pe_exports(files).collect()
    found = {(r.ordinal, r.name, r.address and int(r.address), r.forwarded) for r in rows}
    assert found == {(10, "alias", BASE + 0x1100, None), (10, "café", BASE + 0x1100, None), (11, None, None, "a.forward"), (12, None, BASE + 0x1110, None)}
    listed = [(r.place, r.name) for r in pe_tables.coff_symbols(files).orderBy("place").collect()]
    assert [n for _, n in listed] == ["first", "second", "a_name_of_length", "data", "gone", "far"]
    named = {int(r.address): r.name for r in pe_tables.pe_function_symbols(files).collect()}
    assert named == {BASE + 0x1000: pe_tables.ENTRY_POINT, BASE + 0x1100: "first", BASE + 0x1120: "a_name_of_length"}


def test_names_for_numbers(spark):
    imports = spark.createDataFrame([("b", "ws2_32.dll", None, 115), ("b", "ws2_32.dll", None, 9), ("b", "x.dll", "own", None)], "binary_id string, dll string, name string, ordinal long")
    names = spark.createDataFrame([("ws2_32.dll", 115, "WSAStartup")], "dll string, ordinal long, name string")
    assert {r.name for r in pe_tables.named_ordinals(imports, names).collect()} == {"WSAStartup", "#9", "own"}


def test_symbols_beyond_any_place(headers):
    """A header whose symbol table lies above 2 ** 31 has none; the other files of the batch are read."""
    whole = pe(bytes(64), {}, struct.pack("<8sIhHBB", b"own\0", 0x10, 1, 0x20, 2, 0) + struct.pack("<I", 4), 1)
    broken = bytearray(whole)
    struct.pack_into("<I", broken, 0x80 + 12, 0xF0000000)
    files = headers(bytes(broken), whole)
    assert [(r.binary_id, r.name) for r in pe_tables.coff_symbols(files).collect()] == [("f1", "own")]
    assert {(r.binary_id, int(r.address)) for r in pe_tables.pe_function_symbols(files).collect()} == {("f0", BASE + 0x1000), ("f1", BASE + 0x1000), ("f1", BASE + 0x1010)}


@pytest.mark.parametrize("reader", ["pe_imports", "import_chains", "pe_exports", "coff_symbols", "pe_function_symbols"])
def test_tables_are_read_for_many_files_at_once(headers, reader):
    """No expression is interpreted for each entry, and a file's sections are not parsed before and beside its reader."""
    text = getattr(pe_tables, reader)(headers(pe(bytes(64), {})))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "lambda" not in text

"""ELF symbol tables built byte by byte: aliases, reserved sections, larger entries, broken links and files that end early."""

from __future__ import annotations

import struct

import pytest

from ferrule.sources import binaries, elf_symbols


def elf(sections: list[tuple], order: str = "<", cut: int | None = None) -> bytes:
    """64-bit file of sections (type, bytes, addr, link, info, entry size) behind the empty first one."""
    at, body, heads = 64, b"", [bytes(64)]
    for kind, data, addr, link, info, step in sections:
        heads.append(struct.pack(order + "IIQQQQIIQQ", 0, kind, 0, addr, at + len(body), len(data), link, info, 1, step))
        body += data
    ident = b"\x7fELF" + bytes([2, 1 if order == "<" else 2, 1]) + bytes(9)
    head = ident + struct.pack(order + "HHIQQQIHHHHHH", 2, 62, 1, 0x1234, 0, 64 + len(body), 0, 64, 0, 0, 64, len(heads), 0)
    return (head + body + b"".join(heads))[:cut]


def symbol(name, value, info, section, order="<", more=0):
    return struct.pack(order + "IBBHQQ", name, info, 0, section, value, 4) + bytes(more)


@pytest.fixture(scope="module")
def files(spark):
    def made(*contents: bytes):
        frame = spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "binary_id string, content binary")
        return frame.withColumn("format", binaries.dispatch(frame.content))

    return made


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("more", [0, 8])
def test_aliases_and_reserved_sections(files, order, more):
    strings = b"\0first\0second\0tls\0common\0undef\0data\0"
    at = lambda s: strings.index(s.encode() + b"\0")
    rows = [(at("first"), 0x10, 0x12, 1), (at("second"), 0x10, 0x12, 1), (at("tls"), 0x20, 0x16, 1), (at("common"), 0x30, 0x12, 0xFFF2), (at("undef"), 0x40, 0x12, 0), (at("data"), 0x50, 0x11, 2), (0, 0x60, 0x12, 1), (999, 0x70, 0x12, 1)]
    table = bytes(24 + more) + b"".join(symbol(*r, order, more) for r in rows)
    frame = files(elf([(11, table, 0, 2, 0, 24 + more if more else 0), (3, strings, 0, 0, 0, 0)], order))
    listed = [(r.place, r.name) for r in elf_symbols.elf_symbols(frame).orderBy("place").collect()]
    assert listed == [(1, "first"), (2, "second"), (3, "tls"), (4, "common"), (5, "undef"), (6, "data"), (7, ""), (8, None)]
    exported = {int(r.address): r.name for r in elf_symbols.elf_exported_symbols(frame).collect()}
    assert exported == {0x10: "first", 0x50: "data"}
    functions = {int(r.address): r.name for r in elf_symbols.elf_function_symbols(frame).collect()}
    assert functions == {0x1234: "original_entry_point", 0x10: "second"}


def test_slots_and_stubs(files):
    strings = b"\0puts\0own\0"
    table = bytes(24) + symbol(1, 0x7777, 0x12, 0) + symbol(6, 0x10, 0x12, 1)
    rela = struct.pack("<QIIq", 0x3000, 7, 1, 0) + struct.pack("<QIIq", 0x3008, 7, 2, 0) + struct.pack("<QIIq", 0x3010, 7, 77, 0) + struct.pack("<QIIq", 0x3018, 8, 0, 5)
    stubs = b"\xff\x25" + struct.pack("<i", 0x3000 - 0x2006) + bytes(10) + b"\x0f\xff\x25".ljust(16, b"\x90") + b"\x2f\xf2\x5f".ljust(16, b"\0")
    names = b"\0.plt\0"
    content = bytearray(elf([(11, table, 0, 2, 0, 24), (3, strings, 0, 0, 0, 0), (4, rela, 0, 1, 0, 24), (1, stubs, 0x2000, 0, 0, 0), (3, names, 0, 0, 0, 0)]))
    heads = struct.unpack_from("<Q", content, 40)[0]
    struct.pack_into("<I", content, heads + 4 * 64, 1)  # the stubs' section has the first name
    struct.pack_into("<H", content, 62, 5)
    frame = files(bytes(content))
    relocations = elf_symbols.elf_relocations(frame)
    assert sorted((int(r.slot), r.symbol, r.name) for r in relocations.collect()) == [(0x3000, 1, "puts"), (0x3008, 2, "own"), (0x3010, 77, None), (0x3018, 0, None)]
    imports = elf_symbols.elf_imports(relocations)
    assert [(int(r.slot), r.version, r.name) for r in imports.collect()] == [(0x3000, None, "puts")]
    found = elf_symbols.linkage_stubs(frame)
    assert [int(r.stub) for r in found.orderBy("stub").collect()] == [0x2000, 0x2010]
    assert [(int(r.stub), r.name) for r in elf_symbols.named_stubs(found, imports).collect()] == [(0x2000, "puts")]


def test_broken_files(files):
    strings, table = b"\0a\0", bytes(24) + symbol(1, 0x10, 0x12, 1)
    whole = elf([(11, table, 0, 9, 0, 24), (3, strings, 0, 0, 0, 0)])  # a link to no section
    cut = elf([(11, table, 0, 2, 0, 24), (3, strings, 0, 0, 0, 0)], cut=100)
    frame = files(whole, cut, b"\x7fELF\2\1", b"MZ")
    assert [(r.binary_id, r.place, r.name) for r in elf_symbols.elf_symbols(frame).collect()] == [("f0", 1, None)]
    assert elf_symbols.elf_imports(elf_symbols.elf_relocations(frame)).collect() == []
    assert elf_symbols.linkage_stubs(frame).collect() == []


@pytest.mark.parametrize("reader", ["elf_symbols", "elf_function_symbols", "elf_exported_symbols", "elf_relocations", "linkage_stubs"])
def test_tables_are_read_for_many_files_at_once(files, reader):
    """No expression is interpreted for each entry."""
    text = getattr(elf_symbols, reader)(files(elf([])))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "lambda" not in text

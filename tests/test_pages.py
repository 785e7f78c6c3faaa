"""Painted extents, pages and reads against images that are built byte by byte."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from ferrule.sources import binaries, pages

FILES = "binary_id string, content binary"
BASE = 0x400000


def elf(segments, sections, data=b"", big=False):
    """A 64-bit file; segments (type, at, addr, file_size, size), sections (type, addr, at, size)."""
    o = ">" if big else "<"
    head = b"\x7fELF" + bytes([2, 2 if big else 1, 1]) + bytes(9)
    table = 64 + 56 * len(segments)
    head += struct.pack(o + "HHIQQQIHHHHHH", 2, 62, 1, 0, 64 if segments else 0, table, 0, 64, 56, len(segments), 64, len(sections), 0)
    for kind, at, addr, held, size in segments:
        head += struct.pack(o + "IIQQQQQQ", kind, 5, at, addr, addr, held, size, 4096)
    for kind, addr, at, size in sections:
        head += struct.pack(o + "IIQQQQIIQQ", 0, kind, 2, addr, at, size, 0, 0, 0, 0)
    return head + data


def elf_built(content, segments, sections):
    """What the file looks like in memory: (base, image), by painting one layer after the other."""
    placed = [s for s in sections if s[1]]
    loaded = [s for s in segments if s[2]]
    bogus = max((s[1] + s[3] for s in placed), default=0) >= 1 << 63
    bases = [s[2] for s in loaded] if bogus else [s[1] - s[2] for s in placed if s[1] >= s[2]]
    base = min(bases, default=0)
    shown = [] if max((s[1] + s[3] for s in placed), default=0) - base >= 1 << 63 else placed
    high = max([s[1] + s[3] for s in shown] + [s[2] + s[4] for s in loaded], default=0)
    if high <= base or high - base > pages.MOST:
        return base, b""
    image = bytearray(-(-(high - base) // pages.PAGE) * pages.PAGE)

    def put(at, chunk):
        if at >= 0:
            chunk = chunk[: max(0, len(image) - at)]
            image[at : at + len(chunk)] = chunk

    for _, at, addr, held, _ in sorted(loaded, key=lambda s: -s[3]):
        put(addr - base, content[at : at + held].ljust(held, b"\0"))
    for kind, addr, at, size in sorted(shown, key=lambda s: -s[3]):
        put(addr - base, (b"" if kind == 8 else content[at : at + size]).ljust(size, b"\0"))
    first = min([s[2] for s in shown] + [s[1] for s in loaded])
    put(0, content[:first])
    return base, bytes(image)


def images_of(layout, found):
    facts = {r.binary_id: r for r in layout.collect()}
    out = {k: bytearray(r["size"]) for k, r in facts.items()}
    for r in found.collect():
        assert len(r.bytes) == pages.PAGE and any(r.bytes) is not None
        part = out[r.binary_id][r.page * pages.PAGE : (r.page + 1) * pages.PAGE]
        assert not any(r.bytes[len(part) :])
        out[r.binary_id][r.page * pages.PAGE : (r.page + 1) * pages.PAGE] = r.bytes[: len(part)]
    return facts, {k: bytes(v) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, FILES).withColumn("format", binaries.dispatch(F.col("content")))


def test_paint_random_layers(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(25):
        span = rng.choice([40, 5000, 1 << 20])
        made = [(r, a := rng.randrange(span), a + rng.randrange(0, span // 2), rng.randrange(1000), rng.randrange(span // 2)) for r in range(rng.randrange(1, 30))]
        rows += [(k, *m) for m in made]
        bounds = sorted({x for m in made for x in m[1:3] if m[1] < m[2]})
        runs = []
        for a, b in zip(bounds, bounds[1:]):
            over = max((m for m in made if m[1] <= a < m[2]), default=None)
            if over and runs and runs[-1][3] == over[0] and runs[-1][1] == a:
                runs[-1][1] = b
            elif over:
                runs.append([a, b, over, over[0]])
        want[k] = [(a, b, m[3] + a - m[1], max(0, min(m[4] - (a - m[1]), b - a))) for a, b, m, _ in runs]
    rows.append((None, 1, 0, 10, 0, 10))
    df = spark.createDataFrame(rows, "binary_id long, rank long, start long, end long, file_at long, held long")
    got = {}
    for r in pages.paint(df).orderBy("binary_id", "start").collect():
        got.setdefault(r.binary_id, []).append((r.start, r.end, r.file_at, r.held))
    assert got == {k: v for k, v in want.items() if v}


def random_elf(rng):
    n = rng.randrange(200, 9000)
    segments = [(rng.choice([1, 2, 4]), rng.randrange(0, n), BASE + rng.randrange(0, 20000), h := rng.randrange(0, 6000), h + rng.randrange(0, 3000)) for _ in range(rng.randrange(0, 4))]
    sections = [(rng.choice([1, 1, 8]), rng.choice([0, BASE + rng.randrange(0, 20000)]), rng.randrange(0, n), rng.randrange(0, 5000)) for _ in range(rng.randrange(0, 7))]
    return segments, sections, rng.randbytes(n)


def test_random_elf_files(spark):
    rng = random.Random(9)
    made = {f"r{i}": random_elf(rng) for i in range(40)}
    made["bogus"] = ([(1, 100, BASE, 50, 5000)], [(1, (1 << 63) + (1 << 40), 0, 10)], bytes(range(200)))
    made["big image"] = ([(1, 100, BASE, 50, pages.MOST + 1)], [(1, BASE + 9, 9, 10)], b"x" * 300)
    made["no addresses"] = ([], [(1, 0, 0, 10)], b"")
    made["seam"] = ([(1, 100, BASE, 50, 5000)], [(1, (1 << 63) + 5, 0, 10)], b"")  # bogus from 0, not so from the base
    made["zeros only"] = ([], [(8, BASE, 0, 70000)], b"")
    rows = [(k, elf(*v, big=k.endswith("3"))) for k, v in made.items()]
    files = frame(spark, rows + rows[:2] + [(None, rows[0][1]), ("no file", None), ("other", b"MZ")]).repartition(3)
    layout, extents = pages.elf_image(files)
    facts, got = images_of(layout, pages.image_pages(files, extents))
    want = {k: elf_built(c, *made[k][:2]) for k, c in rows}
    assert {k: (int(r.base), got[k]) for k, r in facts.items()} == want
    assert facts["big image"].fault == facts["seam"].fault == "oversize" and facts["no addresses"].fault == "empty" and facts["bogus"].fault is None
    # zeros are no pages
    assert pages.image_pages(files, extents).where("binary_id = 'zeros only'").count() == 0

    asked = [(k, want[k][0] + at, n) for k in ("r1", "r5", "bogus", "zeros only") for at in (0, 60, 4090, len(want[k][1]) - 4, -3) for n in (1, 8, 4096, 4097)]
    df = spark.createDataFrame(asked + [("absent", 5, 1), (None, 5, 1)], "binary_id string, addr long, n int")
    for r in pages.read_pages(df, layout, pages.image_pages(files, extents)).collect():
        base, image = want.get(r.binary_id, (0, b""))
        inside = 0 <= r.addr - base and r.addr - base + r.n <= len(image) and r.n <= pages.PAGE
        assert r.read == (image[r.addr - base : r.addr - base + r.n] if inside else None), r


def pe(sections, data):
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, len(sections), 0, 0, 0, 240, 0)
    head += struct.pack("<H", 0x20B) + bytes(22) + struct.pack("<Q", BASE) + bytes(208)
    for vsize, rva, raw, at in sections:
        head += b".x".ljust(8, b"\0") + struct.pack("<IIII", vsize, rva, raw, at) + bytes(16)
    return head.ljust(0x400, b"\1") + data


def test_random_pe_files(spark):
    rng = random.Random(4)
    made = {}
    for i in range(25):
        sections = [(rng.randrange(0, 9000), rng.randrange(0, 30000), rng.randrange(0, 9000), rng.choice([0, 0x200, 0x400, 0x900, 20000])) for _ in range(rng.randrange(1, 5))]
        made[f"p{i}"] = (sections, pe(sections, rng.randbytes(rng.randrange(0, 9000))))
    made["large"] = ([(pages.MOST, 4096, 0, 0)], pe([(pages.MOST, 4096, 0, 0)], b""))
    made["none"] = ([], pe([], b""))
    files = frame(spark, [(k, c) for k, (_, c) in made.items()]).repartition(2)
    layout, extents = pages.pe_image(files)
    facts, got = images_of(layout, pages.image_pages(files, extents))
    for k, (sections, content) in made.items():
        size = max((s[1] + max(s[0], s[2]) for s in sections), default=0)
        if not size or size > pages.MOST:
            assert facts[k].fault == ("oversize" if size else "empty") and got[k] == b""
            continue
        image = bytearray(size)
        top = min([s[3] for s in sections if s[3] > 0x200] + [len(content), size])
        image[:top] = content[:top]
        for _, rva, raw, at in sections:
            chunk = content[at : at + raw]
            image[rva : rva + len(chunk)] = chunk
        assert got[k] == bytes(image), k


@pytest.mark.parametrize("image", [pages.elf_image, pages.pe_image])
def test_no_files(spark, image):
    files = frame(spark, [])
    layout, extents = image(files)
    assert layout.count() == extents.count() == pages.image_pages(files, extents).count() == 0


def test_no_growing_side_is_broadcast(spark):
    """Small in a file is not small in rows: no plan of a growing table may depend on what staged files weigh."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    files = frame(spark, [(f"r{i}", elf([(1, 100, BASE, 50, 5000)], [(1, BASE + 9, 9, 10)], bytes(200))) for i in range(3)])
    layout, extents = pages.elf_image(files)
    stored = pages.image_pages(files, extents)
    asked = layout.select("binary_id", (F.col("base") + 9).alias("addr"), F.lit(8).alias("n"))
    read = pages.read_pages(asked, layout, stored)
    for df in (extents, stored, read):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    assert read.where("read IS NOT NULL").count() == 3


def test_read_pages_deals_pages_by_their_number(spark, monkeypatch):
    """No task sorts more than a part of the pages, nor all pages of an image, however well they compress."""
    monkeypatch.setattr(pages, "PART", 4 * pages.PAGE)
    stored = spark.range(40).select((F.col("id") * 0).alias("binary_id"), F.col("id").alias("page"), F.unhex(F.lit("41" * pages.PAGE)).alias("bytes"))
    layout = spark.createDataFrame([(0, BASE, 41 * pages.PAGE, None)], "binary_id long, base long, size long, fault string")
    asked = spark.range(41).select((F.col("id") * 0).alias("binary_id"), (F.col("id") * pages.PAGE + BASE + 4090).alias("addr"), F.lit(9).alias("n"))
    read = pages.read_pages(asked, layout, stored)
    rows = {int(r.addr - BASE) // pages.PAGE: r for r in read.collect()}
    assert {k: None if r.read is None else bytes(r.read) for k, r in rows.items()} == {k: b"A" * 9 if k < 39 else b"A" * 6 + bytes(3) if k == 39 else None for k in range(41)}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 11), REPARTITION_BY_NUM") >= 4

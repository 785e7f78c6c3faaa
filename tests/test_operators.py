"""Operators on hand-made fixtures and against brute force."""

from __future__ import annotations

import json
import random
import struct

from pyspark.sql import functions as F

from ferrule.functions.sql import register
from ferrule.operators import candidates, graph, hashes, ranges, refs, scans, text
from ferrule.sources import binaries, reports, sinks
from ferrule.streaming import ingest


def test_merge_touching_nested_and_empty(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 12, 15), ("a", 30, 40), ("b", 5, 6)]
    got = ranges.merge_areas(spark.createDataFrame(rows, "k string, start long, end long"), ("k",)).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 20), ("a", 30, 40), ("b", 5, 6)]
    assert ranges.merge_areas(spark.createDataFrame([], "k string, start long, end long"), ("k",)).count() == 0


def test_range_and_overlap_joins_match_brute_force(spark):
    rng = random.Random(5)
    iv = [(i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.randrange(300) for _ in range(60))]
    pts = [(i, rng.randrange(320)) for i in range(80)]
    intervals, points = spark.createDataFrame(iv, "n long, start long, end long"), spark.createDataFrame(pts, "p long, at long")
    got = {(r.p, r.n) for r in ranges.range_join(points, intervals, "at", 16).collect()}
    assert got == {(p, n) for p, at in pts for n, s, e in iv if s <= at < e}
    side = lambda q: intervals.select(F.col("n").alias(q), F.col("start").alias(f"{q}_start"), F.col("end").alias(f"{q}_end"))
    pairs = [(r.l, r.r) for r in ranges.overlap_join(side("l"), side("r"), 16).collect()]
    want = {(a, b) for a, s, e in iv for b, t, f in iv if s < f and t < e and e > s and f > t}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_locate_with_and_without_parts(spark):
    points, blocks = spark.createDataFrame([(1, 5), (2, 99), (3, 0), (4, 10)], "p long, at long"), spark.createDataFrame([(10,), (3,)], "start long")
    for bucket in (None, 8):
        got = {r.p: r.located for r in ranges.locate(points, blocks, "at", "start", bucket=bucket).collect()}
        assert got == {1: 3, 2: 10, 3: None, 4: 10}


def test_scc_and_nesting_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        nodes = rng.randrange(3, 8)
        rows += list({(g, rng.randrange(nodes), rng.randrange(nodes)) for _ in range(nodes * 2)} | {(g, 0, 1)})
    edges = spark.createDataFrame(rows, "fn long, src long, dst long")
    got = {(r.fn, r.node): r.component for r in graph.scc(edges, "fn").collect()}
    deep = {r.fn: r.nesting_depth for r in graph.nesting(edges, edges.select("fn").distinct().withColumn("root", F.lit(0)), "fn").collect()}
    for g in range(40):
        e = {(a, b) for f, a, b in rows if f == g}
        nodes = {n for x in e for n in x}
        reach = {(n, n) for n in nodes}
        while more := {(a, d) for a, b in reach for c, d in e if b == c} - reach:
            reach |= more
        for n in nodes:
            assert got[g, n] == min(m for m in nodes if (n, m) in reach and (m, n) in reach)
        branched = {b for a, b in e if sum(x == a for x, _ in e) > 1}

        def without(cut, e=e):
            seen = set() if cut == 0 else {0}
            while new := {b for a, b in e if a in seen and b != cut} - seen:
                seen |= new
            return seen

        alive = without(None)
        assert deep[g] == max(sum(1 for d in alive if d in branched and v not in without(d)) for v in alive)


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert {(r.src, r.dst): r.depth for r in graph.closure(edges, 10).collect()}[1, 1] == 3


def test_scores_jump_at_ten_references(spark):
    got = spark.range(9, 12).select(candidates.call_score(F.col("id")).alias("s")).collect()
    assert [r.s for r in got] == [90, 110, 110]


def test_hash_is_little_endian(spark):
    import hashlib

    digest = hashlib.sha256(b"x").hexdigest()
    got = spark.sql(f"SELECT '{digest}' AS d").select(hashes.u64_of(F.col("d")).alias("u"), hashes.mask_hex(F.lit("aabbcc"), [1, 7]).alias("m")).first()
    assert int(got.u) == struct.unpack("<Q", hashlib.sha256(b"x").digest()[:8])[0] and got.m == "aa??cc"


def a64(*words: int) -> bytes:
    return struct.pack(f"<{len(words)}I", *words)


def test_word_scans(spark):
    image = a64(0xA9BF7BFD, 0x94000003, 0xD503201F, 0x97FFFFFF, 0xD503233F) + b"\0\0"
    words = binaries.words(spark.createDataFrame([("b", 0x1000, image)], "binary_id string, base long, image binary"), chunk=8)
    assert [(r.addr, r.word) for r in words.orderBy("addr").collect()][0] == (0x1000, 0xA9BF7BFD)
    assert {(r.src, r.dst) for r in scans.a64_calls(words).collect()} == {(0x1004, 0x1010), (0x100C, 0x1008)}
    assert {r.addr for r in scans.a64_prologues(words).collect()} == {0x1000, 0x1010}


def test_call_scan_across_chunks(spark):
    image = b"\x90" * 6 + b"\xe8" + struct.pack("<i", -5) + b"\x90" * 3 + b"\xe8" + struct.pack("<i", 1 << 20) + b"\xe8\0\0\0\0\x90"
    df = spark.createDataFrame([("b", 100, image)], "binary_id string, base long, image binary")
    for chunk in (4, 7, 1 << 14):
        assert [(r.src, r.dst) for r in scans.x86_calls(df, chunk).collect()] == [(106, 106)]


def pe_file() -> bytes:
    head = bytearray(0x400)
    head[:2], head[0x3C:0x40] = b"MZ", struct.pack("<I", 0x80)
    head[0x80:0x84] = b"PE\0\0"
    head[0x84:0x98] = struct.pack("<HHIIIHH", 0x14C, 2, 0, 0, 0, 0xE0, 0)
    head[0x98:0x9A], head[0xA8:0xAC], head[0xB4:0xB8] = struct.pack("<H", 0x10B), struct.pack("<I", 0x1010), struct.pack("<I", 0x400000)
    at = 0x98 + 0xE0
    for i, (name, rva, flags) in enumerate(((b".text", 0x1000, 0x60000020), (b".data", 0x2000, 0xC0000040))):
        head[at + 40 * i : at + 40 * i + 40] = name.ljust(8, b"\0") + struct.pack("<IIII12xI", 0x123, rva, 0x200, 0x400, flags)
    return bytes(head)


def test_binary_source_headers_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x_0x00400000.bin").write_bytes(pe_file())
    (tmp_path / "in/y.txt").write_bytes(b"text")
    (tmp_path / "in/z.bin").write_bytes(pe_file())
    files = binaries.read_binaries(spark, str(tmp_path / "in"))
    kinds = {r.path.rsplit("/", 1)[1]: (r.format, r.named_base) for r in files.collect()}
    assert kinds["x_0x00400000.bin"][0] == "pe" and int(kinds["x_0x00400000.bin"][1]) == 0x400000 and kinds["y.txt"] == (None, None)
    pe = binaries.pe_headers(files)
    row = pe.first()
    assert (row.bitness, row.image_base, row.entry_rva, [s.name for s in row.sections]) == (32, 0x400000, 0x1010, [".text", ".data"])
    assert {(r.start, r.end) for r in binaries.pe_code_areas(pe).collect()} == {(0x401000, 0x402000)}
    for _ in range(2):
        ingest.ingest(ingest.binary_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2  # equal contents are one binary


def test_report_source(spark, tmp_path):
    fn = {"offset": 16, "blocks": {"16": [[16, "e8", "call", "0x20"], [21, "c3", "ret", ""]]}, "apirefs": {"16": "k.dll!f"}, "outrefs": {"16": [32]}}
    other = {"offset": 32, "blocks": {"32": [[32, "c3", "ret", ""]]}, "outrefs": {}}
    doc = {"architecture": "intel", "sha256": "s", "timestamp": "2024-01-02T03-04-05", "xcfg": {"16": fn, "32": other}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    read = reports.read_reports(spark, str(tmp_path))
    functions = reports.functions_of(read)
    code = reports.instructions_of(functions)
    stats = reports.statistics(code, reports.code_refs_of(functions), reports.api_refs_of(functions)).first()
    assert (stats.num_functions, stats.num_instructions, stats.num_function_calls, stats.num_api_calls, stats.binweight) == (2, 3, 1, 1, 3)
    assert str(read.first().analysed_at) == "2024-01-02 03:04:05"
    assert sinks.documents(code, "fn", F.struct("addr", "mnemonic"), "code").count() == 2


def test_text_and_refs(spark):
    row = spark.sql("SELECT 'ab' AS a").select(text.language_score({"x": F.lit(1), "y": F.lit(1), "z": F.lit(0)}).alias("l"), refs.base_mnemonic(F.lit("rep movsd")).alias("m"))
    assert tuple(row.first()) == ("y", "movsd")
    register(spark)
    assert tuple(spark.sql("SELECT align_up(17, 16), align_down(17, 16), hex_value('[0x1F]')").first()) == (32, 16, 31)
    own = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "fn long, start long, addr long")
    out = refs.outgoing(spark.createDataFrame([(1, 1), (1, 2), (1, 9)], "fn long, dst long"), own, "fn")
    assert {r.dst for r in out.collect()} == {1, 9}


def test_windowed_counts(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:01' + make_interval(0,0,0,0,id) AS ts, 'a' AS k FROM range(3)")
    assert [r.n for r in ingest.windowed_counts(events, "ts", "k", "1 hour", "10 minutes").collect()] == [1, 1, 1]

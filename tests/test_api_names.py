"""Names of exports in dumps: the database's documents, words of pages, and libraries that have moved."""

from __future__ import annotations

import json
import random
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ferrule.operators import api_names
from ferrule.sources.pages import PAGE


def document(libraries):
    return json.dumps({"os_name": "x", "dlls": {e: {"base_address": b, "bitness": 64, "exports": [{"name": n, "ordinal": o, "address": a} for n, o, a in x]} for e, (b, x) in libraries.items()}})


FIRST = {"1_64_a.dll": (0x7FF810000000, [("one", 1, 16), (None, 2, 32)]), "1_64_b_c.dll": (0x7FF80FFFFFF0, [("last", 3, 32), ("two", 4, 64)])}
SECOND = {"2_64_a.dll": (0x7FF810000000, [("other", 1, 16), ("more", 2, 48)]), "odd": (1 << 63, [("top", 1, 1 << 40)])}


def exports(spark):
    docs = spark.createDataFrame([(1, document(FIRST)), (2, document(SECOND)), (3, None), (4, "no json")], "os int, content string")
    return api_names.named_exports(api_names.database_exports(docs))


def test_database(spark):
    got = {(r.os, int(r.address), r.dll, r.api) for r in exports(spark).collect()}
    # two exports of the first system share an address: the last one listed counts
    want = {(1, 0x7FF810000010, "b_c.dll", "last"), (1, 0x7FF810000020, "a.dll", "None<2>"), (1, 0x7FF810000030, "b_c.dll", "two")}
    want |= {(2, 0x7FF810000010, "a.dll", "other"), (2, 0x7FF810000030, "a.dll", "more"), (2, (1 << 63) + (1 << 40), "", "top")}
    assert got == want


def test_words_and_first_system(spark):
    image = struct.pack("<8Q", 0x7FF810000010, 5, 0xFFFF, 0x10000, (1 << 63) + (1 << 40), 0x7FF810000030, 0x7FF810000031, 0).ljust(PAGE, b"\0")
    pages = spark.createDataFrame([("d", 2, image), (None, 0, image), ("x", 0, image)], "binary_id string, page long, bytes binary")
    layout = spark.createDataFrame([("d", 0x1000, 9 * PAGE, None), ("x", 0, 0, "oversize")], "binary_id string, base long, size long, fault string")
    words = api_names.page_words(pages, layout, 8)
    at = 0x1000 + 2 * PAGE
    assert {(r.binary_id, int(r.addr) - at, int(r.word)) for r in words.collect()} == {("d", 8 * i, w) for i, w in enumerate(struct.unpack("<8Q", image[:64])) if w >= 0x10000}
    assert {int(r.word) for r in api_names.page_words(pages, layout, 4).collect()} == {w for w in struct.unpack("<16I", image[:64]) if w >= 0x10000}
    got = {(int(r.addr) - at, r.dll, r.api) for r in api_names.resolve_apis(words, exports(spark)).collect()}
    assert got == {(0, "b_c.dll", "last"), (32, "", "top"), (40, "b_c.dll", "two")}


def test_moved_libraries(spark):
    rng = random.Random(5)
    known = {f"0_0_l{k}": (0x10000000 * (k + 1), [(f"f{k}.{i}", i, i * 0x1230 + k) for i in range(300)]) for k in range(5)}
    docs = spark.createDataFrame([(1, document(known))], "os int, content string")
    rows, want = [], set()
    for d in range(20):
        for k in range(5):
            shift = rng.randrange(-500, 500) * 0x10000
            used = rng.sample(range(300), rng.choice([0, 3, 40]))
            for i in used:
                rows.append((f"d{d}", len(rows), 0x10000000 * (k + 1) + i * 0x1230 + k + shift))
                want.add((f"d{d}", len(rows) - 1, f"l{k}", f"f{k}.{i}"))
        rows += [(f"d{d}", len(rows), rng.randrange(1 << 32)) for _ in range(50)]
    rows += rows[:3] + [(None, 0, 0x10000000), ("d0", None, None), ("d1", -1, 0)]
    words = spark.createDataFrame(rows, "binary_id string, addr long, word long")
    found = api_names.resolve_shifted(words, api_names.named_exports(api_names.database_exports(docs)), 3)
    assert {(r.binary_id, r.addr, r.dll, r.api) for r in found.collect()} == want
    assert api_names.resolve_shifted(words.limit(0), exports(spark)).count() == 0


def test_pages_are_cut_many_at_once(spark):
    """No page is spelled out in hex digits; bytes behind the last whole word are none."""
    pages = spark.createDataFrame([("d", 0, struct.pack("<Q", 1 << 63) + b"\xff" * 7), ("e", 0, b""), ("f", 1, struct.pack("<Q", 1 << 20))], "binary_id string, page long, bytes binary")
    layout = spark.createDataFrame([(b, 0, PAGE, None) for b in "def"], "binary_id string, base long, size long, fault string")
    words = api_names.page_words(pages, layout, 8)
    assert {(r.binary_id, int(r.addr), int(r.word)) for r in words.collect()} == {("d", 0, 1 << 63), ("f", PAGE, 1 << 20)}
    text = words._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "hex(" not in text


def best_shifts(words, exports, least):
    """{(dump, os, dll): (shift, votes)} by trying every pair."""
    votes = {}
    for dump, word in set(words):
        for os, dll, address in set(exports):
            if (word - address) % 65536 == 0:
                votes.setdefault((dump, os, dll), {}).setdefault((word - address) // 65536, []).append(address)
    best = {}
    for key, of in votes.items():
        n, _, shift = min((-len(v), (abs(s), s), s) for s, v in of.items())
        if -n >= least:
            best[key] = (shift, -n)
    return best


def voted(words, exports, least, resolve, size):
    rows = [(None, None, o, d, a % 65536, a // 65536) for o, d, a in exports] + [(b, w, None, None, w % 65536, w // 65536) for b, w in sorted(words)]
    kinds = pa.schema([("binary_id", pa.string()), ("word", pa.decimal128(20, 0)), ("_os", pa.int32()), ("_dll", pa.string()), ("_low", pa.int32()), ("_high", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[i : i + size]], kinds) for i in range(0, len(rows), size)]
    return [r for b in api_names._dumps("string", ["binary_id", "word"], least, resolve)(iter(batches)) for r in b.to_pylist()]


def test_votes_in_slices_of_any_size(monkeypatch):
    """Many exports share their lower bits; libraries may lie all over the address space, dumps may span slices."""
    rng = random.Random(4)
    for turn in range(40):
        far = rng.choice([1, 30, 1 << 20, (1 << 47) - 1])
        exports = [(o, f"l{k}", 65536 * (rng.randrange(1, 60) + (far if rng.random() < 0.2 else 0)) + rng.choice([0, 16])) for o in (1, 2) for k in range(3) for _ in range(rng.randrange(1, 30))]
        words = [(f"d{d}", 65536 * (rng.randrange(1, 90) + rng.choice([0, 0, far])) + rng.choice([0, 16, 32])) for d in range(12) for _ in range(rng.choice([1, 2, 5, 60]))]
        monkeypatch.setattr(api_names, "PAIRS", rng.choice([1, 50, 1 << 20]))
        monkeypatch.setattr(api_names, "ROWS", rng.choice([1, 40, 1 << 16]))
        least, size = rng.choice([1, 2, 3]), rng.choice([7, 100, 10000])
        want = best_shifts(words, exports, least)
        assert {(r["binary_id"], r["_os"], r["_dll"]): (r["_shift"], r["_n"]) for r in voted(words, exports, least, False, size)} == want
        met = sorted((b, w, o, d) for b, w in words for o, d in {e[:2] for e in exports} if (b, o, d) in want and (o, d, w - 65536 * want[b, o, d][0]) in set(exports))
        assert sorted((r["binary_id"], int(r["word"]), r["_os"], r["_dll"]) for r in voted(words, exports, least, True, size)) == met


def test_pairs_of_words_and_exports_are_no_rows(spark, monkeypatch):
    """A thousand words that each meet a thousand exports make no million of rows to shuffle, whatever the exports' number."""
    exports = spark.range(1000).selectExpr("1 AS os", "'l' AS dll", "CAST(id AS string) AS api", "CAST(id * id * 65536 AS decimal(20,0)) AS address")
    words = spark.range(1000).selectExpr("id % 2 AS binary_id", "id AS addr", "CAST((id * id + 7) * 65536 AS decimal(20,0)) AS word")
    found = api_names.library_shifts(words, exports)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.binary_id, r.os, r.dll, int(r["shift"]), r.n_apis) for r in found.collect()} == {(0, 1, "l", 7 * 65536, 500), (1, 1, "l", 7 * 65536, 500)}
    monkeypatch.setattr(api_names, "EXPORTS", 500)  # libraries are dealt too
    got = api_names.resolve_shifted(words, exports.unionByName(exports.withColumn("dll", F.lit("m"))))
    assert sorted((r.addr, r.dll, r.api) for r in got.collect()) == sorted((i, d, str(i)) for i in range(1000) for d in "lm")

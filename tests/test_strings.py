"""Strings of functions against images held whole in Python."""

from __future__ import annotations

import random
import re
import struct
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F

from ferrule.operators import strings
from ferrule.sources.pages import PAGE

BASE = 0x400000
PRINTABLE = re.compile(rb"[\x09-\x0d\x20-\x7e]*")


def text_at(image, at, most=None):
    if not 0 <= at < len(image):
        return None
    n = PRINTABLE.match(image, at, len(image) if most is None else min(len(image), at + most)).end() - at
    ends = at + n < len(image) and image[at + n] == 0
    return image[at : at + n].decode() if n and (ends or (most is not None and n >= most)) else None


def chain_from(image, addr):
    chain = []
    while BASE <= addr < BASE + len(image) and addr not in chain and len(chain) < 11:
        chain.append(addr)
        read = image[addr - BASE : addr - BASE + 4]
        if len(read) < 4:
            break
        addr = int.from_bytes(read, "little")
    return chain


def random_image(rng):
    """Text with pointers, zeros and long runs strewn over it; the size need not end a page."""
    image = bytearray(rng.choice(b"ab \t~") if rng.random() < 0.9995 else 1 for _ in range(rng.randrange(1, 5 * PAGE)))
    for _ in range(rng.randrange(0, 8)):
        at = rng.randrange(len(image))
        image[at : at + rng.randrange(1, 40)] = bytes(min(len(image) - at, 3))
    for _ in range(rng.randrange(0, 60)):
        if len(image) > 8:
            at = rng.randrange(len(image) - 8)
            image[at : at + 4] = struct.pack("<I", BASE + rng.randrange(len(image) + 9))
    if rng.random() < 0.5:
        image[-1] = 0
    if len(image) > 3 * PAGE and rng.random() < 0.5:
        image[PAGE : 2 * PAGE] = bytes(PAGE)
    return bytes(image)


def tables(spark, images):
    layout = spark.createDataFrame([(k, BASE, len(v), None) for k, v in images.items()] + [("broken", BASE, 0, "oversize")], "binary_id string, base long, size long, fault string")
    pages = [(k, i // PAGE, v[i : i + PAGE].ljust(PAGE, b"\0")) for k, v in images.items() for i in range(0, len(v), PAGE) if any(v[i : i + PAGE])]
    return layout.withColumn("base", F.col("base").cast("decimal(20,0)")), spark.createDataFrame(pages, "binary_id string, page long, bytes binary")


def test_texts_of_any_length(spark):
    rng = random.Random(3)
    images = {f"i{i}": random_image(rng) for i in range(30)}
    images["long"] = b"x" * (3 * PAGE) + b"\0"
    images["to the seam"] = b"x" * PAGE + bytes(PAGE)
    images["no end"] = b"x" * (2 * PAGE)
    images["short"] = b"abc"
    asked = [(k, BASE + at, most) for k, v in images.items() for at in [0, PAGE - 1, PAGE, len(v) - 1, len(v), -1, *(rng.randrange(len(v)) for _ in range(20))] for most in (None, 0, 1, rng.randrange(1, 3 * PAGE), 10**18)]
    layout, pages = tables(spark, images)
    df = spark.createDataFrame(asked + asked[:50] + [(None, BASE, None), ("absent", BASE, None), ("broken", BASE, 1)], "binary_id string, addr long, most long")
    got = strings.read_texts(df, layout, pages.repartition(3)).collect()
    want = {(k, a, m): t for k, a, m in asked if (t := text_at(images[k], a - BASE, m)) is not None}
    assert len(got) == len(want)
    assert {(r.binary_id, int(r.addr), None if r.most is None else int(r.most)): r.text for r in got} == want
    assert any(len(t) > 2 * PAGE for t in want.values())


def test_strings_of_functions(spark):
    rng = random.Random(8)
    images = {f"i{i}": random_image(rng) for i in range(20)}
    # twenty pointers in a row, of which a chain takes eleven, and two that lead to each other
    images["chain"] = b"".join(struct.pack("<I", BASE + 4 * i + 4) for i in range(20)) + b"end\0" + struct.pack("<II", BASE + 88, BASE + 84)
    refs = [(k, f"f{j % 3}", j, BASE + rng.randrange(-2, len(v) + 2)) for k, v in images.items() for j in range(40)]
    refs += [("chain", "g", j, BASE + 4 * j) for j in range(24)]
    layout, pages = tables(spark, images)
    df = spark.createDataFrame(refs + refs[:9] + [(None, "f", 1, BASE), ("chain", "f", 1, None), ("broken", "f", 1, BASE)], "binary_id string, fn string, src long, dst long")
    got = strings.function_strings(df, layout, pages).collect()
    want = {(k, f, s, v, t) for k, f, s, d in refs for v in chain_from(images[k], d) if (t := text_at(images[k], v - BASE)) is not None}
    assert {(r.binary_id, r.fn, r.src, int(r.addr), r.text) for r in got} == want and len(got) == len(want)
    assert {r.src for r in got if r.fn == "g" and r.text == "end"} == set(range(10, 21))


def go_wanted(image, code, refs, word):
    found = set()
    for fn in {c[0] for c in code}:
        rows = sorted(c for c in code if c[0] == fn)
        for i, (_, addr, _, _) in enumerate(rows):
            to = {d for s, d in refs if s == addr}
            if len(to) != 1:
                continue
            ref = to.pop()
            text = None
            if i + 2 < len(rows) and rows[i + 1][2] == rows[i + 2][2] == "mov":
                parts = rows[i + 2][3].split(",")
                if len(parts) == 2 and re.fullmatch(r"\s*\d+\s*", parts[1]) and int(parts[1]) > 0:
                    text = text_at(image, ref - BASE, int(parts[1]))
            pair = image[ref - BASE : ref - BASE + 2 * word] if ref >= BASE else b""
            if text is None and len(pair) == 2 * word:
                text = text_at(image, int.from_bytes(pair[:word], "little") - BASE, int.from_bytes(pair[word:], "little"))
            if text is not None:
                found.add((fn, addr, ref, text))
    return found


def test_go_strings_of_functions(spark):
    rng = random.Random(6)
    images, code, refs = {}, [], []
    for k in range(16):
        word = 8 if k % 2 else 4
        blob = bytes(rng.choice(b"abc") for _ in range(2 * PAGE)) + bytes(3) + bytes(rng.choice(b"xyz") for _ in range(500))
        pairs = b"".join(
            (BASE + rng.randrange(40 * 16, 40 * 16 + len(blob))).to_bytes(word, "little") + rng.choice([0, 1, 9, 300, 5000, (1 << 8 * word) - 1]).to_bytes(word, "little") for _ in range(40)
        ).ljust(40 * 16, b"\1")
        images[f"g{k}"] = pairs + blob
        for i in range(80):
            mnemonic = rng.choice(["lea", "mov", "mov", "mov"])
            operands = rng.choice(["rbx, 5", "rbx,12", "rax, 0x1f", "rax", "rax, 0", "rcx, 4000", "rcx, rdx"])
            code.append((f"g{k}", f"f{i // 30}", i, mnemonic, operands, word))
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                refs.append((f"g{k}", i, BASE + (rng.randrange(40) * 2 * word if rng.random() < 0.6 else rng.randrange(len(images[f"g{k}"]) + 20))))
    layout, pages = tables(spark, images)
    df = spark.createDataFrame(code, "binary_id string, fn string, addr long, mnemonic string, operands string, word int")
    to = spark.createDataFrame(refs + refs[:20], "binary_id string, src long, dst long")
    got = strings.go_function_strings(df, to, layout, pages, F.col("word")).collect()
    want = set()
    for k, image in images.items():
        found = go_wanted(image, [c[1:5] for c in code if c[0] == k], [r[1:] for r in refs if r[0] == k], 8 if int(k[1:]) % 2 else 4)
        want |= {(k, *w) for w in found}
    assert {(r.binary_id, r.fn, r.src, int(r.addr), r.text) for r in got} == want and len(got) == len(want) > 200


def test_no_references(spark):
    layout, pages = tables(spark, {"i": b"text\0"})
    none = spark.createDataFrame([], "binary_id string, fn string, src long, dst long")
    code = spark.createDataFrame([], "binary_id string, fn string, addr long, mnemonic string, operands string")
    assert strings.function_strings(none, layout, pages).count() == 0
    assert strings.go_function_strings(code, none, layout, pages, F.lit(8)).count() == 0


def test_texts_in_slices_of_any_size(monkeypatch):
    """Images of a part come as a stream, also above pointers and with sizes that no two of them could share."""
    rng = random.Random(9)
    kinds = [("binary_id", pa.string()), ("_kind", pa.int32()), ("_base", pa.decimal128(20, 0)), ("_size", pa.int64()), ("_page", pa.int64()), ("_bytes", pa.binary())]
    kinds = pa.schema([*kinds, ("fn", pa.string()), ("src", pa.int64()), ("_start", pa.decimal128(20, 0))])
    for turn in range(25):
        images = {f"i{i:02}": random_image(rng) for i in range(12)}
        bases = {k: rng.choice([BASE, BASE, (1 << 63) + BASE]) for k in images}
        huge, rows, want = turn % 5 == 0, [], set()
        for k, v in images.items():
            size = len(v) if k != "i03" or not huge else 1 << 61
            pages = [(i // PAGE, v[i : i + PAGE].ljust(PAGE, b"\0")) for i in range(0, len(v), PAGE) if any(v[i : i + PAGE])]
            named = [(f"f{j % 3}", j // 2, bases[k] + rng.randrange(-2, len(v) + 2)) for j in range(rng.choice([0, 3, 60]))]
            if rng.random() < 0.9:
                rows.append((k, 0, Decimal(bases[k]), size))
                if size == len(v):
                    for f, s, d in named:
                        chain = chain_from(v, d) if bases[k] == BASE else [d] if 0 <= d - bases[k] < len(v) else []
                        want |= {(k, f, s, a, t) for a in chain if (t := text_at(v, a - bases[k])) is not None}
            rows += [(k, 1, None, None, *p) for p in pages]
            rows += [(k, 2, None, None, None, None, f, s, Decimal(d)) for f, s, d in named + named[:2]]
        monkeypatch.setattr(strings, "ROWS", rng.choice([1, 50, 1 << 16]))
        monkeypatch.setattr(strings, "SLICE", rng.choice([1, 5000, 4 << 20]))
        monkeypatch.setattr(strings, "USERS", rng.choice([1, 4, 1 << 10]))
        step = rng.choice([5, 70, 10000])
        batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[i : i + step]], kinds) for i in range(0, len(rows), step)]
        found = [r for b in strings._read_images(iter(batches)) for r in b.to_pylist()]
        got = [(r["binary_id"], u["fn"], u["src"], int(r["_base"]) + r["_at"], r["text"]) for r in found for u in r["_users"]]
        got = [g for g in got if not huge or g[0] != "i03"]
        assert set(got) == {w for w in want} and len(got) == len(want)


def test_texts_are_moved_once(spark):
    """Pages and references are dealt once, no join carries a text, and what is made of a text is made once for all that use it."""
    layout, pages = tables(spark, {"i": b"x" * 9000 + b"\0"})
    refs = spark.range(5000).selectExpr("'i' AS binary_id", "id % 7 AS fn", "id AS src", f"{BASE} + id % 2 AS dst")
    found = strings.function_strings(refs, layout, pages, n=F.length("text"), digest=F.md5(F.col("text").cast("binary")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("md5(cast(text")
    got = found.collect()
    assert {(r.fn, r.src, int(r.addr) - BASE, r.n) for r in got} == {(i % 7, i, i % 2, 9000 - i % 2) for i in range(5000)} and len(got) == 5000

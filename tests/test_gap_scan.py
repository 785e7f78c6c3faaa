"""The scan of gaps between x86 functions against a walk over the bytes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ferrule.operators import scans

BASE = 0x10000


def nop_length(code, at, wide):
    """Length of the NOP instruction at a place, or 0."""
    i = at
    while i - at < 12 and code[i : i + 1] and code[i] in (0x66, 0x2E, 0x26, 0x36, 0x3E, 0x64, 0x65):
        i += 1
    if i > at and set(code[at:i]) == {0x66} and code[i : i + 1] == b"\x90":
        return i + 1 - at
    if wide and code[i : i + 1] and code[i] >> 4 == 4:
        i += 1
    if code[i : i + 2] != b"\x0f\x1f" or i + 2 >= len(code):
        return 0
    mode, rm = code[i + 2] >> 6, code[i + 2] & 7
    end = i + 3
    if mode < 3:
        if rm == 4:
            if end >= len(code):
                return 0
            end += 1 + (4 if mode == 0 and code[end] & 7 == 5 else 0)
        end += {0: 4 if rm == 5 else 0, 1: 1, 2: 4}[mode]
    return end - at if end <= len(code) else 0


def first_start(code, size, wide):
    at = 0
    idle = sorted(map(bytes.fromhex, scans.X86_IDLE), key=len, reverse=True)
    while at < size:
        if code[at] in (0, 0x90, 0xCC, 0xF4):
            at += 1
        elif n := nop_length(code, at, wide):
            at += n
        elif not wide and code[at : at + 5].hex().upper() in scans.X86_PATCH_PLACES:
            return at
        elif n := next((len(x) for x in idle if code.startswith(x, at)), 0):
            at += n
        else:
            return at
    return None


def test_random_gaps(spark):
    rng = random.Random(2)
    rows, gaps, want = [], [], set()
    for k in range(300):
        made = b""
        for _ in range(rng.randrange(0, 30)):
            made += rng.choice(
                [
                    bytes.fromhex(rng.choice(scans.X86_IDLE)),
                    bytes([rng.choice([0, 0x90, 0xCC, 0xF4])]) * rng.randrange(1, 9),
                    b"\x66" * rng.randrange(0, 7) + rng.choice([b"", b"\x2e", b"\x48"]) + b"\x0f\x1f" + bytes([rng.randrange(256)]) + bytes(rng.randrange(0, 6)),
                    b"\x66" * rng.randrange(1, 5) + b"\x90",
                ]
            )
        made += rng.choice([b"", b"\x8b\xff\x55\x8b\xec", b"\x89\xff\x55\x8b\xec", rng.randbytes(5)]) + bytes(rng.randrange(0, 4))
        made = made or b"\x55"
        size = rng.randrange(1, len(made) + 1)
        wide = k % 2 == 1
        rows.append((k, BASE, made, 64 if wide else 32))
        gaps.append((k, BASE, BASE + size))
        # what is behind the gap may end an instruction, up to 14 bytes
        found = first_start(made[: size + 14], size, wide)
        if found is not None:
            want.add((k, BASE + found))
    rows += [(1000, BASE, bytes.fromhex("660f1f440000") * 200000 + b"\x55", 64), (1001, BASE, bytes(100), None), (1002, BASE, b"\x55", 32)]
    gaps += [(1000, BASE, BASE + 1200001), (1001, BASE, BASE + 100), (1002, BASE + 1, BASE + 5), (1002, BASE - 4, BASE), (None, BASE, BASE + 1)]
    want.add((1000, BASE + 1200000))
    images = spark.createDataFrame(rows, "binary_id long, base long, image binary, bits int")
    df = spark.createDataFrame(gaps, "binary_id long, gap_start long, gap_end long")
    got = scans.gap_starts(images, df, F.col("bits")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100

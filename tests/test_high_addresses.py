"""Addresses of 16 hexadecimal digits, as kernels have them, in escapes and references."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ferrule.operators import escapes, refs

KERNEL = 0xFFFFF80000000000


def bounds():
    return [F.lit(str(v)).cast("decimal(20,0)") for v in (KERNEL, KERNEL + 0x100000)]


@pytest.mark.parametrize(
    ("code", "operands", "want"),
    [
        ("48b8785634120080f8ff", "rax, 0xfff8800012345678", "48b8785634120080f8ff"),  # beyond the image
        ("48b878560000" + "00f8ffff", "rax, 0xfffff80000005678", "48b8" + "?" * 16),
        ("48a1785600" + "0000f8ffff", "rax, qword ptr [0xfffff80000005678]", "48a1" + "?" * 16),
        ("8b0578563412", "eax, dword ptr [0x12345678]", "8b05????????"),
        ("8b05f0ffffff", "eax, dword ptr [rip - 0x10]", "8b05????????"),
        ("b878560000", "eax, 0x5678", "b878560000"),
    ],
)
def test_escapes(spark, code, operands, want):
    row = spark.createDataFrame([(code, operands)], "code string, operands string")
    low, high = bounds()
    assert row.select(escapes.x86_binary(F.col("code"), F.lit("mov"), F.col("operands"), low, high)).first()[0] == want


def test_references(spark):
    rows = [("k", 1, "mov", "rax, 0xfffff80000005678"), ("k", 2, "mov", "rax, 0xfffff80000100000"), ("k", 3, "call", "0xfffff80000005678"), ("k", 4, "lea", "rax, [0xFFFFF80000000000]")]
    code = spark.createDataFrame(rows, "binary_id string, addr long, mnemonic string, operands string")
    found = refs.data_refs(code, bounds()[0], F.lit(0x100000))
    assert {(r.src, int(r.dst)) for r in found.collect()} == {(1, KERNEL + 0x5678), (4, KERNEL)}
    low = refs.data_refs(code, F.lit(0x400000), F.lit(0x1000))
    assert low.schema["dst"].dataType.typeName() == "long" and low.count() == 0

"""Queries on strings of functions: files with pointers and texts of many pages, code whose operands name their addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.operators import refs, strings
from ferrule.plans.image_queries import _files, _parts, joined, le, zeros
from ferrule.plans.registry import query, table
from ferrule.session import staged
from ferrule.sources import pages

#: Where the built files keep their data: no byte of a pointer to its first 32 bytes begins a text.
BASE, DATA = 0x400000, 0x200
AT = BASE + DATA + 0xE00  # its address: a page further on


def _image(spark, sf_dir: str, data: Column):
    """Layout and pages of ELF files with one section, whose bytes are ``data`` over a part's columns."""
    n = F.octet_length(data)
    head = F.concat(F.lit("7F454C46020101"), zeros(9), le(2, 2), le(62, 2), le(1, 4), le(BASE, 8), le(64, 8), le(64, 8), le(0, 4), le(64, 2), le(56, 2), le(0, 2), le(64, 2), le(1, 2), le(0, 2))
    section = F.concat(le(0, 4), le(1, 4), le(2, 8), le(AT, 8), le(DATA, 8), le(n, 8), zeros(24))
    files = _files(_parts(spark, sf_dir), "p_partkey", F.concat(joined(head, section, F.lit("00" * (DATA - 128))), data))
    layout, extents = pages.elf_image(files)
    return layout, staged(pages.image_pages(files, extents), "pages")


def _code(spark, sf_dir: str, *lines: tuple[str, Column]):
    """The same instructions (mnemonic, operands) for each order, in the binary numbered like its customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("binary_id"), F.col("o_orderkey").alias("fn"), "o_orderkey")
    rows = F.array(*[F.struct(F.lit(m).alias("mnemonic"), o.alias("operands")) for m, o in lines])
    code = orders.select("binary_id", "fn", F.posexplode(rows).alias("i", "r"))
    return code.select("binary_id", "fn", (F.col("fn") * 16 + F.col("i")).alias("addr"), "r.mnemonic", "r.operands")


def _named(at: Column | int) -> Column:
    return F.concat(F.lit("rax, [0x"), F.lower(F.hex(F.lit(AT) + at)), F.lit("]"))


def _references(code, layout):
    image = code.join(layout.hint("merge"), "binary_id")
    return refs.data_refs(image, F.col("base"), F.col("size"), "fn")


#: A part's text of up to 50 copies of its name, ten times over: it crosses up to four pages.
TEXT_SQL = "SELECT o_orderkey AS fn, o_custkey AS binary_id, repeat(p_name, p_size * 10) AS text, o_orderkey % 3000 AS k FROM orders JOIN part ON o_custkey = p_partkey"


def _text() -> Column:
    return F.encode(F.repeat("p_name", F.col("p_size") * 10), "UTF-8")


@query(
    "function_strings",
    f"""WITH t AS ({TEXT_SQL}), found AS (
        SELECT *, 0 AS i, 16 AS place, text AS got FROM t UNION ALL SELECT *, 2, 16, text FROM t UNION ALL SELECT *, 3, 16 + k, substr(text, CAST(k + 1 AS INTEGER)) FROM t)
        SELECT binary_id, fn, fn * 16 + i AS src, CAST({AT} + place AS BIGINT) AS addr, CAST(length(got) AS BIGINT) AS n, md5(got) AS digest FROM found WHERE got <> ''""",
)
def function_strings(spark, sf_dir):
    """Functions name a pointer to a pointer, one to itself, one to the first, and a place inside the text or behind it."""
    pointers = F.concat(le(AT + 8, 4), le(AT + 4, 4), le(AT + 16, 4), le(AT, 4))
    layout, found = _image(spark, sf_dir, F.concat(F.unhex(pointers), _text(), F.unhex(zeros(1))))
    code = _code(spark, sf_dir, ("mov", _named(0)), ("lea", _named(4)), ("push", _named(12)), ("mov", _named(16 + F.col("o_orderkey") % 3000)), ("call", _named(16)), ("ret", F.lit("")))
    rows = strings.function_strings(_references(code, layout), layout, found, n=F.length("text").cast("long"), digest=F.md5("text"))
    return rows.select("binary_id", "fn", "src", F.col("addr").cast("long").alias("addr"), "n", "digest")


@query(
    "go_function_strings",
    f"""WITH t AS ({TEXT_SQL}), found AS (
        SELECT *, 0 AS i, 32 AS place, CASE WHEN k > 0 THEN substr(text, 1, CAST(least(k, length(text)) AS INTEGER)) ELSE '' END AS got, k > length(text) AS over FROM t
        UNION ALL SELECT *, 3, 0, substr(text, 6, 4090), length(text) - 5 < 4090 FROM t)
        SELECT binary_id, fn, fn * 16 + i AS src, CAST({AT} + place AS BIGINT) AS addr, CAST(length(got) AS BIGINT) AS n, md5(got) AS digest FROM found WHERE NOT over AND got <> ''""",
)
def go_function_strings(spark, sf_dir):
    """Lengths are moved behind an address, or stand beside a pointer; what follows the text is no zero byte, so length decides."""
    pairs = F.concat(le(AT + 37, 8), le(4090, 8), le(5, 8), le(9, 8))
    layout, found = _image(spark, sf_dir, F.concat(F.unhex(pairs), _text(), F.unhex(F.lit("FF"))))
    moved = F.concat(F.lit("rbx, "), F.col("o_orderkey") % 3000)
    code = _code(
        spark, sf_dir, ("lea", _named(32)), ("mov", F.lit("rcx, rax")), ("mov", moved), ("mov", _named(0)), ("mov", F.lit("rcx, rax")), ("add", F.lit("rbx, 7")), ("mov", _named(16)), ("ret", F.lit(""))
    )
    rows = strings.go_function_strings(code, _references(code, layout), layout, found, F.lit(8))
    return rows.select("binary_id", "fn", "src", F.col("addr").cast("long").alias("addr"), F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))

"""Queries on images as pages: files are built from rows, with layers that overlap, end in zeros, or grow too large."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.plans.image_queries import BASE, PE_BASE, _files, _parts, _pe, joined, le, longs, zeros
from ferrule.plans.registry import query, table
from ferrule.sources import pages

#: Where the built files keep their code, and how far their zeros reach behind 0x3000.
CODE, TAIL, HUGE = 372, 5000, 1 << 28


def _layered(spark, sf_dir: str):
    """ELF files of two segments and three sections: code with a mark painted over it, a note two pages on, zeros behind."""
    code = F.hex(F.encode("p_name", "UTF-8"))
    n = F.length(code) / 2
    head = F.concat(F.lit("7F454C46020101"), zeros(9), le(2, 2), le(62, 2), le(1, 4), le(BASE, 8), le(64, 8), le(176, 8), le(0, 4), le(64, 2), le(56, 2), le(2, 2), le(64, 2), le(3, 2), le(0, 2))
    segment = lambda kind, at, addr, size: F.concat(le(kind, 4), le(5, 4), le(at, 8), le(addr, 8), le(addr, 8), le(size, 8), le(size, 8), le(4096, 8))
    section = lambda kind, addr, at, size: F.concat(le(0, 4), le(kind, 4), le(2, 8), le(addr, 8), le(at, 8), le(size, 8), zeros(24))
    tail = F.when(F.col("p_size") > 45, HUGE).otherwise(TAIL)
    content = joined(
        head, segment(1, CODE, BASE + CODE, n), segment(4, 64, BASE + 0x2000, F.lit(16)),
        section(1, BASE + CODE, CODE, n), section(8, BASE + 0x3000 + F.col("p_size"), CODE, tail), section(1, BASE + CODE + 4, 368, F.lit(4)),
        F.lit(b"MARK".hex()), code,
    )
    return _files(_parts(spark, sf_dir), "p_partkey", content)


@query(
    "elf_layout",
    f"""SELECT p_partkey AS binary_id, CAST({BASE} AS BIGINT) AS base, CAST(CASE WHEN p_size > 45 THEN 0 ELSE 5 * 4096 END AS BIGINT) AS size,
        CASE WHEN p_size > 45 THEN 'oversize' END AS fault FROM part""",
)
def elf_layout(spark, sf_dir):
    layout, _ = pages.elf_image(_layered(spark, sf_dir))
    return layout.select("binary_id", F.col("base").cast("long").alias("base"), "size", "fault")


@query(
    "elf_extents",
    longs(
        f"""SELECT * FROM (
        SELECT p_partkey AS binary_id, 0 AS "start", 64 AS "end", 0 AS file_at, 64 AS held FROM part WHERE p_size <= 45
        UNION ALL SELECT p_partkey, {CODE}, {CODE} + 4, {CODE}, 4 FROM part WHERE p_size <= 45
        UNION ALL SELECT p_partkey, {CODE} + 4, {CODE} + 8, 368, 4 FROM part WHERE p_size <= 45
        UNION ALL SELECT p_partkey, {CODE} + 8, {CODE} + length(p_name), {CODE} + 8, length(p_name) - 8 FROM part WHERE p_size <= 45 AND length(p_name) > 8
        UNION ALL SELECT p_partkey, 8192, 8208, 64, 16 FROM part WHERE p_size <= 45
        UNION ALL SELECT p_partkey, 12288 + p_size, 12288 + p_size + {TAIL}, {CODE}, 0 FROM part WHERE p_size <= 45)""",
        "binary_id", '"start"', '"end"', "file_at", "held",
    ),
)
def elf_extents(spark, sf_dir):
    return pages.elf_image(_layered(spark, sf_dir))[1]


@query(
    "elf_pages",
    f"""SELECT p_partkey AS binary_id, CAST(page AS BIGINT) AS page, CAST(4096 AS BIGINT) AS size, CASE page WHEN 0 THEN '7F454C46' ELSE '01000000' END AS head,
        CASE page WHEN 0 THEN substr(p_name, 1, 4) || 'MARK' || substr(p_name, 9) ELSE '' END AS code
        FROM part, (VALUES (0), (2)) AS v(page) WHERE p_size <= 45""",
)
def elf_pages(spark, sf_dir):
    files = _layered(spark, sf_dir)
    found = pages.image_pages(files, pages.elf_image(files)[1])
    code = F.replace(F.decode(F.substring("bytes", F.lit(CODE + 1), F.lit(pages.PAGE)), "ISO-8859-1"), F.lit("\0"), F.lit(""))
    return found.select("binary_id", "page", F.octet_length("bytes").cast("long").alias("size"), F.hex(F.substring("bytes", 1, 4)).alias("head"), code.alias("code"))


@query(
    "pe_pages",
    f"""SELECT p_partkey AS binary_id, CAST(CAST(p_partkey AS HUGEINT) + {PE_BASE} AS VARCHAR) AS base, 4096 + length(p_name) AS size, CAST(page AS BIGINT) AS page,
        CASE page WHEN 0 THEN '4D5A' ELSE '' END AS head, p_name AS code FROM part, (VALUES (0), (1)) AS v(page)""",
)
def pe_pages(spark, sf_dir):
    """No section starts behind the first 512 bytes of these files, so all of them counts as header, code included."""
    files = _pe(spark, sf_dir)
    layout, extents = pages.pe_image(files)
    found = pages.image_pages(files, extents).join(layout, "binary_id")
    at = F.when(F.col("page") == 0, 513).otherwise(1)
    code = F.replace(F.decode(F.substring("bytes", at, F.lit(pages.PAGE)), "ISO-8859-1"), F.lit("\0"), F.lit(""))
    head = F.when(F.col("page") == 0, F.hex(F.substring("bytes", 1, 2))).otherwise("")
    return found.select("binary_id", F.col("base").cast("string").alias("base"), "size", "page", head.alias("head"), code.alias("code"))


@query(
    "painted_extents",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS r, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY ALL),
       b AS (SELECT k, r, r * 13 % 40 AS s, n FROM p), y AS (SELECT k, r, s, unnest(range(s, s + n)) AS x FROM b),
       top AS (SELECT k, x, max(r) AS r, arg_max(x - s, r) AS place FROM y GROUP BY k, x),
       runs AS (SELECT *, x - row_number() OVER (PARTITION BY k, r ORDER BY x) AS run FROM top)
       SELECT k AS binary_id, CAST(min(x) AS BIGINT) AS "start", CAST(max(x) + 1 AS BIGINT) AS "end", CAST(min(place) AS BIGINT) AS file_at, CAST(count(*) AS BIGINT) AS held
       FROM runs GROUP BY k, r, run""",
)
def painted_extents(spark, sf_dir):
    """Each line of an order is a layer as long as its quantity; later lines cover earlier ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("long")).alias("n"))
    start = (F.col("l_linenumber") * 13 % 40).cast("long")
    pieces = lines.select(F.col("l_orderkey").alias("binary_id"), F.col("l_linenumber").cast("long").alias("rank"), start.alias("start"), (start + F.col("n")).alias("end"), F.lit(0).cast("long").alias("file_at"), F.col("n").alias("held"))
    return pages.paint(pieces)


@query(
    "page_reads",
    """SELECT o_orderkey, CASE WHEN k <= 8184 THEN upper(hex(substr(repeat('ABCDEFGH', 512) || repeat(chr(0), 4096), CAST(k AS INTEGER) + 1, 8))) ELSE 'outside' END AS got
       FROM (SELECT o_orderkey, o_custkey * 61 % 9000 AS k FROM orders)""",
)
def page_reads(spark, sf_dir):
    """Eight bytes at addresses dealt over two pages, of which the second is not stored, and beyond their end."""
    orders = table(spark, sf_dir, "orders")
    ids = orders.select(F.col("o_orderkey").alias("binary_id"))
    stored = ids.select("binary_id", F.lit(0).cast("long").alias("page"), F.encode(F.repeat(F.lit("ABCDEFGH"), F.lit(512)), "UTF-8").alias("bytes"))
    layout = ids.select("binary_id", F.lit(BASE).cast("decimal(20,0)").alias("base"), F.lit(8192).cast("long").alias("size"), F.lit(None).cast("string").alias("fault"))
    asked = orders.select(F.col("o_orderkey").alias("binary_id"), (BASE + F.col("o_custkey") * 61 % 9000).alias("addr"), F.lit(8).alias("n"))
    return pages.read_pages(asked, layout, stored).select(F.col("binary_id").alias("o_orderkey"), F.coalesce(F.hex("read"), F.lit("outside")).alias("got"))

"""Images of ELF and PE files as pages, so that no row holds an image.

Layers of a file (segments, sections, header) are painted before any byte is touched: a sweep over their bounds gives the
disjoint extents that show, and only these are cut out of the file, page by page. What lies over a point is found by dyadic
blocks: a layer is the union of a few aligned blocks for each power of two, a point lies in one block of each size, so both
meet in an equi-join, whatever overlaps what, and work grows with the layers times the bits of the longest one of a file.

Both sides of every join grow with the corpus, and Spark takes them for small: staged columns of few values shrink to almost
nothing in a file, and an explode counts as one row. Broadcasting them takes the driver's memory, so joins are told to sort.

Three tables describe images: the layout (binary_id, base, size, fault), extents (binary_id, start, end, file_at, held), and
pages (binary_id, page, bytes). Offsets count from the base. Pages that nothing but zeros would fill are not stored; readers
give zeros for them. Files that cannot be mapped keep a row in the layout with a fault: ``empty`` (no addresses) or
``oversize`` (above ``MOST`` bytes). Rows without binary_id belong to no binary and are left out; the same file twice gives
the same pages once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.session import staged
from ferrule.sources import binaries as headers
from ferrule.sources import containers

#: Fixed limits: bytes of a page and of an image, the end of signed addresses, and the least file place of a PE section that
#: bounds the headers.
PAGE, MOST, SIGNED, PE_HEADER_FROM = 0x1000, 100 << 20, (1 << 63) - 1, 0x200
#: Bytes of pages that one task sorts.
PART = 64 << 20
NO_BITS = 8  # section type without bytes in the file


def paint(pieces: DataFrame) -> DataFrame:
    """Disjoint extents (binary_id, start, end, file_at, held) of pieces (binary_id, rank, start, end, file_at, held).

    Of pieces over a point, the highest rank shows; ranks are unique within a binary. ``held`` is the number of bytes that
    the file has for a piece or an extent; the rest of it is zeros. Pieces are written to the
    shared folder first, since bounds, blocks and places in the file are each derived from them.
    """
    pieces = staged(pieces.where("binary_id IS NOT NULL AND start >= 0 AND start < end"), "pieces")
    levels = lambda n: f"sequence(0, length(bin({n})) - 1)"  # noqa: E731  of blocks that n bytes can hold
    blocks = f"transform({levels('end - start')}, k -> struct(k AS level, shiftright(start + shiftleft(1L, k) - 1, k) AS l, shiftright(end, k) AS r))"
    flanks = "filter(array(if(d.l % 2 = 1, d.l, NULL), if(d.r % 2 = 1, d.r - 1, NULL)), b -> b IS NOT NULL)"
    cut = pieces.select("binary_id", "rank", F.explode(F.expr(blocks)).alias("d")).where("d.l < d.r")
    cover = cut.select("binary_id", "rank", "d.level", F.explode(F.expr(flanks)).alias("block"))
    tops = cover.groupBy("binary_id", "level", "block").agg(F.max("rank").alias("rank"))

    along = Window.partitionBy("binary_id").orderBy("start")
    bounds = pieces.select("binary_id", F.explode(F.array("start", "end")).alias("start"), (F.col("end") - F.col("start")).alias("n"))
    points = bounds.groupBy("binary_id", "start").agg(F.max("n").alias("n")).withColumn("n", F.max("n").over(Window.partitionBy("binary_id")))
    spans = points.withColumn("end", F.lead("start").over(along)).where("end IS NOT NULL")
    asked = spans.select("*", F.explode(F.expr(f"transform({levels('n')}, k -> struct(k AS level, shiftright(start, k) AS block))")).alias("d"))
    seen = asked.select("binary_id", "start", "end", "d.level", "d.block").join(tops.hint("merge"), ["binary_id", "level", "block"])
    shown = seen.groupBy("binary_id", "start", "end").agg(F.max("rank").alias("rank"))

    changes = F.coalesce((F.lag("rank").over(along) != F.col("rank")).cast("int"), F.lit(1))
    runs = shown.withColumn("new", changes).withColumn("run", F.sum("new").over(along))
    whole = runs.groupBy("binary_id", "rank", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    of = pieces.select("binary_id", "rank", F.col("start").alias("from"), "file_at", "held")
    into = F.col("start") - F.col("from")
    return whole.join(of.hint("merge"), ["binary_id", "rank"]).select(
        "binary_id", "start", "end", (F.col("file_at") + into).alias("file_at"), F.greatest(F.least(F.col("held") - into, F.col("end") - F.col("start")), F.lit(0).cast("long")).alias("held")
    )


def _placed(pieces: DataFrame, layout: DataFrame, *order) -> DataFrame:
    """Pieces (binary_id, at, n, file_at, held, and what ``order`` names) ranked and clipped to their image."""
    within = pieces.join(layout.where("fault IS NULL").select("binary_id", "size").hint("merge"), "binary_id").where("at >= 0 AND n > 0")
    rank = F.row_number().over(Window.partitionBy("binary_id").orderBy(*order)).cast("long")
    return within.select("binary_id", rank.alias("rank"), F.col("at").alias("start"), F.least(F.col("at") + F.col("n"), F.col("size")).alias("end"), "file_at", "held")


def _fault(size: Column) -> Column:
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST, "oversize")


def elf_image(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout and extents of ELF files (binary_id, format, content).

    Segments are painted from the largest to the smallest, sections over them in the same way, those without bytes in the
    file as zeros, and over all what precedes the first of them in the file. Sections that end beyond all signed addresses
    are bogus: segments alone count then (the base is chosen by addresses as they are, the rest by those less the base). The
    size is rounded up to a page.
    """
    files = files.where("format = 'elf' AND binary_id IS NOT NULL")
    entries = ["binary_id", "place", "type", "addr", "file_at"]
    sections = staged(containers.elf_sections(files).where("addr > 0").select(*entries, "size").dropDuplicates(["binary_id", "place"]), "sections")
    segments = staged(containers.elf_segments(files).where("addr > 0").select(*entries, "size", "file_size").dropDuplicates(["binary_id", "place"]), "segments")
    end = F.col("addr") + F.col("size")
    of_sections = sections.groupBy("binary_id").agg(
        F.max(end).alias("s_high"), F.min(F.when(F.col("addr") >= F.col("file_at"), F.col("addr") - F.col("file_at"))).alias("s_base"), F.min("file_at").alias("s_raw")
    )
    of_segments = segments.groupBy("binary_id").agg(F.max(end).alias("g_high"), F.min("addr").alias("g_base"), F.min("file_at").alias("g_raw"))
    lengths = files.select("binary_id", F.octet_length("content").cast("long").alias("length")).dropDuplicates(["binary_id"])
    known = lengths.join(of_sections.hint("merge"), "binary_id", "left").join(of_segments.hint("merge"), "binary_id", "left")
    base = F.coalesce(F.when(F.col("s_high") > SIGNED, F.col("g_base")).otherwise(F.col("s_base")), F.lit(0)).cast("decimal(20,0)")
    known = known.withColumn("base", base).withColumn("bogus", F.coalesce(F.col("s_high") - F.col("base") > SIGNED, F.lit(False)))
    high = F.greatest(F.when(~F.col("bogus"), F.col("s_high")), F.col("g_high"))
    first = F.least(F.when(~F.col("bogus"), F.col("s_raw")), F.col("g_raw"))
    known = known.withColumn("extent", high - F.col("base")).withColumn("first", first).withColumn("fault", _fault(F.col("extent")))
    size = F.when(F.col("fault").isNull(), (F.ceil(F.col("extent") / PAGE) * PAGE).cast("long")).otherwise(F.lit(0).cast("long"))
    known = staged(known.withColumn("size", size), "layout")

    def layer(rows: DataFrame, n: str, number: int) -> DataFrame:
        # the comparison comes before the cast: addresses need not fit a long
        near = rows.join(known.where("fault IS NULL").select("binary_id", "base", "bogus", "length").hint("merge"), "binary_id").where(F.col("addr").between(F.col("base"), F.col("base") + 2 * MOST))
        there = F.greatest(F.least(F.col(n), F.col("length") - F.col("file_at")), F.lit(0).cast("long"))
        held = F.when(F.col("type") == NO_BITS, F.lit(0).cast("long")).otherwise(there) if number else there
        near = near.where("NOT bogus") if number else near
        return near.select("binary_id", F.lit(number).alias("layer"), "place", (F.col("addr") - F.col("base")).cast("long").alias("at"), F.col(n).alias("n"), "file_at", held.alias("held"))

    top = F.least("first", "length", "size")
    head = known.where("fault IS NULL AND first > 0").select(
        "binary_id", F.lit(2).alias("layer"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("at"), top.alias("n"), F.lit(0).cast("long").alias("file_at"), top.alias("held")
    )
    layout = known.select("binary_id", "base", "size", "fault")
    pieces = layer(segments, "file_size", 0).unionByName(layer(sections, "size", 1)).unionByName(head)
    return layout, paint(_placed(pieces, layout, "layer", F.desc("n"), "place"))


def pe_image(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout and extents of PE files: the headers up to the first section's bytes, then each section's bytes in their order."""
    found = headers.pe_headers(files.where("binary_id IS NOT NULL"))
    found = found.select("binary_id", F.col("image_base").alias("base"), F.octet_length("content").cast("long").alias("length"), "sections")
    found = staged(found.dropDuplicates(["binary_id"]), "sections")
    extent = F.array_max(F.transform("sections", lambda s: s["rva"] + F.greatest(s["vsize"], s["raw_size"])))
    first = F.array_min(F.transform(F.filter("sections", lambda s: s["raw_at"] > PE_HEADER_FROM), lambda s: s["raw_at"]))
    found = found.withColumn("extent", extent).withColumn("first", first).withColumn("fault", _fault(F.col("extent")))
    found = found.withColumn("size", F.when(F.col("fault").isNull(), F.col("extent")).otherwise(F.lit(0).cast("long")))
    layout = found.select("binary_id", "base", "size", "fault")
    zero = F.lit(0).cast("long")
    top = F.least(F.coalesce("first", "length"), "length", "size")
    head = found.where("fault IS NULL").select("binary_id", F.lit(-1).alias("place"), zero.alias("at"), top.alias("n"), zero.alias("file_at"), top.alias("held"))
    each = found.where("fault IS NULL").select("binary_id", "length", F.posexplode("sections").alias("place", "s"))
    there = F.greatest(F.least(F.col("s.raw_size"), F.col("length") - F.col("s.raw_at")), zero)
    body = each.select("binary_id", "place", F.col("s.rva").alias("at"), there.alias("n"), F.col("s.raw_at").alias("file_at"), there.alias("held"))
    return layout, paint(_placed(head.unionByName(body), layout, "place"))


def image_pages(files: DataFrame, extents: DataFrame) -> DataFrame:
    """(binary_id, page, bytes) of the pages that hold bytes of the file; every page has ``PAGE`` bytes.

    The extents of one file are one array beside its content: at most a few for each entry of its tables, whose counts have
    16 bits in the formats.
    """
    held = extents.where("held > 0").withColumn("end", F.least("end", F.col("start") + F.col("held")))
    spans = held.groupBy("binary_id").agg(F.collect_list(F.struct("start", "end", "file_at")).alias("spans"))
    each = files.select("binary_id", "content").join(spans.hint("merge"), "binary_id").select("binary_id", "content", F.explode("spans").alias("s"))
    paged = each.select("*", F.explode(F.sequence(F.floor(F.col("s.start") / PAGE), F.floor((F.col("s.end") - 1) / PAGE))).alias("page"))
    start, end = F.greatest("s.start", F.col("page") * PAGE), F.least("s.end", (F.col("page") + 1) * PAGE)
    chunk = F.substring("content", (F.col("s.file_at") + start - F.col("s.start") + 1).cast("int"), (end - start).cast("int"))
    parts = paged.select("binary_id", "page", (start - F.col("page") * PAGE).cast("int").alias("at"), chunk.alias("chunk"))
    filled = parts.groupBy("binary_id", "page").agg(F.collect_list(F.struct("at", "chunk")).alias("parts"))
    blank = F.unhex(F.lit("00" * PAGE))
    return filled.select("binary_id", "page", F.aggregate("parts", blank, lambda acc, p: F.overlay(acc, p["chunk"], p["at"] + 1)).alias("bytes"))


def read_pages(asked: DataFrame, layout: DataFrame, pages: DataFrame) -> DataFrame:
    """``asked`` (binary_id, addr, n and others) with ``read``: n bytes at an address, at most a page; null outside the image.

    Two equi-joins with pages: a read touches a page and perhaps the next one. Pages are counted first and dealt into as many
    parts as leave ``PART`` bytes of them for a task to sort; of the first page only the bytes asked for go on.
    Both sides are dealt, else the pages of an image would follow it into one task.
    """
    parts = 1 + pages.count() * PAGE // PART
    dealt = lambda at, name: pages.select("binary_id", F.col("page").alias(at), F.col("bytes").alias(name)).repartition(parts, "binary_id", at).hint("merge")
    inside = layout.where("fault IS NULL").select("binary_id", F.col("base").alias("_base"), F.col("size").alias("_size"))
    placed = asked.join(inside.hint("merge"), "binary_id", "left")
    fits = (F.col("addr") >= F.col("_base")) & (F.col("addr") + F.col("n") <= F.col("_base") + F.col("_size")) & F.col("n").between(1, PAGE)
    placed = placed.withColumn("_at", F.when(fits, (F.col("addr") - F.col("_base")).cast("long"))).withColumn("_page", F.floor(F.col("_at") / PAGE))
    crosses = F.when(F.col("_at") % PAGE + F.col("n") > PAGE, F.col("_page") + 1)
    blank = F.unhex(F.lit("00" * PAGE))
    off = (F.col("_at") % PAGE).cast("int")
    first = F.substring(F.coalesce("_one", blank), off + 1, F.col("n").cast("int"))
    met = placed.withColumn("_next", crosses).repartition(parts, "binary_id", "_page").join(dealt("_page", "_one"), ["binary_id", "_page"], "left").withColumn("_one", first)
    met = met.repartition(parts, "binary_id", "_next").join(dealt("_next", "_two"), ["binary_id", "_next"], "left")
    rest = F.substring(F.coalesce("_two", blank), F.lit(1), (off + F.col("n") - PAGE).cast("int"))
    read = F.when(F.col("_at").isNotNull(), F.concat("_one", F.when(F.col("_next").isNotNull(), rest).otherwise(F.unhex(F.lit("")))))
    return met.select(*asked.columns, read.alias("read"))

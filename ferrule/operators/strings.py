"""Strings that functions refer to, read from images stored as pages (see ``sources.pages``).

``function_strings`` reads the pages of an image, at most 100 MB, where they are dealt to. For ``read_texts`` an address is looked
up by an equi-join with its page. No row holds an image. A text may run over any number of pages: of
each page only the length of its printable beginning is needed to tell where a text ends, and runs of pages that are printable
throughout are islands, so the end of a text of a thousand pages is found by the same joins as that of a short one. Texts
are read once for each address, however many instructions refer to it. Joins are told to sort, as those of ``sources.pages``.

Texts are printable ASCII, ended by a zero byte or by a given length. UTF-16 text has no rule of its own: its first
character and the zero after it are a text already, and the narrow rule comes first.

Rows without binary_id or address, addresses outside their image, and images with a fault give no text. Equal rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.session import staged
from ferrule.sources.batches import SLICE, Files, flat, whole_binaries
from ferrule.sources.pages import PAGE, PART, read_pages

#: Fixed limits of a chain of pointers: addresses in it, and bytes of a pointer (of every image).
CHAIN, POINTER = 11, 4
PRINTABLE = "^[\\t-\\r -~]*+"
_PRINTABLE = np.isin(np.arange(256), [*range(9, 14), *range(32, 127)])
#: Rows that are looked at at once, and references in one row with their text.
ROWS, USERS = 1 << 16, 1 << 10
ADDRESS = "decimal(20,0)"


def _run(part: Column) -> Column:
    """Length of the printable beginning of bytes."""
    return F.length(F.regexp_extract(F.decode(part, "ISO-8859-1"), PRINTABLE, 0))


def _number(read: Column) -> Column:
    """Little-endian unsigned number; null for null."""
    return F.conv(_swapped(F.hex(read)), 16, 10).cast(ADDRESS)


def _swapped(digits: Column) -> Column:
    """Pairs of hexadecimal digits from the last to the first."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")


def read_texts(asked: DataFrame, layout: DataFrame, pages: DataFrame) -> DataFrame:
    """(binary_id, addr, most, text) of the asked (binary_id, addr, most) at which a text stands.

    Without ``most`` (null) a text ends before a zero byte inside the image; with it, before a zero byte or after ``most``
    bytes, whichever comes first. A text has one character or more.
    """
    inside = layout.where("fault IS NULL").select("binary_id", F.col("base").alias("_base"), F.col("size").alias("_size"))
    placed = asked.select("binary_id", F.col("addr").cast(ADDRESS).alias("addr"), F.col("most").cast(ADDRESS).alias("most")).distinct().join(inside.hint("merge"), "binary_id")
    placed = placed.where("addr >= _base AND addr < _base + _size").withColumn("_at", (F.col("addr") - F.col("_base")).cast("long"))
    # no text is longer than its image; one byte more than that is never reached
    fits = F.least("most", (F.col("_size") + 1).cast(ADDRESS)).cast("long")
    placed = placed.withColumn("_most", F.when(F.col("most").isNotNull(), fits)).where("_most IS NULL OR _most > 0")
    placed = placed.withColumn("_page", F.floor(F.col("_at") / PAGE)).withColumn("_off", (F.col("_at") % PAGE).cast("int"))

    head = _run(F.col("bytes"))
    facts = staged(pages.select("binary_id", "page", head.alias("head"), F.hex(F.substring("bytes", head + 1, F.lit(1))).alias("stop")), "heads")
    along = Window.partitionBy("binary_id").orderBy("page")
    full = facts.where(F.col("head") == PAGE).select("binary_id", "page", (F.col("page") - F.row_number().over(along)).alias("run"))
    islands = full.withColumn("last", F.max("page").over(Window.partitionBy("binary_id", "run"))).select("binary_id", F.col("page").alias("_next"), "last")
    ends = facts.select("binary_id", F.col("page").alias("_end"), "head", "stop")

    first = placed.join(pages.select("binary_id", F.col("page").alias("_page"), "bytes").hint("merge"), ["binary_id", "_page"])
    first = first.withColumn("_part", F.substring("bytes", F.col("_off") + 1, F.lit(PAGE))).withColumn("_run", _run(F.col("_part")).cast("long")).where("_run > 0")
    first = first.withColumn("_stop", F.hex(F.substring("_part", F.col("_run").cast("int") + 1, F.lit(1)))).drop("bytes")
    done = (F.col("_run") + F.col("_off") < PAGE) | F.coalesce(F.col("_most") <= F.col("_run"), F.lit(False))
    first = staged(first.withColumn("_done", done), "texts")

    def closed(rows: DataFrame) -> DataFrame:
        by_zero = (F.col("_stop") == "00") & (F.col("_at") + F.col("_run") < F.col("_size"))
        by_length = F.coalesce(F.col("_run") >= F.col("_most"), F.lit(False))
        return rows.where(by_zero | by_length).withColumn("_take", F.least("_run", "_most"))

    text = lambda part: F.decode(F.substring(part, F.lit(1), F.col("_take").cast("int")), "US-ASCII")
    keys = ["binary_id", "addr", "most"]
    short = closed(first.where("_done")).select(*keys, text("_part").alias("text"))

    far = first.where("NOT _done").withColumn("_next", F.col("_page") + 1).join(islands.hint("merge"), ["binary_id", "_next"], "left")
    far = far.withColumn("_end", F.coalesce(F.col("last") + 1, F.col("_next"))).join(ends.hint("merge"), ["binary_id", "_end"], "left")
    run = F.col("_end") * PAGE + F.coalesce("head", F.lit(0)) - F.col("_at")
    far = closed(far.withColumn("_run", run).withColumn("_stop", F.coalesce("stop", F.lit("00"))))
    final = F.floor((F.col("_at") + F.col("_take") - 1) / PAGE)
    each = far.select(*keys, "_off", "_take", F.explode(F.sequence("_page", final)).alias("page")).join(pages.select("binary_id", "page", "bytes").hint("merge"), ["binary_id", "page"])
    whole = each.groupBy(*keys, "_off", "_take").agg(F.sort_array(F.collect_list(F.struct("page", "bytes"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
    long = whole.select(*keys, F.decode(F.substring(joined, F.col("_off") + 1, F.col("_take").cast("int")), "US-ASCII").alias("text"))
    return short.unionByName(long)


def _with_texts(asked: DataFrame, layout: DataFrame, pages: DataFrame) -> DataFrame:
    """``asked`` (binary_id, addr, most and others) joined with the texts at its addresses; rows without text go."""
    texts = read_texts(asked, layout, pages).withColumn("_most", F.coalesce("most", F.lit(-1))).drop("most")
    return asked.withColumn("_most", F.coalesce(F.col("most").cast(ADDRESS), F.lit(-1))).join(texts.hint("merge"), ["binary_id", "addr", "_most"]).drop("_most")


class _Images:
    """Pages of several images (numbered ``b``, ``at`` being an offset from the base), one after the other; absent ones are zeros."""

    def __init__(self, size: np.ndarray, b: np.ndarray, page: np.ndarray, data: np.ndarray):
        self.size, self.data = size, data
        self.wide = int(page.max(initial=0)) + 1
        self.key = b * self.wide + page
        ends = np.append(np.flatnonzero((np.diff(b) != 0) | (np.diff(page) != 1)), len(b) - 1)
        self.run_end = PAGE * (np.repeat(ends, np.diff(np.append(-1, ends))) + 1) if len(b) else b
        self.stops = np.append(np.flatnonzero(~_PRINTABLE[data]), len(data))

    def spot(self, b, at):
        """Places in ``data``; -1 on absent pages."""
        page = at // PAGE
        key = b * self.wide + np.minimum(page, self.wide - 1)
        i = np.searchsorted(self.key, key)
        known = (page < self.wide) & (i < len(self.key))
        known[known] = self.key[i[known]] == key[known]
        return np.where(known, i * PAGE + at % PAGE, -1)

    def pointer(self, b, at):
        spots = (self.spot(b, at + i) for i in range(POINTER))
        return sum(np.where(s >= 0, self.data[s], 0).astype(np.int64) << 8 * i for i, s in enumerate(spots)) if len(self.data) else np.zeros(len(b), np.int64)

    def chains(self, b, at, base):
        """(point, at): the offsets met from each point by following pointers; bases beyond a pointer are -1."""
        who, past, met = np.arange(len(b)), [at], [(np.arange(len(b)), at)]
        for _ in range(CHAIN - 1):
            now, own = past[-1], b[who]
            to = self.pointer(own, now) - base[own]
            go = (base[own] >= 0) & (now <= self.size[own] - POINTER) & (to >= 0) & (to < self.size[own])
            for old in past:
                go &= to != old
            who, past = who[go], [*(old[go] for old in past), to[go]]
            if not len(who):
                break
            met.append((who, past[-1]))
        return tuple(np.concatenate(m) for m in zip(*met))

    def texts(self, b, at):
        """Place and length of the text at each point; 0 where none stands."""
        spot = self.spot(b, at)
        if not len(self.data):
            return spot, np.zeros(len(b), np.int64)
        limit = self.run_end[np.maximum(spot, 0) // PAGE]
        end = np.minimum(self.stops[np.searchsorted(self.stops, spot)], limit)
        n = end - spot
        zero = (end == limit) | (self.data[np.minimum(end, len(self.data) - 1)] == 0)
        return spot, np.where((spot >= 0) & zero & (at + n < self.size[b]), n, 0)


def _parts_of(value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper halves of decimals."""
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.frombuffer(value.buffers()[1], np.uint64).reshape(-1, 2)[value.offset : value.offset + len(value)]
    return both[:, 0], both[:, 1].astype(np.int64)


def _texts_of_images(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of whole binaries: the layout's, then pages in their order, then references."""
    ids, kind = rows["binary_id"].combine_chunks(), np.asarray(rows["_kind"])
    first = np.flatnonzero(np.append(True, np.asarray(pc.not_equal(ids[1:], ids[:-1]), bool)))
    b = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    laid, paged, named = (np.flatnonzero(kind == k) for k in range(3))
    size, base = np.zeros(len(first), np.int64), np.zeros((2, len(first)), np.uint64)
    size[b[laid]] = np.asarray(rows["_size"].take(pa.array(laid)), np.int64)
    bases = rows["_base"].take(pa.array(laid)).combine_chunks()
    base[0, b[laid]], base[1, b[laid]] = (x.astype(np.uint64) for x in _parts_of(bases))
    pages = np.asarray(rows["_page"].take(pa.array(paged)), np.int64)
    span = max(int(size.max()), (int(pages.max(initial=0)) + 1) * PAGE) + 1
    if len(first) > 1 and span * len(first) >= 1 << 62:
        for at, n in zip(first, np.diff(np.append(first, len(ids)))):
            yield from _texts_of_images(rows.slice(at, n))
        return
    images = _Images(size, b[paged], pages, Files(rows["_bytes"].take(pa.array(paged)).combine_chunks()).data[: len(paged) * PAGE])

    low, high = _parts_of(rows["_start"].take(pa.array(named)).combine_chunks())
    of = b[named]
    at, upper = low - base[0, of], high - base[1, of].astype(np.int64) - (low < base[0, of])
    held = np.flatnonzero((upper == 0) & (at < size[of].astype(np.uint64)))
    named, of, at = named[held], of[held], at[held].astype(np.int64)
    points, point = np.unique(of * span + at, return_inverse=True)
    near = np.where((base[1] == 0) & (base[0] < 1 << 8 * POINTER), base[0], 0).astype(np.int64) - ((base[1] != 0) | (base[0] >= 1 << 8 * POINTER))
    who, to = images.chains(points // span, points % span, near)
    order = np.argsort(who, kind="stable")
    who, to = who[order], to[order]
    places, place = np.unique(points[who] // span * span + to, return_inverse=True)
    own, offset = places // span, places % span
    spot, n = images.texts(own, offset)

    links = np.bincount(who, minlength=len(points))
    row = np.repeat(np.arange(len(named)), links[point])
    text = place[flat((np.cumsum(links) - links)[point], links[point])]
    row, text = row[n[text] > 0], text[n[text] > 0]
    if not len(row):
        return
    source = rows.select(["fn", "src"]).take(pa.array(named)).combine_chunks()
    fn, src = (np.asarray(source[c].combine_chunks().dictionary_encode(null_encoding="encode").indices, np.int64) for c in ("fn", "src"))
    _, user = np.unique(fn * (src.max() + 1) + src, return_inverse=True)
    found, chosen = np.unique(text * (user.max() + 1) + user[row], return_index=True)
    row, text = row[chosen], text[chosen]
    # a text's references in lists of at most USERS
    new = np.append(True, np.diff(text) != 0)
    begin = np.flatnonzero(new)
    rank = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    begin = np.flatnonzero(rank % USERS == 0)
    ends, t = np.append(begin[1:], len(text)), text[begin]
    total, view, k = np.cumsum(n[t] + 32 * (ends - begin)), memoryview(images.data), 0
    laid_at = np.zeros(len(first), np.int64)
    laid_at[b[laid]] = np.arange(len(laid))
    while k < len(t):
        until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + SLICE, "right")))
        part = t[k:until]
        body = b"".join([view[a:e] for a, e in zip(spot[part].tolist(), (spot[part] + n[part]).tolist())])
        sizes = np.append(0, np.cumsum(n[part])).astype(np.int32)
        users = source.take(pa.array(row[begin[k] : ends[until - 1]])).combine_chunks()
        pairs = pa.StructArray.from_arrays([users[c].combine_chunks() for c in ("fn", "src")], ["fn", "src"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin[k:until], ends[until - 1]) - begin[k], pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(first[own[part]])), bases.take(pa.array(laid_at[own[part]])), pa.array(offset[part]), lists, pa.StringArray.from_buffers(len(part), pa.py_buffer(sizes), pa.py_buffer(body))],
            names=["binary_id", "_base", "_at", "_users", "text"],
        )
        k = until


def _read_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_binaries(batches, ROWS, 4 * SLICE):
        yield from _texts_of_images(rows)


def function_strings(refs: DataFrame, layout: DataFrame, pages: DataFrame, **values: Column) -> DataFrame:
    """(binary_id, fn, src, addr, text): texts at the addresses that instructions name, or that pointers there lead to.

    ``refs`` holds the data references (binary_id, fn, src, dst) of instructions; ``addr`` is where the text stands, as a
    decimal that holds every 64-bit address. A chain of pointers ends where one leaves the image, leads back into the chain
    or is cut by the image's end, and after ``CHAIN`` addresses. ``values`` of ``text``, if any, are returned in its place and
    made once for each text.

    Layout, pages and references are dealt by binary into parts of about ``PART`` bytes of pages. A part is read as a stream
    of binaries, many small ones at once; a worker holds the pages of one image, not its part. A text leaves it once, with
    those that refer to it.
    """
    image = layout.where("fault IS NULL AND size > 0 AND binary_id IS NOT NULL").select("binary_id", F.lit(0).alias("_kind"), F.col("base").cast(ADDRESS).alias("_base"), F.col("size").cast("long").alias("_size"))
    held = pages.where("binary_id IS NOT NULL").select("binary_id", F.lit(1).alias("_kind"), F.col("page").cast("long").alias("_page"), F.col("bytes").alias("_bytes"))
    named = refs.where("binary_id IS NOT NULL AND dst IS NOT NULL").select("binary_id", F.lit(2).alias("_kind"), "fn", "src", F.col("dst").cast(ADDRESS).alias("_start"))
    rows = image.unionByName(held, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    parts = max(1 + pages.count() * PAGE // PART, 2 * refs.sparkSession.sparkContext.defaultParallelism)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = f"binary_id {kinds['binary_id']}, _base {ADDRESS}, _at long, _users array<struct<fn: {kinds['fn']}, src: {kinds['src']}>>, text string"
    texts = rows.repartition(parts, "binary_id").sortWithinPartitions("binary_id", "_kind", "_page").mapInArrow(_read_images, made)
    values = values or {"text": F.col("text")}
    once = texts.select("binary_id", "_users", (F.col("_base") + F.col("_at")).cast(ADDRESS).alias("addr"), *[v.alias(k) for k, v in values.items()])
    return once.select("binary_id", F.explode("_users").alias("u"), "addr", *values).select("binary_id", "u.fn", "u.src", "addr", *values)


def go_function_strings(instructions: DataFrame, refs: DataFrame, layout: DataFrame, pages: DataFrame, word: Column) -> DataFrame:
    """(binary_id, fn, src, addr, text): strings of Go code, which have a length instead of an end.

    ``instructions`` (binary_id, fn, addr, mnemonic, operands, and what ``word``, the bytes of a pointer, needs) with exactly
    one reference (binary_id, src, dst) are looked at. If the next two of the function are ``mov`` and the second moves a
    decimal length, that many bytes at the reference are the string; if none stands there, the reference is taken for a
    pair of pointer and length. ``addr`` is the address referred to.
    """
    single = refs.select("binary_id", F.col("src").alias("addr"), F.col("dst").cast(ADDRESS).alias("dst")).distinct()
    single = single.groupBy("binary_id", "addr").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    along = Window.partitionBy("binary_id", "fn").orderBy("addr")
    ahead = instructions.select(
        "binary_id", "fn", "addr", word.alias("word"), F.lead("mnemonic", 1).over(along).alias("_one"), F.lead("mnemonic", 2).over(along).alias("_two"), F.lead("operands", 2).over(along).alias("_moved")
    )
    moves = (F.col("_one") == "mov") & (F.col("_two") == "mov")
    length = F.regexp_extract("_moved", "^[^,]*,\\s*\\+?([0-9]{1,19})\\s*$", 1).try_cast(ADDRESS)
    users = ahead.join(single.hint("merge"), ["binary_id", "addr"]).select("binary_id", "fn", F.col("addr").alias("src"), F.col("dst").alias("addr"), "word", F.when(moves & (length > 0), length).alias("most"))
    users = staged(users, "users")

    stated = staged(_with_texts(users.where("most IS NOT NULL").drop("word"), layout, pages).select("binary_id", "fn", "src", "addr", "text"), "stated")
    rest = users.join(stated.select("binary_id", "fn", "src").distinct().hint("merge"), ["binary_id", "fn", "src"], "left_anti")
    pairs = rest.select("binary_id", "addr", "word", (2 * F.col("word")).alias("n")).distinct()
    digits = F.hex("read")
    half = F.col("word") * 2
    pointer, size = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, half)
    value = lambda part: F.conv(_swapped(part), 16, 10).cast(ADDRESS)  # noqa: E731  of digits, not of bytes
    led = read_pages(pairs, layout, pages).where("read IS NOT NULL").select("binary_id", F.col("addr").alias("pair"), "word", value(pointer).alias("addr"), value(size).alias("most"))
    texts = _with_texts(staged(led, "pairs"), layout, pages).select("binary_id", F.col("pair").alias("addr"), "word", "text")
    return stated.unionByName(rest.join(texts.hint("merge"), ["binary_id", "addr", "word"]).select("binary_id", "fn", "src", "addr", "text")).distinct()

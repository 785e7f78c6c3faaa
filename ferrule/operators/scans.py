"""Pattern scans for function candidates over images, as expressions on words and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.binaries import uint

#: Fixed instruction encodings: mask and value.
A64_BL = (0xFC000000, 0x94000000)
A64_SAVE_FRAME = (0xFFC07FFF, 0xA9807BFD)
A64_SIGN_RETURN = (0xFFFFFFFF, 0xD503233F)
A64_ADR, A64_ADRP = (0x9F000000, 0x10000000), (0x9F000000, 0x90000000)
#: Fixed byte patterns that open x86 functions, in all images and in 64-bit ones.
X86_PROLOGUES = ("8BFF558BEC", "89FF558BEC", "558BEC", "5589E5", "554889E5", "F30F1EFA")
X64_PROLOGUES = ("41574156", "40534883EC", "40554883EC")
#: Fixed bytes between x86 functions: single ones, instructions without effect (beside NOPs), and openings that look like one.
X86_PADDING = ("90", "CC", "F4", "00")
X86_IDLE = (
    "0F0B", "8BC0", "89C0", "8BFF", "89FF", "8D00", "86C0", "662E", "EB00", "8BC9", "8BD2", "8BDB", "8BF6",
    "8D4000", "8D0000", "8D4900", "8D2424", "8D7600", "8D742600", "8D642400", "8DB600000000", "8DBF00000000",
    "8DB42600000000", "8DBC2700000000", "89F68DBC2700000000",
)
X86_PATCH_PLACES = ("8BFF558BEC", "89FF558BEC")


def matches(word: Column, pattern: tuple[int, int]) -> Column:
    return word.bitwiseAND(F.lit(pattern[0])) == pattern[1]


def a64_calls(words: DataFrame) -> DataFrame:
    """(binary_id, src, dst) of BL instructions: 26 signed bits, times four, from the instruction on."""
    low = F.col("word").bitwiseAND(F.lit(0x03FFFFFF))
    offset = F.when(low >= 1 << 25, low - (1 << 26)).otherwise(low) * 4
    return words.where(matches(F.col("word"), A64_BL)).select("binary_id", F.col("addr").alias("src"), (F.col("addr") + offset).alias("dst"))


def a64_prologues(words: DataFrame) -> DataFrame:
    hit = matches(F.col("word"), A64_SAVE_FRAME) | matches(F.col("word"), A64_SIGN_RETURN)
    return words.where(hit).select("binary_id", "addr")


def x86_calls(images: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """(binary_id, src, dst) of byte E8 with a 32-bit offset that is not zero and lands in the image.

    Images are cut into chunks that overlap by four bytes, so that no row holds a position for every byte.
    """
    size = F.octet_length("image")
    cut = images.where(size >= 5).select(
        "binary_id", "base", size.alias("_n"), "image", F.explode(F.sequence(F.lit(0), size - 5, F.lit(chunk))).alias("_at")
    )
    part = cut.select("binary_id", "base", "_n", "_at", F.substring("image", F.col("_at") + 1, F.lit(chunk + 4)).alias("_p"))
    hits = F.filter(
        F.sequence(F.lit(0), F.octet_length("_p") - 5), lambda i: F.hex(F.substring(F.col("_p"), i + 1, F.lit(1))) == "E8"
    )
    found = part.select("binary_id", "base", "_n", "_at", "_p", F.explode(hits).alias("_i"))
    raw = uint(F.col("_p"), F.col("_i") + 1, 4)
    offset = F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)
    src = (F.col("base") + F.col("_at") + F.col("_i")).cast("long")
    calls = found.select("binary_id", "base", "_n", src.alias("src"), (src + 5 + offset).alias("dst"), offset.alias("_o"))
    return calls.where("_o <> 0 and dst >= base and dst < base + _n").select("binary_id", "src", "dst")


def byte_patterns(images: DataFrame, patterns: tuple[str, ...], chunk: int = 1 << 14) -> DataFrame:
    """(binary_id, addr, pattern) of each place where a pattern (hex) stands, chunk by chunk; chunks overlap by a pattern."""
    longest = max(len(p) // 2 for p in patterns)
    size = F.octet_length("image")
    cut = images.where(size > 0).select("binary_id", "base", "image", F.explode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias("_at"))
    part = cut.select("binary_id", "base", "_at", F.hex(F.substring("image", F.col("_at") + 1, F.lit(chunk + longest - 1))).alias("_p"))
    firsts = "|".join(sorted({p[:2] for p in patterns}))
    spots = F.filter(F.sequence(F.lit(0), F.least(F.length("_p") / 2, F.lit(chunk)).cast("int") - 1), lambda i: F.substring(F.col("_p"), 2 * i + 1, F.lit(2)).rlike(firsts))
    each = part.where(F.length("_p") > 0).select("binary_id", "base", "_at", "_p", F.explode(spots).alias("_i"))
    named = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.substring(F.col("_p"), 2 * F.col("_i") + 1, F.length(p)) == p)
    addr = (F.col("base") + F.col("_at") + F.col("_i")).cast("long")
    return each.select("binary_id", addr.alias("addr"), F.explode(named).alias("pattern"))


def start_scores(starts: DataFrame, scores: DataFrame) -> DataFrame:
    """``starts`` (code: upper-case hex of the first bytes) with ``start_score``: that of the longest listed prefix, or 0.

    ``scores``: prefix, score. The table is a fixed list of a few prefixes, so it is sent to the tasks.
    """
    out = starts
    for size in (5, 4, 3, 1):
        own = scores.where(F.length("prefix") == 2 * size).select(F.col("prefix").alias("_p"), F.col("score").alias(f"_s{size}"))
        out = out.join(F.broadcast(own), F.substring(F.col("code"), F.lit(1), F.lit(2 * size)) == F.col("_p"), "left").drop("_p")
    names = [f"_s{n}" for n in (5, 4, 3, 1)]
    return out.withColumn("start_score", F.coalesce(*names, F.lit(0))).drop(*names)


def stub_chains(images: DataFrame, least: int = 2) -> DataFrame:
    """(binary_id, addr) of indirect jumps (FF 25 and four bytes) that stand in rows of at least ``least``."""
    from ferrule.operators.ranges import merge_areas

    hits = byte_patterns(images, ("FF25",)).select("binary_id", "addr")
    spans = merge_areas(hits.select("binary_id", F.col("addr").alias("start"), (F.col("addr") + 6).alias("end")), ("binary_id",))
    rows = spans.where((F.col("end") - F.col("start")) >= 6 * least).select("binary_id", "start", "end")
    return rows.select("binary_id", F.explode(F.sequence(F.col("start"), F.col("end") - 6, F.lit(6).cast("long"))).alias("addr"))


def a64_addresses(words: DataFrame) -> DataFrame:
    """(binary_id, src, dst) of ADR and ADRP: 21 signed bits from the instruction, or in pages from its page."""
    w = F.col("word")
    raw = F.shiftright(w, 5).bitwiseAND(F.lit(0x7FFFF)) * 4 + F.shiftright(w, 29).bitwiseAND(F.lit(3))
    offset = F.when(raw >= 1 << 20, raw - (1 << 21)).otherwise(raw)
    page = F.col("addr") - F.pmod(F.col("addr"), F.lit(4096))
    dst = F.when(matches(w, A64_ADRP), page + offset * 4096).otherwise(F.col("addr") + offset)
    return words.where(matches(w, A64_ADR) | matches(w, A64_ADRP)).select("binary_id", F.col("addr").alias("src"), dst.alias("dst"))


def data_pointers(words: DataFrame, code: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(binary_id, src, dst): aligned words that hold an address inside the binary's code areas (binary_id, start, end)."""
    from ferrule.operators.ranges import range_join

    points = words.select("binary_id", F.col("addr").alias("src"), F.col("word").alias("dst"))
    return range_join(points, code, "dst", bucket, ("binary_id",)).select("binary_id", "src", "dst").distinct()


def gap_starts(images: DataFrame, gaps: DataFrame, bitness: Column | None = None) -> DataFrame:
    """(binary_id, addr): the first byte of each gap (binary_id, gap_start, gap_end) of x86 code that is no filler.

    Filler is read from the gap's start, token by token: bytes of ``X86_PADDING``, NOP instructions of any length by their
    encoding, and ``X86_IDLE``, the longest first, unless it is the patch place that opens a function of 32-bit images. A
    token may end behind the gap. ``bitness`` is a column of ``images``; without it, images count as 32-bit ones.
    Each token starts where the last one ended, so the scan takes no more room however long the filler is.
    """
    held = gaps.join(images, "binary_id")
    at, size = (F.col("gap_start") - F.col("base")).cast("int"), (F.col("gap_end") - F.col("gap_start")).cast("int")
    # filler is judged by whole instructions, of which none is longer than 15 bytes
    code = F.hex(F.substring("image", at + 1, size + 14))
    tokens = lambda wide: F.regexp_extract_all(code, F.lit(_filler(wide)), F.lit(0))
    narrow = F.lit(True) if bitness is None else F.coalesce(bitness != 64, F.lit(True))
    skipped = F.aggregate(F.when(narrow, tokens(False)).otherwise(tokens(True)), F.lit(0), lambda n, t: n + F.length(t)) / 2
    there = F.least(size, F.octet_length("image") - at)
    found = held.where(at >= 0).withColumns({"_skip": skipped.cast("long"), "_n": there.cast("long")}).where("_skip < _n")
    return found.select("binary_id", (F.col("gap_start") + F.col("_skip")).cast("long").alias("addr"))


def _filler(wide: bool) -> str:
    """One token of filler, in digits, behind the last one; ``wide`` for 64-bit images, which have a prefix more."""
    # operand bytes of 0F 1F by its second byte: register, plain memory, scaled index, with 1 or 4 bytes of displacement
    operand = "[C-F].|[0-3][^45CD]|[0-3][5D].{8}|[0-3][4C].(?:[^5D]|[5D].{8})|[4-7][^4C]..|[4-7][4C].{4}|[89AB][^4C].{8}|[89AB][4C].{10}"
    nop = f"(?:66|2E|26|36|3E|64|65){{0,12}}{'(?:4.)?' if wide else ''}0F1F(?:{operand})|(?:66){{1,14}}90"
    idle = "|".join(sorted(X86_IDLE, key=len, reverse=True))
    guard = "" if wide else f"(?!{'|'.join(X86_PATCH_PLACES)})"
    return f"\\G(?:(?:{'|'.join(X86_PADDING)}){{1,4096}}+|{nop}|{guard}(?:{idle}))"


def landing_pads(words: DataFrame) -> DataFrame:
    """(binary_id, addr) of BTI instructions, which mark targets of indirect branches."""
    return words.where(matches(F.col("word"), (0xFFFFFF3F, 0xD503241F))).select("binary_id", "addr")

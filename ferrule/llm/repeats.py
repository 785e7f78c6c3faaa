"""Repeated strings: every byte under a string of ``LENGTH`` bytes that also starts earlier is found and removed.

Suffixes are brought together by content, not by document. Each window of ``LENGTH`` bytes names its anchor, the
``GRAM``-byte string in it with the least hash (leftmost on ties), so equal windows anywhere name equal anchors at
equal offsets. Consecutive windows with one anchor are a segment, about ``LENGTH`` / 2 windows. Segments shuffle by
anchor; those equal to an earlier segment are copies whole. Of the others, anchors with several different segments
remain: around the edges of repeats. Their bytes come together by anchor, and the enhanced suffix array over them (the
sorted windows, with the depth to which neighbours agree) is scanned with a stack into its intervals of common
prefixes; an interval lists all its occurrences, and diversity of the bytes to the left tells maximal repeats. At depth
``LENGTH`` the first occurrence of each interval stays and the others are removed.

Anchors with more than ``HOT`` different segments do not meet in one task: their windows' hashes are aggregated
instead, with partial sums before the shuffle.

Order is (doc_id, place). Edge cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; matches never
cross documents; rows that agree in id and text are one document, of one id with several texts each is one, ordered by
place and then by a CRC of the text; a null id sorts first; texts of any length are scanned whole, in slices that
overlap by ``LENGTH`` - 1; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrule.llm.common import bounded_batches, stage_table, table
from ferrule.llm.hashing import U64, mix, power_tables

LENGTH, GRAM = 100, 20
GRAMS = LENGTH - GRAM + 1
SLICE = 1 << 20
HOT = 4096
#: Bytes of segments that a task sorts at a time.
HELD = 2 << 20
_PLACE = U64((1 << 24) - 1)


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(data: bytes) -> dict[str, np.ndarray]:
    """Anchor hash, content hash, start, size of each segment of the text; a segment holds size - LENGTH + 1 windows."""
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), SLICE):
        raw = np.frombuffer(data, np.uint8)[at : at + SLICE + LENGTH - 1]
        sums, down = _prefix_sums(raw)
        n = len(raw) - GRAM + 1
        grams = mix((sums[GRAM:] - sums[:n]) * down[:n])
        place = np.arange(n, dtype=np.uint64)
        anchor = (_sliding_min((grams & ~_PLACE) | place, GRAMS) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(first, len(anchor))) + LENGTH - 1
        spot = anchor[first]
        content = mix((sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64) * U64(256) + (spot - first).astype(np.uint64))
        parts.append((grams[spot], content, first + at, size))
    if not parts:
        none = np.empty(0, np.int64)
        return {"anchor": none, "content": none, "start": none, "size": none}
    anchor, content, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    return {"anchor": anchor.view(np.int64), "content": content.view(np.int64), "start": start, "size": size}


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of all documents. Those equal to an earlier one of their batch are known to be copies (``copy``)."""
    for batch in batches:
        rows = []
        known, idents = batch["known"].to_numpy(bool), batch["ident"].to_numpy(np.int64)
        for k, text in enumerate(batch["text"]):
            data = (text or "").encode()
            got = segments(data)
            if n := len(got["start"]):
                spot = got["start"] << 32 | zlib.crc32(data)
                rows.append((np.full(n, idents[k]), np.full(n, known[k]), got["anchor"], got["content"], spot, got["size"]))
        if not rows:
            continue
        ident, known, anchor, content, spot, size = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((spot, ident, known, content))
        opens = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        first = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
        copy = np.empty(len(order), bool)
        copy[order] = (ident[order] != ident[first]) | (known[order] != known[first]) | (spot[order] != spot[first])
        yield pd.DataFrame(
            {"known": known, "ident": ident, "anchor": anchor, "content": content, "spot": spot, "size": size, "copy": copy}
        )


def _classified(docs: DataFrame) -> DataFrame:
    """Segments that matter: copies of earlier ones, and first ones whose anchor has several different segments.

    The columns: known, ident, crc (of the text), start, size, anchor, leads, and whether the anchor is hot. What is known to
    be a copy does not meet its anchor's other segments, so they are as many as batches and different segments at most.
    """
    rows = docs.mapInPandas(
        _scan, "known boolean, ident long, anchor long, content long, spot long, size int, copy boolean"
    )
    here = F.struct("known", "ident", "spot")
    rows = rows.withColumn("place", F.when(F.col("copy"), F.xxhash64("known", "ident", "spot")).otherwise(F.col("anchor")))
    same, all_ = Window.partitionBy("place", "copy", "content"), Window.partitionBy("place", "copy")
    # one shuffle serves all three windows
    rows = rows.repartition("place").withColumns(
        {
            "leads": ~F.col("copy") & here.eqNullSafe(F.min(here).over(same)),
            "several": F.min("content").over(all_) != F.max("content").over(all_),
        }
    )
    rows = rows.where("not leads or several").withColumn("hot", F.count_if("leads").over(all_) > HOT)
    return rows.select(
        "known",
        "ident",
        F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).alias("crc"),
        F.shiftright("spot", 32).cast("int").alias("start"),
        "size",
        "anchor",
        "leads",
        "hot",
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(known, ident, text): ids without nulls, which pandas would turn into floats; unknown ids sort first."""
    return docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("ident"), F.coalesce("text", F.lit("")).alias("text")
    )


def _with_texts(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """Texts beside what is known of them; documents are told by id and CRC."""
    return docs.withColumn("crc", F.crc32("text")).join(per_doc, ["known", "ident", "crc"], how)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the first segments of anchors that are not hot; of hot ones, hash and start of each window."""
    for batch in batches:
        out = []
        for known, ident, crc, text, parts in zip(*(batch[c] for c in ("known", "ident", "crc", "text", "parts")), strict=True):
            data = text.encode()
            for p in parts:
                piece = data[p["start"] : p["start"] + p["size"]]
                if not p["hot"]:
                    out.append((p["anchor"], known, ident, crc, p["start"], piece))
                    continue
                sums, down = _prefix_sums(np.frombuffer(piece, np.uint8))
                n = len(piece) - LENGTH + 1
                names = mix((sums[LENGTH:] - sums[:n]) * down[:n]).view(np.int64)
                out += [(int(h), known, ident, crc, p["start"] + i, None) for i, h in enumerate(names)]
        yield pd.DataFrame(out, columns=["key", "known", "ident", "crc", "start", "piece"])


def lcp_intervals(depths: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of common prefixes of at least ``least`` bytes in a suffix array.

    ``depths[i]``: bytes on which suffix i agrees with the one before it. The stack holds the open intervals, deepest on
    top; a smaller depth closes them.
    """
    found, stack = [], []
    for i in range(1, len(depths) + 1):
        depth, left = (int(depths[i]) if i < len(depths) else -1), i - 1
        while stack and depth < stack[-1][0]:
            top, left = stack.pop()
            if top >= least:
                found.append((top, left, i - 1))
        if depth >= 0 and (not stack or depth > stack[-1][0]):
            stack.append((depth, left))
    return found


class Occurrences:
    """The enhanced suffix array of some pieces: windows of ``LENGTH`` bytes in order, and how deep neighbours agree."""

    def __init__(self, pieces: list[bytes]):
        text = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counts = sizes - LENGTH + 1
        self.piece = np.repeat(np.arange(len(pieces)), counts)
        self.inside = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        at = base[self.piece] + self.inside
        sums, down = _prefix_sums(text)
        names = mix((sums[at + LENGTH] - sums[at]) * down[at])
        _, name, seen = np.unique(names, return_inverse=True, return_counts=True)
        again = np.flatnonzero(seen[name] > 1)  # a window that occurs once is in no interval of this depth
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at[again]] if len(again) else np.empty((0, LENGTH), np.uint8)
        order = np.argsort(np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel(), kind="stable") if len(again) else again
        windows, self.order = windows[order], again[order]
        self.depths = np.zeros(len(order), np.int64)
        if len(order) > 1:
            differ = windows[1:] != windows[:-1]
            self.depths[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        # the byte to the left; where a piece starts it is not known, and counts as different from all
        left = np.where(self.inside > 0, text[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
        self.left = left[self.order]

    def groups(self) -> list[tuple[np.ndarray, bool]]:
        """Per interval all its occurrences (window numbers), and whether the bytes to their left differ: maximal repeats."""
        found = []
        for _, first, last in lcp_intervals(self.depths, LENGTH):
            found.append((self.order[first : last + 1], len(set(self.left[first : last + 1].tolist())) > 1))
        return found


def _later_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of windows that occur earlier. Rows come sorted by anchor; a block ends where an anchor does."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        array = Occurrences(list(rows["piece"]))
        start = rows["start"].to_numpy()
        # the rank of each piece's document, and of its id alone, unknown ids first
        rank = rows.groupby(["known", "ident", "crc"], sort=True).ngroup().to_numpy()
        ident = rows.groupby(["known", "ident"], sort=True).ngroup().to_numpy()
        later = []
        for windows, _ in array.groups():
            piece = array.piece[windows]
            place = start[piece] + array.inside[windows]
            order = np.lexsort((rank[piece], place, ident[piece]))
            first = order[0]
            same = (rank[piece] == rank[piece[first]]) & (place == place[first])
            later.append(windows[~same])
        if not later:
            return pd.DataFrame({c: [] for c in ("known", "ident", "crc", "start", "size")})
        gone = np.unique(np.concatenate(later))
        piece, inside = array.piece[gone], array.inside[gone]
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(piece) != 0) | (np.diff(inside) != 1)]))
        count = np.diff(np.append(opens, len(gone)))
        own = rows.iloc[piece[opens]]
        return pd.DataFrame(
            {c: own[c].to_numpy() for c in ("known", "ident", "crc")} | {"start": start[piece[opens]] + inside[opens], "size": count + LENGTH - 1}
        )

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch["piece"].map(len).sum())
        if size >= HELD:
            rows = pd.concat(held, ignore_index=True)
            last = rows["key"].iloc[-1]
            ready = rows[rows["key"] != last]
            if len(ready):
                yield solve(ready.reset_index(drop=True))
                held = [rows[rows["key"] == last]]
                size = int(held[0]["piece"].map(len).sum())
    if held:
        yield solve(pd.concat(held, ignore_index=True))


_RUNS = "known boolean, ident long, crc long, start long, size long"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(known, ident, crc, spans): per keyed document with repeats, the starts and sizes of strings that also start earlier."""
    marked = stage_table(_classified(docs), "segments")
    leaders = marked.where("leads").groupBy("known", "ident", "crc").agg(F.collect_list(F.struct("start", "size", "anchor", "hot")).alias("parts"))
    edges = _with_texts(docs, leaders, "inner").mapInPandas(_edges, "key long, known boolean, ident long, crc long, start long, piece binary")
    edges = stage_table(edges, "edges")
    met = edges.where("piece is not null").repartition("key").sortWithinPartitions("key").mapInPandas(_later_windows, _RUNS)
    windows = edges.where("piece is null").select("key", "known", "ident", "crc", "start").distinct()
    here = F.struct("known", "ident", "start", "crc")
    firsts = windows.groupBy("key").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = windows.join(firsts, "key").where(~here.eqNullSafe(F.col("first"))).select("known", "ident", "crc", "start", F.lit(LENGTH).cast("long").alias("size"))
    copies = marked.where("not leads").select("known", "ident", "crc", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))
    runs = copies.unionByName(met).unionByName(hot)
    return runs.groupBy("known", "ident", "crc").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes under sorted spans."""
    out: list[tuple[int, int]] = []
    for s in spans if spans is not None else ():
        start, end = s["start"], s["start"] + s["size"]
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the maximal removed runs and the bytes that remain, per row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for known, ident, text, spans in zip(*(batch[c] for c in ("known", "ident", "text", "spans")), strict=True):
                data, runs = text.encode(), _merged(spans)
                cuts = [0, *[x for r in runs for x in r], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((known, ident, len(data), [{"start": a, "end": b} for a, b in runs], kept))
            yield pd.DataFrame(out, columns=["known", "ident", "n_bytes", "removed", "kept"])

    bounded_batches(docs.sparkSession)
    rows = _keyed(docs)
    joined = _with_texts(rows, repeated_spans(rows), "left")
    found = joined.mapInPandas(run, "known boolean, ident long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return found.select(F.when(F.col("known"), F.col("ident")).alias("doc_id"), "n_bytes", "removed", "kept")


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 100 bytes from all ``documents``."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: dict[int, str]) -> dict[int, tuple[int, int, int, str]]:
    """What ``op6_repeats`` must return, from a dictionary of all windows; for tests."""
    seen: set[bytes] = set()
    out = {}
    for ident in sorted(texts):
        data = texts[ident].encode()
        gone = np.zeros(len(data) + 1, np.int8)
        for i in range(len(data) - LENGTH + 1):
            window = data[i : i + LENGTH]
            if window in seen:
                gone[i : i + LENGTH] = 1
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[gone[:-1] == 0])
        out[ident] = (len(data), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out

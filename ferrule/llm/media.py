"""Media columns in Matroska: EBML elements, clusters, lacing and cues, read into packet tables.

``packet_table`` reads a binary column into one row per packet: track, timestamp, keyframe, cluster, block, place in
the lace and byte range in the file. ``store_texts`` writes texts as one mono 8-bit PCM track: the UTF-8 bytes, filled
up with spaces to a positive multiple of ``UNIT``, are the samples. ``read_payloads`` goes back from the stored bytes.

Edge cases: null and empty texts store ``UNIT`` spaces; texts of any length are stored whole, in as many clusters as
they take; a file is a pure function of its text, so repeated texts give equal files; a null or broken file gives no
packets beyond the last whole block and its fault in ``fault``; empty tables give empty results; further columns are
carried unless they bear the name of an output.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrule.llm.common import bounded_batches, table

#: Fixed element IDs of the container format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, FLAG_LACING, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE_BLOCK, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0xFB, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS))
#: Elements beside and above clusters: any of them ends a body of unknown size, of a segment only the top ones.
TOP = frozenset((EBML, SEGMENT))
OUTER = TOP | {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
ENDS = {SEGMENT: TOP, BLOCK_GROUP: OUTER | {BLOCK_GROUP, SIMPLE_BLOCK, CLUSTER_TIMESTAMP}}
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 2, 4, 6

#: Layout of stored texts: bytes of a unit, of a packet; packets of a block; blocks of a cluster; samples a second.
UNIT, PACKET, LACE, BLOCKS, RATE = 192, 960, 8, 30, 8_000
PACKET_MS = 1000 * PACKET // RATE
#: Rows that a task hands on at a time.
ROWS = 512


class Packet(NamedTuple):
    track: int
    timestamp: int
    keyframe: bool
    cluster: int
    block: int
    lace: int
    offset: int
    size: int


# --- variable-length numbers


def vint(value: int, width: int = 0) -> bytes:
    """A size: the count of leading zero bits tells the bytes that follow; all ones is kept for 'unknown'."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int, bool]:
    """(value without its marker, position behind, whether it says 'unknown')."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return value, at + width, value == (1 << 7 * width) - 1


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


# --- writing


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def xiph_sizes(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])


def ebml_sizes(sizes: list[int]) -> bytes:
    """The first size, then signed differences, each shifted into the range of its width."""
    out = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while not -(half := (1 << 7 * width - 1) - 1) <= b - a <= half:
            width += 1
        out.append((b - a + half | 1 << 7 * width).to_bytes(width, "big"))
    return b"".join(out)


def laced_block(track: int, relative: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    """A SimpleBlock of key frames; equal sizes need none written, others go as EBML differences."""
    sizes = [len(f) for f in frames]
    if lacing is None:
        lacing = NO_LACE if len(frames) == 1 else FIXED_LACE if len(set(sizes)) == 1 else EBML_LACE
    head = vint(track) + struct.pack(">hB", relative, 0x80 | lacing)
    if lacing != NO_LACE:
        head += bytes([len(frames) - 1])
        head += {XIPH_LACE: xiph_sizes, EBML_LACE: ebml_sizes}.get(lacing, lambda _: b"")(sizes)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def header(duration_ms: float) -> tuple[bytes, bytes]:
    """The EBML header, and the segment's information with its one PCM track."""
    top = element(
        EBML,
        number(EBML_VERSION, 1)
        + number(EBML_READ_VERSION, 1)
        + number(EBML_MAX_ID, 4)
        + number(EBML_MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska")
        + number(DOC_TYPE_VERSION, 4)
        + number(DOC_TYPE_READ_VERSION, 2),
    )
    info = element(
        INFO,
        number(TIMESTAMP_SCALE, 1_000_000)
        + element(DURATION, struct.pack(">d", duration_ms))
        + element(MUXING_APP, b"ferrule")
        + element(WRITING_APP, b"ferrule"),
    )
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = (
        number(TRACK_NUMBER, 1)
        + number(TRACK_UID, 1)
        + number(TRACK_TYPE, 2)
        + number(FLAG_LACING, 1)
        + number(DEFAULT_DURATION, PACKET_MS * 1_000_000)
        + element(CODEC_ID, b"A_PCM/INT/LIT")
        + audio
    )
    return top, info + element(TRACKS, element(TRACK_ENTRY, entry))


def mux(payload: bytes) -> bytes:
    """A file whose one track holds the payload's bytes as samples."""
    top, start = header(1000 * len(payload) / RATE)
    parts, cues, at = [start], [], len(start)
    span = PACKET * LACE
    for base in range(0, len(payload), span * BLOCKS):
        time = base // PACKET * PACKET_MS
        blocks = [number(CLUSTER_TIMESTAMP, time)]
        for first in range(base, min(base + span * BLOCKS, len(payload)), span):
            frames = [payload[i : i + PACKET] for i in range(first, min(first + span, len(payload)), PACKET)]
            blocks.append(laced_block(1, first // PACKET * PACKET_MS - time, frames))
        cluster = element(CLUSTER, b"".join(blocks))
        spot = element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + spot))
        parts.append(cluster)
        at += len(cluster)
    return top + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# --- reading


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(ID, start and end of the body), depth first; bodies of unknown size reach to the next element of their own or a
    higher level at most, which their end as given does not know yet."""
    held: list[tuple[int, frozenset]] = [(end, frozenset())]  # end of each open master, and what ends it before
    while at < end:
        while at >= held[-1][0]:
            held.pop()
        ident, at = read_id(data, at)
        while ident in held[-1][1]:
            held.pop()
        size, at, unknown = read_vint(data, at)
        stop = held[-1][0] if unknown else at + size
        if stop > held[-1][0]:
            raise ValueError(f"element {ident:x} at byte {at} is cut off")
        yield ident, at, stop
        if ident in MASTERS:
            held.append((stop, ENDS.get(ident, OUTER | {ident}) if unknown else frozenset()))
        else:
            at = stop


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first one starts."""
    if lacing == NO_LACE:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == FIXED_LACE:
        if (end - at) % count:
            raise ValueError(f"a lace at byte {at} does not divide into {count} equal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == XIPH_LACE:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            began = at
            value, at, _ = read_vint(data, at)
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - began) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"a lace at byte {at} is longer than its block")
    return sizes, at


class Parsed:
    """Packets, cues (time, track, place of the cluster in the segment), count of clusters, start of the segment."""

    def __init__(self) -> None:
        self.packets: list[Packet] = []
        self.cues: list[tuple[int, int, int]] = []
        self.clusters = self.segment = 0
        self.fault: str | None = None


def demux(data: bytes) -> Parsed:
    got = Parsed()
    time, block, entry, lasting, cue, group = 0, -1, None, None, [0, 0], 0
    frame_ns: dict[int, int] = {}
    parts: list[list[int]] = [[0, 1_000_000]]  # first packet and nanoseconds of a tick, per segment
    later: list[int] = []  # nanoseconds of each packet behind its block
    try:
        for ident, at, end in elements(data, 0, len(data)):
            if ident == SEGMENT:
                got.segment = at
                parts.append([len(got.packets), 1_000_000])
            elif ident == TIMESTAMP_SCALE:
                parts[-1][1] = int.from_bytes(data[at:end], "big")
            elif ident == TRACK_ENTRY:
                entry, lasting = None, None
            elif ident in (TRACK_NUMBER, DEFAULT_DURATION):  # in either order
                if ident == TRACK_NUMBER:
                    entry = int.from_bytes(data[at:end], "big")
                else:
                    lasting = int.from_bytes(data[at:end], "big")
                if entry is not None and lasting is not None:
                    frame_ns[entry] = lasting
            elif ident == CUE_POINT:
                cue = [0, 0]
            elif ident == CUE_TRACK_POSITIONS:
                cue[1] = 0
            elif ident == CLUSTER:
                got.clusters += 1
            elif ident == CLUSTER_TIMESTAMP:
                time = int.from_bytes(data[at:end], "big")
            elif ident == BLOCK_GROUP:
                group = len(got.packets)
            elif ident == REFERENCE_BLOCK:
                got.packets[group:] = [p._replace(keyframe=False) for p in got.packets[group:]]
            elif ident in (SIMPLE_BLOCK, BLOCK):
                block += 1
                track, spot, _ = read_vint(data, at)
                relative, flags = struct.unpack_from(">hB", data, spot)
                sizes, spot = lace_sizes(data, spot + 3, end, flags & 6)
                for k, size in enumerate(sizes):
                    later.append(k * frame_ns.get(track, 0))
                    got.packets.append(
                        Packet(track, time + relative, ident == BLOCK or flags >= 128, got.clusters - 1, block, k, spot, size)
                    )
                    spot += size
                if ident == SIMPLE_BLOCK:
                    group = len(got.packets)
            elif ident == CUE_TIME:
                cue[0] = int.from_bytes(data[at:end], "big")
            elif ident == CUE_TRACK:
                cue[1] = int.from_bytes(data[at:end], "big")
            elif ident == CUE_CLUSTER_POSITION:
                got.cues.append((cue[0], cue[1], int.from_bytes(data[at:end], "big")))
    except (ValueError, IndexError, struct.error) as e:
        got.fault = str(e)
    # the scale of a segment may stand behind its clusters
    for (first, scale), (last, _) in zip(parts, [*parts[1:], [len(got.packets), 0]], strict=True):
        for i in range(first, last):
            p = got.packets[i]
            got.packets[i] = p._replace(timestamp=(p.timestamp * scale + later[i]) // 1_000_000)
    return got


PACKET_SCHEMA = [
    T.StructField("track", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("keyframe", T.BooleanType()),
    T.StructField("cluster", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("lace", T.LongType()),
    T.StructField("byte_offset", T.LongType()),
    T.StructField("byte_size", T.LongType()),
    T.StructField("fault", T.StringType()),
]


def packet_table(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per packet of each file, with the file's id and fault; files without packets give no rows, and their
    faults stand in ``read_payloads``."""
    bounded_batches(files.sparkSession)
    arrow = to_arrow_schema(T.StructType(PACKET_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("media").to_pylist()):
                got = demux(data or b"")
                if not got.packets:
                    continue
                columns = [pa.array(c, t) for c, t in zip(zip(*[(*p, got.fault) for p in got.packets], strict=True), arrow.types, strict=True)]
                ids = batch.column("file_id").take(pa.array(np.full(len(got.packets), i)))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["file_id", *arrow.names])

    source = files.select(F.col(id_col).alias("file_id"), F.col(media_col).alias("media"))
    return source.mapInArrow(run, T.StructType([source.schema["file_id"], *PACKET_SCHEMA])).withColumnRenamed("file_id", id_col)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes filled up with spaces, and their count without the filling."""
    data = (text or "").encode()
    return data + b" " * (UNIT * max(1, -(-len(data) // UNIT)) - len(data)), len(data)


def _mapped(df: DataFrame, column: str, made: dict[str, T.DataType], make, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``make(value of column)`` as further columns (or None: null); all others pass as they are."""
    bounded_batches(df.sparkSession)
    rest = df.drop(*[c for c in made if c != column and c in df.columns])
    kept = [f for f in rest.schema if f.name != column]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in made.items()]])
    arrow = to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in made.items()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                rows = [make(v) for v in part.column(column).to_pylist()]
                new = [pa.array([r[n] for r in rows], arrow.field(n).type) for n in made]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *new], [*[f.name for f in kept], *made])

    return rest.mapInArrow(run, schema)


_STORED = {"n_bytes": T.LongType(), "media": T.BinaryType()}
_READ = {n: T.LongType() for n in ("payload_bytes", "tail_crc32", "media_bytes")} | {
    n: T.StringType() for n in ("payload_sha256", "media_sha256", "feature", "fault")
}


def stored(text: str | None) -> dict:
    payload, n = payload_of(text)
    return {"n_bytes": n, "media": mux(payload)}


def measured(data: bytes | None) -> dict:
    """What a stored file holds, read back from its bytes."""
    data = data or b""
    got = demux(data)
    payload = b"".join(data[p.offset : p.offset + p.size] for p in got.packets)
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    mark = CLUSTER.to_bytes(4, "big")
    found = sum(data.startswith(mark, got.segment + at) for _, _, at in got.cues)  # cues that lead to a cluster
    turns = int(np.count_nonzero(np.diff(np.signbit(x - int(x.mean()) if len(x) else x))))
    feature = (
        f"packets={len(got.packets)};clusters={got.clusters};cues={found};ms={1000 * len(payload) // RATE};"
        f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={turns}"
    )
    return {
        "payload_bytes": len(payload),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(data),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": feature,
        "fault": got.fault,
    }


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with n_bytes and the Matroska file that stores it."""
    return _mapped(docs, text_col, _STORED, stored)


def read_payloads(files: DataFrame, media_col: str = "media") -> DataFrame:
    """``files`` without the file but with its payload read back, digests, features of the samples and any fault."""
    return _mapped(files, media_col, _READ, measured)


def stored_and_read(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``read_payloads(store_texts(docs))`` in one worker: every file is written, then read from its bytes alone."""

    def both(text: str | None) -> dict:
        file = stored(text)
        return {"n_bytes": file["n_bytes"]} | measured(file["media"])

    return _mapped(docs, text_col, {"n_bytes": T.LongType()} | _READ, both)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    """Store every whole text of ``documents`` as Matroska and digest what is read back from the stored bytes."""
    return stored_and_read(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )

"""Near-duplicates by SimHash fingerprints and an inverted index over their byte positions.

A fingerprint bit is set if more than half of the hashes of a text's word shingles (repeats included) have it. Two
fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at least four
positional bytes. The index lists fingerprints under three of their positional bytes at a time, for a system of triples
of which any four positions contain one: what shares four bytes meets in a list. Where two meet, the positional bytes
they share are tallied, pairs below the guaranteed four are dropped, and the rest is verified bit by bit. A list hands on
links that connect what it connects, a tree per connected part, never all its pairs. Equal texts are one fingerprint
before anything is listed.

Lists of more than ``LONG`` fingerprints are not gathered. Two fingerprints within four bits of each other have one
between them that is at most two bits from either, and all that lie within two bits of one value are linked with each
other: members of long lists are dealt to the 2,081 values around each, and every value links its members to the least.
That takes work in proportion to the members, and finds exactly the same components.

Edge cases: null and empty texts, and those without words, have fingerprint zero and are linked like any other; shorter
texts are one shingle; texts of any length are hashed in pieces of whole words; repeated rows and equal texts share a
fingerprint, and each row is returned; ids may be of any type that has an order; rows without an id get the least id of
their component, which is null if no member has one; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import bounded_batches, stage_table, table
from ferrule.llm.graphs import components

#: Seed of XXH64, most differing bits, bytes of a fingerprint, and bytes that linked ones share at least.
SEED, BITS, BYTES = 42, 4, 8
SHARED = BYTES - BITS
#: Members of a list that one task compares.
LONG = 1 << 14
#: Fingerprints with more than this share of all rows (so fewer than 1,000) are joined by broadcast.
HOT = 1000
#: Bytes of a text that are split at a time, shingles that are counted at a time.
PIECE, COUNTED = 1 << 20, 1 << 15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def covering_triples() -> list[tuple[int, ...]]:
    """20 triples of the 8 byte positions such that any 4 positions contain one: positions fall into three groups, and a
    triple lies in one group, or has two in one group and one in the next."""
    group = [i * 3 // BYTES for i in range(BYTES)]

    def kept(t: tuple[int, ...]) -> bool:
        held = [sum(group[i] == g for i in t) for g in range(3)]
        return 3 in held or any(held[g] == 2 and held[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(BYTES), 3) if kept(t)]


TRIPLES = covering_triples()
_ONE = [1 << i for i in range(64)]
#: All values of at most two set bits.
_AROUND = np.array([0, *_ONE, *[a | b for a, b in combinations(_ONE, 2)]], dtype=np.uint64)


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, a piece at a time; pieces end at a space."""
    at = 0
    while len(data) - at > 2 * PIECE:
        spaces = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, PIECE, at + PIECE)])
        if not len(spaces):  # one word of more than a piece: take the rest at once
            break
        end = at + PIECE + int(spaces[0])
        yield data[at:end].translate(_LOWER).split()
        at = end
    yield data[at:].translate(_LOWER).split()


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = hashes[i : i + COUNTED].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes | None, words: int = 4) -> int:
    """The fingerprint of a text given as UTF-8, unsigned."""
    bits, n, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in _word_blocks(data or b""):
        said = carried + block
        if len(said) >= words:
            ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            line, m = b" ".join(said), len(said) - words + 1
            spans = zip(starts[:m].tolist(), ends[words - 1 :].tolist(), strict=True)
            bits += _set_bits(np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, m))
            n += m
            said = said[m:]  # the last words start shingles that go on in the next piece
        carried = said
    if not n and carried:
        return digest(b" ".join(carried), SEED)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            made = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """(list, fp): each fingerprint under every triple of its positional bytes; a list is named by places and bytes."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(255))
    names = [F.lit(k << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for k, (a, b, c) in enumerate(TRIPLES)]
    return fps.select("fp", F.explode(F.array(*[n.cast("long") for n in names])).alias("list"))


def _near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of the others share enough positional bytes with ``one`` and, verified, differ in few enough bits."""
    apart = one ^ others
    tally = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = tally >= SHARED
    near[near] = np.bitwise_count(apart[near]) <= BITS
    return near


def _trees(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what the members' pairs join: each member found is linked to the one that found it."""
    links, rest = [], members
    while len(rest) > 1:
        found, rest = [rest[0]], rest[1:]
        while found and len(rest):
            one = found.pop()
            near = _near(one, rest)
            if near.any():
                new = rest[near]
                links.append((np.full(len(new), one), new))
                found.extend(new)
                rest = rest[~near]
    return links


def _pairs(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = [np.empty(0, np.uint64)]
    a, b = (np.concatenate([x[i] for x in links] or none).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("members")
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        yield _pairs([x for s, e in zip(ends[:-1], ends[1:], strict=True) for x in _trees(np.sort(values[s:e]))])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fps), 64):
            part = fps[i : i + 64]
            between = np.bitwise_xor.outer(part, _AROUND).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(between.view(np.int64)), pa.array(np.repeat(part, len(_AROUND)).view(np.int64))], ["mid", "fp"])


def links(fps: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b): links among distinct fingerprints (fp) that connect all that lie within ``BITS`` bits of each other."""
    held = stage_table(postings(fps), "postings")
    sizes = held.groupBy("list").agg(F.count("*").alias("m")).where("m > 1")
    held = stage_table(held.join(sizes, "list"), "lists")
    short = held.where(F.col("m") <= long).groupBy("list").agg(F.collect_list("fp").alias("members"))
    found = short.select("members").mapInArrow(_list_links, "a long, b long")
    lengthy = held.where(F.col("m") > long).select("fp").distinct()
    if not lengthy.isEmpty():
        around = lengthy.mapInArrow(_around, "mid long, fp long")
        least = around.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("m")).where("m > 1").select("mid", "b")
        found = found.unionByName(around.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return found.distinct()


def simhash_components(docs: DataFrame, words: int = 4, long: int = LONG) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text); component_id is the least id reachable."""
    bounded_batches(docs.sparkSession)
    rows = stage_table(fingerprints(docs, words), "fingerprints")
    fps = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    comps = components(links(fps.select("fp"), long))
    named = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stage_table(named.join(ids, "component").select("fp", "component_id", "n"), "components")
    total = known.agg(F.sum("n")).first()[0] or 0
    # copies of one text are one key of this join: those with a thousandth of all rows or more go by broadcast
    hot = F.broadcast(known.where(F.col("n") * HOT >= total).drop("n"))
    cold = known.where(F.col("n") * HOT < total).drop("n")
    return rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(cold, "fp")).select("doc_id", "fp", "component_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles of ``documents``; fingerprints link at four or fewer differing bits, exactly."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""SimHash fingerprints and components against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
import xxhash

from ferrule.llm import simhash
from ferrule.llm.simhash import TRIPLES, covering_triples, fingerprint, op13_simhash, simhash_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, words=4):
    said = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(said[i : i + words]) for i in range(max(1, len(said) - words + 1))] if said else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_ids(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    parts = {}
    for i, x in enumerate(ids):
        parts.setdefault(find(i), []).append(x)
    return [min((x for x in parts[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_any_four_positions_hold_a_triple():
    assert len(TRIPLES) == 20 and covering_triples() == TRIPLES
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in TRIPLES)


def test_fingerprints_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " \t".join(rng.choice(["Aa", "bB", "Çc", "d" * 70, "e", "ü", "."]) for _ in range(400)) + "\n"
    whole = plain(text)
    for piece in (8, 64, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "COUNTED", piece)
        assert fingerprint(text.encode()) == whole
        assert fingerprint(b"one" * 90) == plain("one" * 90)
        assert fingerprint(b"  Two  words ") == plain("two words")
    assert fingerprint(None) == fingerprint(b"") == fingerprint(b" \n") == 0


@pytest.mark.parametrize("long", [simhash.LONG, 3])
def test_components(spark, long):
    """Chains of copies, a few bits from one to the next; with ``long`` 3 most lists are worked off value by value."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 101, " ".join(copy)))
            base = copy if k % 2 else base
    rows += [(None, rows[0][1]), (rows[3][0], rows[3][1]), (500, None), (501, ""), (502, " "), (None, "alone"), (1 << 60, "ALONE")]
    found = simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), long=long).collect()
    fps = [plain(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], fps, least_ids([i for i, _ in rows], fps)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == want


def test_empty_table_and_ids_of_other_types(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string, fp int")).collect() == []
    rows = [("b", "some words", 1), ("a", "Some words", 2)]
    found = simhash_components(spark.createDataFrame(rows, "doc_id string, text string, fp int")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {("a", "a"), ("b", "a")}


def test_query(spark, sf):
    found = op13_simhash(spark, sf)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = found.collect()
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and len(rows) == len(docs)
    fps = [plain(docs[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == least_ids([r.doc_id for r in rows], fps)

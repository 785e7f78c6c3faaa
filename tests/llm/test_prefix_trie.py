"""The prefix trie against DuckDB's and against plain dictionaries."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.llm.prefix_trie import NONE, OP12_SQL, fattest, op12_prefix_trie, prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            text = text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(ts)] for c, ts in turns.items()}
    members, ends, words = {}, {}, {(): 0}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(first, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
            if d:
                words[path[:d]] = len(re.findall(r"[^\x20\x09-\x0D]+", path[d - 1][1]))
        ends.setdefault(path, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), *sums[p], digest))
    return out


def same(df, rows):
    assert df.columns == COLUMNS
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(brute(rows), key=str)
    assert got == want


def test_query(spark, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall()
    got = [tuple(r) for r in op12_prefix_trie(spark, sf).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("first", "together"), [(512, 4096), (4, 4096), (4, 3)])
def test_many_batches(spark, first, together):
    """Few texts, so that strings share long ways and end inside others; small batches split edges again and again."""
    rng = random.Random(first + together)
    rows = []
    for c in [*range(-30, 60), 1 << 60]:
        length = rng.choice([1, 2, 5, 5, 9, 17])
        stem = [("user", "to be"), ("assistant", "or  not")] * 9 if rng.random() < 0.7 else []
        for t in range(length):
            role, text = stem[t] if t < len(stem) and rng.random() < 0.93 else (rng.choice(["user", "a"]), rng.choice(["x", "y z", ""]))
            rows.append((c, t * 3, role, text))
    rng.shuffle(rows)
    same(prefix_nodes(spark.createDataFrame(rows, SCHEMA).repartition(3), first, together), rows)


def test_edge_cases(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"),
        (None, 1, "user", "nobody's"), (20, 5, "user", "long " * 50000), (33, 1, "user", "one"), (34, 1, "user", "one"), (34, 1, "user", "two"),
        (0, 1, "user", "a"),
    ]
    wide = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(7)).withColumn("words", F.lit("x"))
    same(prefix_nodes(wide), rows)


def test_turnless_conversations(spark):
    """An id whose family has no first conversation loses its opening; some are left without a turn."""
    rows = [(c, 0, "user", "hi") for c in range(21, 40)]
    found = prefix_nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.depth for r in found} == {0, 1} and all(r.ends_sha256 != NONE for r in found)
    same(prefix_nodes(spark.createDataFrame(rows, SCHEMA)), rows)
    bare = [(c, 0, "user", "hi") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    same(prefix_nodes(spark.createDataFrame(bare, SCHEMA)), bare)


def test_empty_table(spark):
    assert prefix_nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fattest(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    for r in spark.createDataFrame(pairs, "a int, b int").withColumn("f", fattest(F.col("a"), F.col("b"))).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)

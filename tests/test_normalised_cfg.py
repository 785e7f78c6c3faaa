"""Normalised control flow: against brute force on odd graphs, and dealt into parts whose number grows with the rows."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.operators import blocks, graph
from ferrule.plans import code_queries, escape_queries
from ferrule.plans.registry import ORACLES, QUERIES
from ferrule.session import staged


def expected(cut: list, edges: list, handlers: list) -> set:
    nodes, out = {(f, s) for f, s, _ in cut}, set()
    starts = {(f, s) for f, s, _ in cut if f is not None}
    out |= {(f, s, d) for f, s, d in edges if (f, s) in starts}
    for f, lo, hi, target in handlers:
        held = [s for g, s, e in cut if f is not None and g == f and target is not None and s <= target < e]
        dst = max(held, default=target)
        nodes.add((f, dst))
        out |= {(f, s, dst) for g, s, e in cut if f is not None and g == f and lo < e and s < hi}
    return out | {(f, s, None) for f, s in nodes if not any((f, s) == (g, t) for g, t, _ in out)}


def test_random_graphs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCKS", 20)
    rng, cut, edges, handlers = random.Random(5), [], [], []
    for f in [*range(40), None]:
        at = rng.sample(range(0, 80, 4), 6)
        cut += [(f, s, s + rng.choice((0, 2, 4))) for s in sorted(at)]
        edges += [(f, rng.choice([*at, 1, 90]), rng.choice([*at, 90, None])) for _ in range(rng.randrange(8))]
        handlers += [(f, lo := rng.randrange(80), lo + rng.randrange(20), rng.choice([*range(90), None])) for _ in range(rng.randrange(4))]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((cut, "fn long, start long, end long"), (edges * 2, "fn long, src long, dst long"), (handlers, "fn long, start long, end long, target long"))]
    found = graph.normalised_cfg(*frames, "fn")
    assert Counter(map(tuple, found.collect())) == Counter(expected(cut, edges, handlers))
    assert found.columns == ["fn", "src", "dst"]


def test_targets_of_other_functions_and_of_no_function_open_no_block(spark):
    code = spark.createDataFrame([(f, a, a == 4 or None) for f in (1, 2, None) for a in (0, 4, 8, 12, 16)], "fn long, addr long, ends boolean").withColumn("ends", F.col("ends").isNotNull())
    targets = spark.createDataFrame([(1, 12), (1, 12), (1, 14), (2, None), (None, 16)], "fn long, dst long")
    got = {(r.fn, r.addr): r.block for r in blocks.derive_blocks(code, targets, "fn", F.col("ends")).collect()}
    plain = {0: 0, 4: 0, 8: 8, 12: 8, 16: 8}
    assert got == {(f, a): b for f in (2, None) for a, b in plain.items()} | {(1, a): b for a, b in (plain | {12: 12, 16: 12}).items()}
    assert blocks.derive_blocks(code, targets, "fn", F.col("ends")).columns == ["fn", "addr", "ends", "block"]


@pytest.mark.parametrize("name", ["normalised_cfg", "cfg_roots"])
def test_parts_grow_with_lines(spark, tmp_path, monkeypatch, name):
    """No task sorts more than a part of the instructions or blocks, however well they compress."""
    monkeypatch.setattr(code_queries, "LINES", 100)
    monkeypatch.setattr(graph, "BLOCKS", 50)
    rng, stored = random.Random(7), []
    rows = [(rng.randrange(300), rng.randrange(1, 8), rng.randrange(50), rng.choice("ARN")) for _ in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(escape_queries, "staged", lambda df, folder: stored.append(staged(df, folder)) or stored[0])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    code = code_queries._code(spark, str(tmp_path))
    derived = plan(blocks.derive_blocks(code, code.where("ends"), "fn", F.col("ends")))
    assert derived.count(", 11), REPARTITION_BY_NUM") == derived.count("Exchange ") == 2
    found = QUERIES[name](spark, str(tmp_path))
    parts = 1 + stored[0].count() // 50
    assert parts > 4 and plan(found).count(f", {parts}), REPARTITION_BY_NUM") == plan(found).count("Exchange ") and "Broadcast" not in plan(found)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert Counter(map(tuple, found.collect())) == Counter(db.execute(ORACLES[name]).fetchall())

"""Components and nesting over every event, against brute force on a small table whose cycles close late."""

from __future__ import annotations

import random
from collections import defaultdict

from ferrule.operators import graph
from ferrule.plans.queries import nesting_depth, scc_per_function


def walk(edges: set, root, without=None) -> set:
    seen = {root} - {without}
    while more := {b for a, b in edges if a in seen and b != without} - seen:
        seen |= more
    return seen


def test_graphs_of_all_events_match_brute_force(spark, tmp_path):
    rng, rows = random.Random(3), []
    kinds = defaultdict(list)
    for user in range(30):
        kinds[user] = [f"k{n}" for n in range(8)] + [f"k{rng.randrange(8)}" for _ in range(user // 5)] * (1 + user % 2)
        rows += [(user, user * 100 + i, f"2024-01-01 00:00:{i:02d}", kind) for i, kind in enumerate(kinds[user])]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    scc = {(r.user_id, r.node): r.component for r in scc_per_function(spark, str(tmp_path)).collect()}
    deep = {r.user_id: r.nesting_depth for r in nesting_depth(spark, str(tmp_path)).collect()}
    assert len(scc) == 30 * 8 and len(deep) == 30
    for user, seq in kinds.items():
        edges, nodes = set(zip(seq, seq[1:])), set(seq)
        reach = {n: walk(edges, n) for n in nodes}
        assert all(scc[user, n] == min(m for m in reach[n] if n in reach[m]) for n in nodes)
        branched = {b for a, b in edges if len({d for s, d in edges if s == a}) > 1}
        doms = {n: {d for d in nodes if n not in walk(edges, seq[0], d)} for n in nodes}
        assert deep[user] == max(len(doms[n] & branched) for n in nodes)


def test_groups_hold_distinct_edges(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0)] * 500, "fn long, src long, dst long")
    for frame in (graph.scc(edges, "fn"), graph.nesting(edges, spark.createDataFrame([(1, 0)], "fn long, root long"), "fn")):
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [fn" in text and frame.count() in (1, 2)

"""Components and closures of large and of random graphs against plain searches."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from ferrule.operators import corpus_graph
from ferrule.operators.graph import components_of


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").repartition(3)


def want(edges):
    forward = defaultdict(set)
    for a, b in edges:
        forward[a].add(b)
    return components_of(forward, sorted({x for e in edges for x in e}))


def got(df):
    rows = df.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize(("nodes", "edges", "seed"), [(300, 380, 1), (200, 300, 2), (400, 900, 3)])
def test_random_graphs(spark, nodes, edges, seed):
    rng = random.Random(seed)
    made = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    assert got(corpus_graph.strong_components(frame(spark, made))) == want(made)


def test_long_cycle_chain_and_what_hangs_on_them(spark):
    n = 100_000
    made = [(i, i + 1) for i in range(n)] + [(n, 0)]  # one cycle
    made += [(n // 2, 2 * n)] + [(2 * n + i, 2 * n + i + 1) for i in range(1000)]  # a chain from it, to a cycle of two
    made += [(2 * n + 1000, 2 * n + 999), (5 * n, 5 * n)]
    found = got(corpus_graph.strong_components(frame(spark, made)))
    assert all(found[i] == 0 for i in range(n + 1))
    assert all(found[2 * n + i] == 2 * n + i for i in range(999)) and found[2 * n + 999] == found[2 * n + 1000] == 2 * n + 999
    assert found[5 * n] == 5 * n


def test_small_shapes(spark):
    made = [(1, 1), (2, 3), (3, 2), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8), (8, 7), (8, 9), (9, 10), (10, 7), (11, 12)]
    assert got(corpus_graph.strong_components(frame(spark, made + made))) == want(made)
    assert got(corpus_graph.strong_components(frame(spark, [(None, 1), (2, None)]))) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability(spark, seed):
    rng = random.Random(seed)
    made = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(100 + i, 101 + i) for i in range(40)]
    forward = defaultdict(set)
    for a, b in made:
        forward[a].add(b)
    expected = {}
    for start in list(forward):
        queue, seen = deque((b, 1) for b in forward[start]), {}
        while queue:
            node, depth = queue.popleft()
            if node not in seen:
                seen[node] = depth
                queue.extend((b, depth + 1) for b in forward.get(node, ()))
        expected |= {(start, b): d for b, d in seen.items()}
    assert {(r.src, r.dst): r.depth for r in corpus_graph.reachability(frame(spark, made)).collect()} == expected

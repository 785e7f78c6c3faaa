"""Whitening against numpy's singular vectors and exact whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from ferrule.llm.whitening import op11_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, component int"


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]


def check(rows, vectors, most=32):
    """``rows`` of whiten() for the vectors by id."""
    ids, x = list(vectors), [whole(v) for v in vectors.values()]
    n, totals = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = np.array([[(n * c - s) / n for c, s in zip(v, totals, strict=True)] for v in x])
    _, found, right = np.linalg.svd(off, full_matrices=False)  # an eigensolver on the squares would lose half the digits
    values, vec = found**2 / n, right.T
    size = min(most, len(values))
    assert len(rows) == n * size
    got = {(r.vec_id, r.component): r for r in rows}
    white = np.array([[got[i, k + 1].whitened for k in range(size)] for i in ids])
    want = off @ vec[:, :size] / np.sqrt(values[:size])
    assert np.abs(white - want * np.sign((white * want).sum(axis=0))).max() < 1e-8
    for i, v in zip(ids, x, strict=True):
        r = got[i, 1]
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(v, totals, strict=True))
    for k in range(size):
        assert math.isclose(got[ids[0], k + 1].explained, values[k] / values.sum(), rel_tol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(op11_whitening(spark, sf).collect(), vectors)


def test_nearly_dependent_dimensions(spark):
    rng = random.Random(3)
    vectors = {}
    for i in range(300):
        a, b = rng.gauss(0, 900), rng.gauss(0, 3)
        vectors[(1 << 60) + i] = [a, a + b, rng.gauss(0, 0.5), a - 2 * b]
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], SCHEMA).repartition(5)
    check(whiten(rows).collect(), vectors)
    assert {r.component for r in whiten(rows, most=2).collect()} == {1, 2}


def test_rows_that_are_dropped_and_rows_that_stay(spark):
    rng = random.Random(5)
    vectors = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(40)}
    vectors[None] = vectors[0]
    bad = [(50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, float("nan"), 2.0], 1), (53, [1.0, float("-inf"), 2.0], 1), (54, [1.0, 2.0], 1), (55, [], 1), (56, [1.0, 2.0, 3.0, None], 1)]
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()] + bad, SCHEMA)
    check(whiten(rows).collect(), vectors)


def test_lower_rank(spark):
    rng = random.Random(9)
    vectors = [[c := rng.gauss(0, 1), c, 5.0] for _ in range(60)]
    rows = whiten(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA)).collect()
    by = {k: [r for r in rows if r.component == k] for k in (1, 2, 3)}
    x = np.array([whole(v) for v in vectors])[:, 0]
    want = (x - x.mean()) / x.std()
    got = np.array([r.whitened for r in sorted(by[1], key=lambda r: r.vec_id)])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert {r.explained for r in by[1]} == {1.0} and {r.explained for r in by[2] + by[3]} == {0.0}
    assert {r.whitened for r in by[2] + by[3]} == {None} and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[], None]])
def test_nothing_to_fit(spark, vectors):
    found = whiten(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA))
    assert found.collect() == [] and len(found.columns) == 7


def test_one_row_and_equal_rows_vary_nowhere(spark):
    for n in (1, 3):
        rows = whiten(spark.createDataFrame([(i, [1.5, 2.5], 1) for i in range(n)], SCHEMA)).collect()
        assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(0, None, None, None)] * (2 * n)


def test_large_entries(spark):
    rows = whiten(spark.createDataFrame([(1, [1e30, 1.0], 1), (2, [-1e30, 2.0], 1), (3, [0.0, 4.0], 1)], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in rows if r.component == 1}[1] is None

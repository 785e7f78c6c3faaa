"""Whitening of vectors by shifted CholeskyQR.

An entry c becomes the whole number x = floor(64 * c) + 1000000. One pass counts the rows and sums the dimensions, exactly.
Then the centred rows A are orthogonalised by passes: a pass adds up the Gram matrix of the rows as they are so far
(A solved by the triangular factors found before), the driver factors it, and the factors are composed into R, so that
A = Q R with orthonormal Q. The first factor comes from a shifted Gram matrix, so that it exists however close A is to a
lower rank; passes go on until a Gram matrix is the identity but for rounding, which that pass then takes off. The singular
values s and right vectors of R are those of A: components by falling eigenvalue s * s / n.

Each pass is a map over the rows; d by d numbers leave a task, d being the dimension, and nothing else goes to the driver.

Edge cases: rows whose vector is null, holds null or non-finite entries, or is shorter than the longest of the others (it
lacks entries) are dropped; null ids and repeated rows stay, each row counts; with no row left, or empty vectors only, the
result is empty; components without variance (n = 1, constant or dependent dimensions) have explained 0 (null if nothing
varies) and a null whitened value, and identity_error is over the others; |64 * c| is held at 2 ** 53, and a deviation that
does not fit 64 bits is null; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import bounded_batches, table

#: Fixed values of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
MOST = float(1 << 53)
#: Components returned; passes at most (three do unless the rank is lower than the dimension); rows of a block.
COMPONENTS, PASSES, BLOCK = 32, 8, 1 << 12
UNIT = np.finfo(np.float64).eps / 2
#: A Gram matrix this near to the identity is put right by its own factor, down to rounding.
NEAR = 1e-7


def usable(rows: DataFrame) -> DataFrame:
    """The rows of (id, v) whose vector is whole."""
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = rows.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull()).where(whole)
    size = held.agg(F.max(F.size("v"))).first()[0]
    return held.where(F.size("v") == F.lit(size or 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers x, some rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            c = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            with np.errstate(over="ignore"):
                yield part.column("id"), np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + OFFSET


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count of the rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _blocks(batches, d):
            n += len(x)
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            total = [t + (h << 26) + w for t, h, w in zip(total, high.tolist(), low.tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "n", "s"]
            )

    found = rows.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by = {r.i: r for r in found}
    return (by[0].n, [int(by[i].s) for i in range(d)]) if by else (0, [])


class Centre:
    """Deviations from the mean S / n: S = q * n + r splits off whole numbers, so that nothing is rounded early."""

    def __init__(self, n: int, totals: list[int]):
        self.n, (q, r) = n, zip(*[divmod(s, n) for s in totals], strict=True)
        self.q, self.r = np.array(q, np.int64), np.array(r, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.q).astype(np.float64) - self.r / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S) ** 2, exact; null beyond 64 bits."""
        off = x - self.q
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < int((2.0**62 / x.shape[1]) ** 0.5):
            return pa.array(((self.n * off - self.r) ** 2).sum(axis=1))
        r = self.r.tolist()
        exact = [sum((self.n * o - t) ** 2 for o, t in zip(row, r, strict=True)) for row in off.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def solve_right(a: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q of Q R = A for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(len(upper)):
        q[:, j] = (a[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def gram(rows: DataFrame, d: int, size: int, made) -> np.ndarray:
    """Sum over all rows of y' y, for the ``size`` numbers y that ``made`` gives for the rows' x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _blocks(batches, d):
            y = made(x)
            total += y.T @ y
        at = np.arange(size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, size)), pa.array(np.tile(at, size)), pa.array(total.ravel())], ["i", "j", "g"])

    out = np.zeros((size, size))
    for r in rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r.i, r.j] = r.g
    return (out + out.T) / 2


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R of G + shift; the shift grows where rounding leaves G short of positive."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(16 * shift, UNIT * max(float(np.trace(g)), 1e-300))


def triangular(rows: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """R of the centred rows."""
    factors: list[np.ndarray] = []
    for k in range(PASSES):

        def orthogonalised(x: np.ndarray, found=tuple(factors)) -> np.ndarray:
            a = centre.rows(x)
            for r in found:
                a = solve_right(a, r)
            return a

        g = gram(rows, d, d, orthogonalised)
        if not g.any():  # nothing varies
            return np.zeros((d, d))
        shift = 11 * (min(centre.n, BLOCK) * d + d * (d + 1)) * UNIT * float(np.linalg.norm(g, 2)) if k == 0 else 0.0
        factors.append(factor(g, shift))
        if k and np.abs(g - np.eye(d)).max() < NEAR:
            break
    composed = factors[0]
    for r in factors[1:]:
        composed = r @ composed
    return composed


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per whole row and component."""
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")))
    first = rows.select(F.size("v").alias("d")).first()
    d = first.d if first else 0
    n, totals = sums(rows, d) if d else (0, [])
    if not n:
        return spark.createDataFrame([], schema)
    centre = Centre(n, totals)
    values, right = np.linalg.svd(triangular(rows, d, centre))[1:]
    size = min(most, d)
    held = values > values[0] * d * UNIT * 32  # less is rounding
    varies = int(held[:size].sum())
    share = np.where(held, values**2, 0) / (values[held] ** 2).sum() if varies else np.full(d, np.nan)
    # sqrt(e) is s / sqrt(n)
    turn = right[:varies].T * (np.sqrt(n) / values[:varies])
    error = float(np.abs(gram(rows, d, varies, lambda x: centre.rows(x) @ turn) / n - np.eye(varies)).max()) if varies else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(1, size + 1, dtype=np.int32)
        explained = pa.array(share[:size], from_pandas=True)
        for ids, x in _blocks(batches, d):
            m = len(x)
            white = np.full((m, size), np.nan)
            white[:, :varies] = centre.rows(x) @ turn
            row, again = np.repeat(np.arange(m), size), np.tile(np.arange(size), m)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(row)), pa.array(np.tile(names, m)), pa.array(np.full(m * size, n)), centre.deviation(x).take(pa.array(row)),
                    pa.array(white.ravel(), from_pandas=True), explained.take(pa.array(again)), pa.array([error] * (m * size), pa.float64()),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitening components of all whole ``embeddings``, 32 at most."""
    return whiten(table(spark, sf_dir, "embeddings"))

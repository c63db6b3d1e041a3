"""Embedding whitening by LOBPCG (locally optimal block preconditioned conjugate gradients).

A vector's entries become whole numbers, floor(1024 * c) + 100000, and the leading eigenvectors of their covariance are found by block
iteration. The only thing done with the rows is the product of their covariance with a block of columns: tasks multiply their
centred rows with it and hand on one partial product each, which Spark adds up by row of the matrix. The block holds the
iterate, its residual and the last direction, made orthonormal; the Rayleigh-Ritz step on it is exact for the product just taken, so
nothing drifts from round to round. ``GUARD`` further columns keep close eigenvalues apart. The iteration ends when every residual
``|V w - e w|`` is certified below ``CERTIFIED * d`` times the largest eigenvalue; rounding allows no less.

Rows are centred as (n * x - S) / n with n * x - S in whole numbers, before anything is multiplied, so the large offset costs no digits. The
driver holds some blocks of d x 3 (COMPONENTS + GUARD) numbers, whatever the number of rows.

Edge cases: rows whose vector is null, empty, or holds a null or a non-finite entry go, and so do rows with another number of entries than
most rows have (of equally common lengths the shortest counts). Equal vectors and repeated rows are rows of their own; a null vec_id
is kept. No row left, no result. A component without variance (equal vectors, or fewer vectors than components) has
explained 0 and a null whitened value, and no part in identity_error, which is null if there is no other. deviation is null
where it does not fit a long (whitened() has it in full).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dispose, materialize

COMPONENTS = 8
#: Columns that are iterated besides those that are wanted.
GUARD = 8
#: A residual counts as certified at this part of the largest eigenvalue, times the dimension.
CERTIFIED = 4 * np.finfo(np.float64).eps
MOST_ROUNDS = 300
#: Below this part of the largest eigenvalue, times the dimension, a component has no variance.
_RANK = 64 * np.finfo(np.float64).eps
#: Rows that are multiplied at a time.
_BLOCK = 4096


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of the rows of embeddings (vec_id, embedding) that are whole and of the common length."""
    entry = F.transform("embedding", lambda c: F.floor(F.lit(1024.0) * c.cast("double")) + F.lit(100_000))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count()
    found = lengths.agg(F.max_by("d", F.struct("count", -F.col("d"))).alias("d")).first()[0]
    return rows.where(F.size("embedding") == F.lit(found)).select("vec_id", entry.alias("x"))


@dataclass(frozen=True)
class Center:
    """n vectors with per-dimension sums."""

    n: int
    sums: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, in doubles, from a difference in whole numbers."""
        return (x * self.n - self.sums).astype(np.float64) / self.n


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column(batch.schema.get_field_index(name)), d)
        for lo in range(0, len(x), _BLOCK):
            yield x[lo : lo + _BLOCK]


def _partial_rows(parts: np.ndarray) -> pa.RecordBatch:
    """A task's matrix, one row of it a record."""
    n, k = parts.shape
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(parts.reshape(-1)))], names=["i", "v"])


def _added(parts: DataFrame, n: int, k: int) -> np.ndarray:
    """The sum of the tasks' n x k matrices; n records of k numbers reach the driver."""
    total = parts.groupBy("i").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(k)]).alias("v"))
    out = np.zeros((n, k))
    for row in total.collect():
        out[row.i] = row.v
    return out


def center(vectors: DataFrame) -> Center | None:
    """Count and sums of vectors (x); none without rows. n * x has to fit 63 bits (for entries near 1e5: n below 4e13), else an error."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, np.zeros(d, np.int64), np.zeros(d)
        for x in _blocks(batches, "x", d):
            n, total, most = n + len(x), total + x.sum(0), np.maximum(most, np.abs(x.astype(np.float64)).max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(total), pa.array(most)], names=["i", "n", "s", "m"])

    found = vectors.select("x").mapInArrow(run, "i int, n long, s long, m double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m")).collect()
    if max(row.n * row.m for row in found) >= 2.0**62:
        raise ArithmeticError("entries times their number do not fit 63 bits")
    sums = np.zeros(d, np.int64)
    for row in found:
        sums[row.i] = row.s
    return Center(found[0].n, sums)


def covariance_product(vectors: DataFrame, at: Center, block: np.ndarray) -> np.ndarray:
    """The covariance of vectors (divisor n) times block, in one pass; rows are centred before they are multiplied."""
    d, k = block.shape
    shared = vectors.sparkSession.sparkContext.broadcast((at, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center_, columns = shared.value
        total, some = np.zeros((d, k)), False
        for x in _blocks(batches, "x", d):
            z = center_.of(x)
            total += z.T @ (z @ columns)
            some = True
        if some:
            yield _partial_rows(total)

    try:
        return _added(vectors.select("x").mapInArrow(run, "i int, v array<double>"), d, k) / at.n
    finally:
        shared.unpersist()


def trace(vectors: DataFrame, at: Center) -> float:
    """The sum of the variances of all dimensions."""
    shared = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((float((shared.of(x) ** 2).sum()) for x in _blocks(batches, "x", len(shared.sums))), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t"])

    return (vectors.select("x").mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0) / at.n


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns; what depends on earlier ones is left out."""
    d = len(blocks[0])
    basis = np.zeros((d, 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if not size:
                continue
            v = column / size
            for _ in range(2):  # twice is enough
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-8 and basis.shape[1] < d:
                v = v / left
                v = v - basis @ (basis.T @ v)
                basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


@dataclass(frozen=True)
class Components:
    """vectors: unit columns by falling eigenvalue; residuals: |V w - e w| of each; rounds: products that were taken."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int


def lobpcg(product, d: int, wanted: int = COMPONENTS, guard: int = GUARD, rounds: int = MOST_ROUNDS) -> Components:
    """The wanted leading eigenpairs of the symmetric d x d matrix that product (block -> matrix @ block) stands for.

    Ends when all their residuals are certified, or when they have stopped to shrink near that; not getting there is an error.
    """
    wanted = min(wanted, d)
    m = min(wanted + guard, d)
    basis = orthonormal(np.random.default_rng(7).standard_normal((d, m)))
    x = np.zeros((d, m))
    best, still = np.inf, 0
    for done in range(1, rounds + 1):
        image = product(basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        at = np.argsort(-values, kind="stable")[:m]
        values, mix = values[at], mix[:, at]
        new = basis @ mix
        residual = image @ mix - new * values
        sizes = np.linalg.norm(residual, axis=0)
        scale = max(abs(values[0]), np.finfo(np.float64).tiny)
        worst = sizes[:wanted].max() / scale
        if worst <= CERTIFIED * d:
            break
        still = still + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if still >= 3 and best <= 100 * CERTIFIED * d:
            break
        # the part of the new iterate that is not in the old one
        direction = new - x @ (x.T @ new)
        x = new
        basis = orthonormal(new, residual, direction)
    else:
        raise ArithmeticError(f"residuals of {worst:.3g} of the largest eigenvalue after {rounds} rounds")
    return Components(np.maximum(values[:wanted], 0.0), new[:, :wanted], sizes[:wanted], done)


def components(vectors: DataFrame, at: Center, wanted: int = COMPONENTS) -> Components:
    return lobpcg(lambda block: covariance_product(vectors, at, block), len(at.sums), wanted)


def scales(found: Components) -> np.ndarray:
    """1 / sqrt(eigenvalue); nan for a component without variance."""
    floor = _RANK * len(found.vectors) * found.values.max(initial=0.0)
    good = found.values > floor
    return np.where(good, 1 / np.sqrt(np.where(good, found.values, 1.0)), np.nan)


def identity_error(vectors: DataFrame, at: Center, found: Components) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured on the rows."""
    scale = scales(found)
    good = np.flatnonzero(~np.isnan(scale))
    k, d = len(good), len(at.sums)
    if not k:
        return None
    turn = found.vectors[:, good] * scale[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for x in _blocks(batches, "x", d):
            w = at.of(x) @ turn
            total[:, :k] += w.T @ w
            total[:, k] += w.sum(0)
        yield _partial_rows(total)

    total = _added(vectors.select("x").mapInArrow(run, "i int, v array<double>"), k, k + 1) / at.n
    # the mean of centred rows is rounding only, far below the entries, so taking it off afterwards costs nothing
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


def deviation(x: np.ndarray, at: Center) -> list[int]:
    """Sums of (n * x - S)^2 over the dimensions, exact."""
    off = x * at.n - at.sums
    if len(off) and float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(1).tolist()
    return [sum(v * v for v in row) for row in off.tolist()]


def whitened(vectors: DataFrame, at: Center, found: Components) -> DataFrame:
    """vec_id, deviation (decimal(38,0)), w (array<double>, null where a component has no variance) of vectors (vec_id, x)."""
    turn, d = found.vectors * scales(found), len(at.sums)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(lo, _BLOCK)
                x = _matrix(part.column(1), d)
                w = at.of(x) @ turn
                flat = pa.array(w.reshape(-1), mask=np.isnan(w).reshape(-1))
                far = pa.array([Decimal(v) for v in deviation(x, at)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column(0), far, pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)], names=["vec_id", "deviation", "w"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), w array<double>")


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of embeddings (vec_id, embedding)."""
    vectors = materialize(whole_vectors(embeddings.select("vec_id", "embedding")), "vectors")
    at = center(vectors)
    if at is None:
        dispose(vectors)
        return vectors.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where(F.lit(False))
    found = components(vectors, at, wanted)
    error, total = identity_error(vectors, at, found), trace(vectors, at)
    explained = [float(e / total) if total else 0.0 for e in found.values]
    rows = whitened(vectors, at, found).select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("w").alias("i", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained])
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(at.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))

"""Whitening of vectors by their leading principal components.

Entries become whole numbers, so counts and sums are exact. Every task turns its part of the distinct vectors into one
matrix of centred products; rows of these matrices are added up by row number. What remains is one matrix of the
vectors' dimension, however many vectors there are: it is brought to tridiagonal form by Householder reflections,
bisection on Sturm counts finds its leading eigenvalues, inverse iteration their vectors, those of close eigenvalues
being made orthogonal to one another. The components, a small matrix too, go to all tasks, which project their rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm.matrices import row_sums
from evalloom.llm.store import removed, written

SCALE, SHIFT = 64.0, 1_000_000
CLOSE = 1e-3  # eigenvalues nearer than this share of the largest are one cluster
EPS = np.finfo(np.float64).eps


# ------------------------------------------------------------ the small matrix
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of the tridiagonal form: reflection k acts on coordinates k + 1 and up."""
    a = matrix.copy()
    n, reflections = len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.abs(v[1:]).max() <= EPS * EPS * size:
            reflections.append(np.zeros(n - k - 1))
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each shift: negative pivots of the shifted matrix (Sturm counts)."""
    least = max(np.abs(off).max(initial=0.0), np.abs(diagonal).max(initial=0.0), 1.0) * EPS * EPS
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[k] - shifts - off[k - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until no number lies between its bounds."""
    n, reach = len(diagonal), np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    edge = EPS * max(np.abs(diagonal).max(), reach.max(), 1.0)
    low, high = np.full(k, (diagonal - reach).min() - edge), np.full(k, (diagonal + reach).max() + edge)
    rank = n - np.arange(k)  # the j-th largest has n - j eigenvalues below any larger number
    while True:
        middle = low + (high - low) / 2
        if not ((low < middle) & (middle < high)).any():
            return middle
        larger = below(diagonal, off, middle) >= rank
        high, low = np.where(larger, middle, high), np.where(larger, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float):
    """Solve (T - shift) x = b by elimination with row exchanges; a vanishing pivot becomes a tiny one."""
    n = len(diagonal)
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    u, first, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    steps = []
    for i in range(n - 1):
        under, after = off[i], u[i + 1]
        if abs(under) > abs(u[i]):
            factor = u[i] / under
            u[i], (first[i], kept) = under, (after, first[i])
            second[i] = first[i + 1]
            u[i + 1], first[i + 1] = kept - factor * first[i], -factor * second[i]
            steps.append((True, factor))
        else:
            u[i] = u[i] if abs(u[i]) > tiny else math.copysign(tiny, u[i])
            factor = under / u[i]
            u[i + 1] = after - factor * first[i]
            steps.append((False, factor))
    u[-1] = u[-1] if abs(u[-1]) > tiny else math.copysign(tiny, u[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i, (exchanged, factor) in enumerate(steps):
            if exchanged:
                x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
            else:
                x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            x[i] = (x[i] - (first[i] * x[i + 1] if i + 1 < n else 0.0) - (second[i] * x[i + 2] if i + 2 < n else 0.0)) / u[i]
        return x

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column, by inverse iteration; orthogonal within clusters of values."""
    n, found, cluster = len(diagonal), [], 0
    scale = max(abs(values[0]), np.finfo(np.float64).tiny)
    shift = math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * scale:
            cluster = j
        shift = min(value, shift - 4 * EPS * scale)  # equal values get shifts of their own
        solve = _solver(diagonal, off, shift)
        start = np.random.Generator(np.random.PCG64(j)).standard_normal(n)
        x = start / np.linalg.norm(start)
        for _ in range(8):
            last = x
            x = solve(x)
            x /= np.abs(x).max()
            for _ in range(2):  # the second time for what rounding left
                for other in found[cluster:]:
                    x = x - (other @ x) * other
            x /= np.linalg.norm(x)
            if np.abs(np.abs(last @ x) - 1) < 2 * EPS:
                break
        found.append(x)
    return np.stack(found, axis=1)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling, and unit eigenvectors as columns) of the leading ``k`` components of a symmetric matrix."""
    if not matrix.any():
        return np.zeros(min(k, len(matrix))), np.eye(len(matrix))[:, :k]
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    vectors = leading_vectors(diagonal, off, values)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values, vectors / np.linalg.norm(vectors, axis=0)


# ------------------------------------------------------------ the vectors
def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def _products(centred, size: int):
    """Map of batches to the rows of one task's matrix of products of ``centred(column)``."""

    def products(batches):
        total, any_row = np.zeros((size, size)), False
        for batch in batches:
            if batch.num_rows:
                x = centred(batch.column(0))
                total += x.T @ x
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    return products


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the rows whose vector is there and holds finite entries only; an entry c, as double, becomes floor(64 c) + 1000000."""
    read = rows.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = read.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)))
    return sound.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """For each row with a sound vector and each leading component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors are those of ``whole_vectors``; ``n`` counts the distinct ones, which alone make the sums S, the covariance
    (divisor n) and its components, numbered from 1 by falling eigenvalue e. ``deviation`` is the sum of (n x - S)^2,
    ``whitened`` the projection of x - S/n over sqrt(e), ``explained`` is e over the trace, ``identity_error`` the largest
    entry of the covariance of whitened distinct vectors less the identity.

    Needs two numbers per dimension and one dimension by dimension matrix in a task and in the driver; rows stay in tasks.

    Defined results: a null vector, and one with a null or non-finite entry, gives no rows; a repeated vector counts once
    in the fit and gives rows each time, as does a repeated or null id; a component without variance (all vectors equal, fewer
    distinct ones than dimensions) has no direction and gives no rows, nor do vectors of no entries; an empty table
    gives no rows. Vectors of several lengths, and sums or a deviation beyond 64 bits, are errors. Other columns are not read.
    """
    whole = whole_vectors(rows, vec_id, vector)
    out_type = T.StructType([
        T.StructField("id", whole.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    nothing = rows.sparkSession.createDataFrame([], out_type).withColumnRenamed("id", vec_id)
    distinct = written(whole.select("x").distinct())
    n, short, size, largest = distinct.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    if not n or not size:
        removed(distinct)
        return nothing
    if short != size:
        raise ValueError(f"vectors have {short} to {size} entries")

    if n * largest >= 2**61 or largest < 0:
        raise OverflowError("sums of the entries do not fit into 64 bits")

    def summed(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += (_matrix(batch.column(0), size) - SHIFT).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "s"])

    sums = np.zeros(size, np.int64)
    for r in distinct.mapInArrow(summed, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():  # one row per dimension
        sums[r.i] = r.s + n * SHIFT

    def centred(column):
        return (n * _matrix(column, size) - sums) / n  # whole numbers up to the division

    matrix = row_sums(distinct.select("x").mapInArrow(_products(centred, size), "i int, row binary"), size, size) / n
    trace = math.fsum(np.diag(matrix))
    values, vectors = leading_components(matrix, components)
    held = values > size * EPS * max(values[0], 0.0)
    values, vectors = values[held], vectors[:, held]
    k = len(values)
    if not k:
        removed(distinct)
        return nothing
    weights = vectors / np.sqrt(values)

    def mean(batches):
        for batch in batches:
            total = (centred(batch.column(0)) @ weights).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "s"])

    means = np.zeros(k)
    for r in distinct.mapInArrow(mean, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        means[r.i] = r.s / n
    whitened = row_sums(distinct.mapInArrow(_products(lambda column: centred(column) @ weights - means, k), "i int, row binary"), k, k) / n
    error = float(np.abs(whitened - np.eye(k)).max())
    removed(distinct)
    explained = values / trace
    within = math.isqrt((2**63 - 1) // size)

    def projected(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scaled = n * _matrix(batch.column(1), size) - sums
            if np.abs(scaled).max() > within:
                exact = [sum(int(c) ** 2 for c in row) for row in scaled]
                if max(exact) >= 2**63:
                    raise OverflowError("a deviation does not fit into 64 bits")
                deviation = np.array(exact, np.int64)
            else:
                deviation = (scaled * scaled).sum(axis=1)
            rows_in, again = batch.num_rows, np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)), pa.array(np.full(rows_in * k, n)), pa.array(deviation[again]),
                    pa.array(((scaled / n) @ weights).reshape(-1)), pa.array(np.tile(explained, rows_in)), pa.array(np.full(rows_in * k, error)),
                ],
                names=out_type.names,
            )

    return whole.mapInArrow(projected, out_type).withColumnRenamed("id", vec_id)

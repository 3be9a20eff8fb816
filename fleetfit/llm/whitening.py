"""Whitening of embeddings.

1. Sums per dimension and the number of vectors, as exact integers.
2. The covariance of integer vectors, centred before multiplying; every task adds up one matrix, Spark adds those.
3. On the driver, a matrix of dimension times dimension only: Householder tridiagonalisation, bisection by Sturm counts for
   the leading eigenvalues, inverse iteration for their vectors, orthogonalised anew inside clusters of eigenvalues.
4. The components, at most ``COMPONENTS`` vectors, go out with the tasks that project.
5. The covariance of what was projected is measured over all rows and compared with the identity.

An entry ``c`` counts as the integer ``floor(64 * c) + 1000000``. Defined results: a vector that is null, or holds a null or
non-finite entry or one beyond ``MOST``, is left out, as is one of another length than the commonest (of equally common ones
the longest). Rows with the same id, or none, stay apart. Directions without variance (below rounding) are no components,
so one vector, equal vectors or an empty table give no rows. A deviation that fits no long is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Largest absolute value of 64 times an entry: integers up to here are exact as doubles.
MOST = float(1 << 52)
#: Numbers of a batch that are worked on at once.
AT_ONCE = 1 << 20
LONG = (1 << 63) - 1


# --- inside tasks ------------------------------------------------------------------------------


def integers(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the usable vectors of one length, their integers as a matrix), length by length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    starts, lengths = offsets[:-1], np.diff(offsets)
    values = np.floor(vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) <= MOST))])  # a null is read as NaN
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[starts]) & (lengths > 0)
    for d in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == d))
        for at in range(0, len(rows), step := max(1, AT_ONCE // int(d))):
            part = rows[at : at + step]
            yield part, values[starts[part][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors of a task: (length, dimension, vectors, sum)."""
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for rows, x in integers(batch.column("v")):
            n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            held[x.shape[1]] = n + len(rows), [s + (int(h) << 32) + int(b) for s, h, b in zip(sums, high, low)]
    for d, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d] * d, pa.int32()),
                pa.array(range(d), pa.int32()),
                pa.array([n] * d, pa.int64()),
                pa.array([str(s) for s in sums], pa.string()),
            ],
            names=["length", "i", "n", "s"],
        )


class Centre(NamedTuple):
    """Number of vectors and their exact sums."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as 64-bit integers where they suffice, as Python's beyond."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0))
        if 2 * most < LONG:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def matrices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for rows, x in integers(batch.column("v")):
                if x.shape[1] == len(self.sums):
                    yield batch, rows, self.scaled(x)

    def centred(self, scaled: np.ndarray) -> np.ndarray:
        return (scaled / self.n).astype(np.float64)


def deviations(scaled: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact; null where it fits no long."""
    most = int(np.abs(scaled).max(initial=0))
    if most * most * scaled.shape[1] <= LONG:
        return pa.array((scaled.astype(np.int64) ** 2).sum(axis=1), pa.int64())
    exact = [sum(int(v) * int(v) for v in row) for row in scaled]
    return pa.array([v if v <= LONG else None for v in exact], pa.int64())


def products(rows: DataFrame, centre: Centre, onto: np.ndarray | None = None) -> np.ndarray:
    """Mean product of every two columns of the centred vectors, or of their projections ``onto`` columns of a matrix."""
    width = len(centre.sums) if onto is None else onto.shape[1]
    upper = np.triu_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, _, scaled in centre.matrices(batches):
            y = centre.centred(scaled)
            y = y if onto is None else y @ onto
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"]
        )

    made = rows.mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[made["i"], made["j"]] = made["v"] / centre.n
    out[made["j"], made["i"]] = made["v"] / centre.n
    return out


# --- eigenvectors of one small matrix ----------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, one beside it, reflectors) of a symmetric matrix by Householder reflections."""
    a, d = matrix.copy(), len(matrix)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        u = x.copy()
        u[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        size = float(np.linalg.norm(u))
        if size == 0.0 or not np.any(x[1:]):
            reflectors.append(np.zeros(len(x)))
            continue
        u /= size
        reflectors.append(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1 :, k] -= 2 * u * (u @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def smaller(diagonal: np.ndarray, beside: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: negative pivots of the shifted matrix (Sturm count)."""
    tiny = np.finfo(float).tiny * 1e10
    square = np.concatenate([[0.0], beside**2])
    count, pivot = np.zeros(len(points), np.int64), np.ones(len(points))
    for value, s in zip(diagonal, square):
        with np.errstate(over="ignore"):  # an infinite pivot has the right sign
            pivot = value - points - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection down to neighbouring doubles."""
    d = len(diagonal)
    radius = np.abs(np.concatenate([beside, [0.0]])) + np.abs(np.concatenate([[0.0], beside]))
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    margin = np.finfo(float).eps * max(abs(low), abs(high), np.finfo(float).tiny) * 4
    below, above = np.full(k, low - margin), np.full(k, high + margin)
    wanted = d - 1 - np.arange(k)  # number of eigenvalues below the wanted one
    for _ in range(1100):
        middle = below + (above - below) / 2
        if np.all((middle <= below) | (middle >= above)):
            break
        under = smaller(diagonal, beside, middle) <= wanted
        below, above = np.where(under, middle, below), np.where(under, above, middle)
    return below + (above - below) / 2


def _solver(diagonal: np.ndarray, beside: np.ndarray, shift: float, least: float):
    """Solves the shifted tridiagonal system for any right side: elimination with row exchanges."""
    d = len(diagonal)
    a, b, c = diagonal - shift, np.append(beside, 0.0), np.zeros(d)  # diagonal, first and second one above
    swaps, factors = np.zeros(d, bool), np.zeros(d)
    for i in range(d - 1):
        under = beside[i]
        if abs(under) > abs(a[i]):
            swaps[i] = True
            a[i], under = under, a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], 0.0
        a[i] = a[i] if abs(a[i]) >= least else math.copysign(least, a[i])
        factors[i] = under / a[i]
        a[i + 1] -= factors[i] * b[i]
        b[i + 1] -= factors[i] * c[i]
    a[-1] = a[-1] if abs(a[-1]) >= least else math.copysign(least, a[-1])

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.copy()
        for i in range(d - 1):
            if swaps[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        for i in range(d - 1, -1, -1):
            x[i] -= b[i] * x[i + 1] if i + 1 < d else 0.0
            x[i] -= c[i] * x[i + 2] if i + 2 < d else 0.0
            x[i] /= a[i]
            if abs(x[i]) > 1e200:
                x *= 1e-200
        return x / np.linalg.norm(x)

    return solve


def vectors_of(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, as columns, by inverse iteration.

    Values closer than a thousandth of the matrix's size form a cluster, whose vectors are orthogonalised in every step.
    """
    size = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(beside).max(initial=0)), np.finfo(float).tiny)
    eps, random = np.finfo(float).eps, np.random.default_rng(0)
    out, cluster, last = np.zeros((len(diagonal), len(values))), 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            cluster = k
        # Equal values are told apart by shifts of a few roundings.
        shift = value if last is None or last - value > 2 * eps * size else last - 2 * eps * size
        last = shift
        solve = _solver(diagonal, beside, shift, eps * size)
        x = random.standard_normal(len(diagonal))
        for _ in range(6):
            x = solve(x)
            for _ in range(2):
                x = x - out[:, cluster:k] @ (out[:, cluster:k].T @ x)
                x = x / np.linalg.norm(x)
        out[:, k] = x
    return out


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns), at most ``k`` of those above rounding."""
    if not len(covariance):
        return np.zeros(0), np.zeros((0, 0))
    diagonal, beside, reflectors = tridiagonal(covariance)
    values = leading(diagonal, beside, min(k, len(covariance)))
    values = values[values > 16 * len(covariance) * np.finfo(float).eps * max(values[0], 0.0)]
    vectors = vectors_of(diagonal, beside, values)
    for i in range(len(reflectors) - 1, -1, -1):
        u = reflectors[i]
        vectors[i + 1 :] -= 2 * np.outer(u, u @ vectors[i + 1 :])
    return values, vectors


# --- the operator ------------------------------------------------------------------------------


def whitened(table: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``table`` and component: id, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``. Other columns are ignored. See the module for the defined results."""
    kind = table.schema[id_col].dataType
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out_schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    sums = rows.select("v").mapInArrow(_sums, "length int, i int, n long, s string").groupBy("length", "i")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).persist()
    usual = sums.where("i = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    found = sums.where(F.col("length") == (usual[0]["length"] if usual else -1)).orderBy("i").collect()
    sums.unpersist()
    centre = Centre(found[0]["n"], tuple(int(r["s"]) for r in found)) if found else Centre(1, ())
    covariance = products(rows.select("v"), centre) if found else np.zeros((0, 0))
    values, vectors = principal(covariance, k)
    onto = vectors / np.sqrt(values) if len(values) else np.zeros((len(centre.sums), 0))
    explained = values / np.trace(covariance) if len(values) else values
    error = float(np.abs(products(rows.select("v"), centre, onto) - np.eye(len(values))).max()) if len(values) else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components = len(explained)
        for batch, at, scaled in centre.matrices(batches):
            if not components:
                return
            repeated = pa.array(np.repeat(np.arange(len(at)), components))
            count = len(at) * components
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(at)).take(repeated),
                    pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(count, centre.n, np.int64)),
                    deviations(scaled).take(repeated),
                    pa.array((centre.centred(scaled) @ onto).reshape(-1)),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(count, error)),
                ],
                names=[f.name for f in out_schema],
            )

    return rows.mapInArrow(project, out_schema).withColumnRenamed("id", id_col)

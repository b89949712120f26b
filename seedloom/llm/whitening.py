"""Whitening of embeddings: distributed centred covariance, and its leading eigenvectors by bisection and inverse iteration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import map_arrow, scratch

#: Entries are counted in steps of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Vectors are as long as this at most: a covariance of so many rows and columns is the largest thing that the driver holds.
MOST_DIMENSIONS = 4096
#: Partial covariances are added in so many groups before the last sum.
GROUPS = 32
#: Eigenvalues nearer than this share of the matrix's norm are a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
EPSILON = float(np.finfo(float).eps)
#: Sums of squares up to this are taken in 64-bit integers, larger ones in Python's.
SAFE = 1 << 62


def steps_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: each vector in whole steps of 1 / ``scale``, rounded down.

    Vectors that are null or hold null or non-finite entries are left out, and so are those
    with entries beyond a long.
    """
    big = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    usable = F.coalesce(F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(1 << 62))), F.lit(False))
    return embeddings.where(usable).select(F.col(id_col).alias("vec_id"), big.cast("array<bigint>").alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass(frozen=True)
class Centre:
    """Number of vectors of the fit list and their exact sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers, as 64-bit integers where they fit."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most < SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return self.moved(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        z = self.moved(x)
        if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < SAFE:
            return (z * z).sum(1).tolist()
        found = [sum(int(v) ** 2 for v in row) for row in z.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def centre_of(fit: DataFrame, width: int) -> Centre:
    """Exact count and sums of the fit list's vectors, added by the aggregate of each dimension."""
    sums = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    return Centre(int(sums[0]["n"]), tuple(int(r["s"]) for r in sums)) if width else Centre(0, ())


def summed_products(rows: DataFrame, project, width: int) -> np.ndarray:
    """Sum over rows of v v^T, where ``project`` makes vectors ``v`` of ``width`` entries out of a matrix of x.

    Each task adds up its own rows, groups of tasks' sums are added by their matrix rows, then those.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0)
            if len(x):
                v = project(matrix(x, len(x[0])))
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    def added(table: pa.Table) -> pa.Table:
        total = matrix(table.column("v").combine_chunks(), width).sum(0)
        return pa.table({"i": table.column("i").combine_chunks()[:1], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(partial, "i int, v array<double>")
    if rows.rdd.getNumPartitions() > GROUPS:
        grouped = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        parts = grouped.groupBy("g", "i").applyInArrow(lambda t: added(t.drop_columns(["g"])), "i int, v array<double>")
    found = {r["i"]: r["v"] for r in parts.groupBy("i").applyInArrow(added, "i int, v array<double>").collect()}
    return np.array([found[i] for i in range(width)]) if found else np.zeros((width, width))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a = a.copy()
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = math.sqrt(float(u @ u))
        if not np.abs(u[1:]).max(initial=0.0) > 0.0:
            continue
        u[0] += math.copysign(size, u[0])
        u /= math.sqrt(float(u @ u))
        block = a[k + 1 :, k + 1 :]
        p = block @ u
        p -= (u @ p) * u
        block -= 2.0 * (np.outer(u, p) + np.outer(p, u))
        a[k + 1 :, k] -= 2.0 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflectors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of ``at``: negative terms of the Sturm sequence."""
    least = max(float(np.abs(e).max(initial=0.0)), float(np.abs(d).max(initial=0.0)), 1e-300) * EPSILON
    count, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, by bisection."""
    n = len(d)
    reach = np.concatenate((np.abs(e), [0.0])) + np.concatenate(([0.0], np.abs(e)))
    low, high = np.full(k, float((d - reach).min())), np.full(k, float((d + reach).max()))
    pad = EPSILON * max(float(np.abs(low).max()), float(np.abs(high).max()), 1e-300) * n
    low, high = low - pad, high + pad
    place = n - 1 - np.arange(k)
    for _ in range(200):
        middle = (low + high) / 2
        above = sturm_count(d, e, middle) <= place
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if np.all((high - low <= 2 * EPSILON * np.maximum(np.abs(low), np.abs(high))) | ((low + high) / 2 == low) | ((low + high) / 2 == high)):
            break
    return (low + high) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solves (T - shift) y = b by elimination with row exchanges; pivots too small become ``least``."""
    n = len(d)
    diagonal, upper, upper2 = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n
    lower, y = e.tolist(), b.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(diagonal[i]):
            diagonal[i], lower[i] = lower[i], diagonal[i]
            upper[i], diagonal[i + 1] = diagonal[i + 1], upper[i]
            upper2[i], upper[i + 1] = upper[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(diagonal[i]) < least:
            diagonal[i] = least
        m = lower[i] / diagonal[i]
        diagonal[i + 1] -= m * upper[i]
        upper[i + 1] -= m * upper2[i]
        y[i + 1] -= m * y[i]
    if abs(diagonal[-1]) < least:
        diagonal[-1] = least
    for i in range(n - 1, -1, -1):
        rest = y[i] - (upper[i] * y[i + 1] if i + 1 < n else 0.0) - (upper2[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = rest / diagonal[i]
    return np.array(y)


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, by inverse iteration; those of a cluster are made orthogonal in every step."""
    n = len(d)
    norm = max(float(np.abs(d).max(initial=0.0)) + 2 * float(np.abs(e).max(initial=0.0)), 1e-300)
    rng = np.random.default_rng(13)
    vectors = np.zeros((n, len(values)))
    start, shift = 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # Equal eigenvalues get shifts apart, so that each step isn't led to the vector before.
        shift = min(float(value), shift - EPSILON * norm)
        y = rng.standard_normal(n)
        for _ in range(6):
            y = solve_shifted(d, e, shift, y / np.linalg.norm(y), EPSILON * norm)
            for _ in range(2):
                own = vectors[:, start:j]
                y /= np.abs(y).max()
                y -= own @ (own.T @ y)
                if not np.abs(y).max() > 0.0:
                    y = rng.standard_normal(n)
        vectors[:, j] = y / np.linalg.norm(y)
    return vectors


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvalues, falling, and unit eigenvectors, as columns, of a symmetric matrix.

    Fewer where the rest has no variance beyond rounding.
    """
    if not len(v) or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    size = float(np.abs(v).max())
    d, e, reflectors = tridiagonal(v / size)
    # Where an off-diagonal entry is nothing but rounding, the matrix falls into blocks with vectors of their own.
    ends = np.flatnonzero(np.abs(e) <= EPSILON * (np.abs(d[:-1]) + np.abs(d[1:]))) + 1
    found = []
    for own in np.split(np.arange(len(d)), ends):
        values = leading_eigenvalues(d[own], e[own[:-1]], min(k, len(own)))
        vectors = np.zeros((len(d), len(values)))
        vectors[own] = eigenvectors(d[own], e[own[:-1]], values)
        found.append((values, vectors))
    values = np.concatenate([f[0] for f in found])
    vectors = np.concatenate([f[1] for f in found], 1)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > EPSILON * len(v) * max(float(values[order[0]]), 0.0)]
    values, vectors = values[order], vectors[:, order]
    for at, u in reversed(reflectors):
        vectors[at:] -= 2.0 * np.outer(u, u @ vectors[at:])
    vectors /= np.linalg.norm(vectors, axis=0)
    # Either sign is right; the largest entry is taken as positive, so that reruns agree.
    largest = np.abs(vectors).argmax(0)
    vectors *= np.sign(vectors[largest, np.arange(len(values))])
    return values * size, vectors


@dataclass(frozen=True)
class Whitening:
    """The centre, the leading eigenvalues and eigenvectors, and the trace of the fit list's covariance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of the rows of a matrix of x."""
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of vectors ``x`` of ``width`` entries, each once.

    Two passes: exact counts and sums, then products of centred vectors. The driver gets one
    matrix of ``width`` rows and columns, whatever the number of vectors.
    """
    centre = centre_of(distinct, width)
    v = summed_products(distinct, centre.centred, width) / max(centre.n, 1)
    values, vectors = leading_components((v + v.T) / 2, components)
    return Whitening(centre, values, vectors, float(np.trace(v)))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over its vectors."""
    k = len(model.values)
    if not k:
        return 0.0
    # The mean of whitened vectors is taken beside them, so that their covariance is centred before multiplying.
    means = distinct.mapInArrow(_mean_part(model), "n bigint, s array<double>").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k))).first()
    mean = np.array([means[f"s{i}"] for i in range(k)]) / means["n"]
    c = summed_products(distinct, lambda x: model.whitened(x) - mean, k) / model.centre.n
    return float(np.abs(c - np.eye(k)).max())


def _mean_part(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(model.values))
        for batch in batches:
            x = batch.column(0)
            if len(x):
                n += len(x)
                total += model.whitened(matrix(x, len(x[0]))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    return run


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component.

    The fit list is each distinct vector in whole steps once; its centre is exact, and the
    covariance is summed from centred vectors. The components are the leading eigenvectors by
    Householder tridiagonalisation, Sturm-count bisection and inverse iteration, sent to all tasks.

    Vectors that are null, hold null or non-finite entries, or entries of 2^62 steps or more, give no row. The
    commonest length of a vector (of equally common ones the longest) is fitted; vectors of other lengths give no row.
    Components without variance are left out: a table whose vectors are all equal, one vector
    or none gives an empty result. Repeated rows and null ids are kept. ``deviation`` is null
    where it is beyond a long. Vectors longer than ``MOST_DIMENSIONS`` raise ``ValueError``.
    """
    steps = steps_of(embeddings, id_col, vector_col)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = steps.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {width} entries, more than {MOST_DIMENSIONS}")
    if not width:
        return steps.where("false").mapInArrow(lambda batches: iter(()), schema)
    steps = steps.where(F.size("x") == width)
    distinct = scratch(steps.select("x").distinct())
    model = fit(distinct, width, components)
    error = identity_error(distinct, model)
    explained = (model.values / model.trace).tolist() if model.trace > 0 else []
    k = len(explained)

    def rows(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column(1), width)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
        return {
            "vec_id": ids, "component": list(range(1, k + 1)) * len(x), "n": [model.centre.n] * (len(x) * k), "deviation": [v for v in model.centre.deviations(x) for _ in range(k)],
            "whitened": model.whitened(x).ravel().tolist(), "explained": explained * len(x), "identity_error": [error] * (len(x) * k),
        }

    return map_arrow(steps.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x"), rows, schema)

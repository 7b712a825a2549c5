"""Whitening of embeddings: exact moments by Spark, eigenvectors by spectral divide and conquer.

Vectors become integers, equal ones count once, and two passes of partial sums give the
mean and the covariance. What reaches the driver is that one matrix, d x d for vectors of
d entries, whatever the number of rows. Its invariant subspaces are split by projectors
from polar decompositions of the shifted matrix until single components are left, and
those are broadcast to whiten every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.store import Scratch

#: An entry c counts as floor(SCALE * c).
SCALE = 256.0
#: Integers below this are exact in doubles; vectors with larger ones cannot be measured.
LARGEST = float(1 << 53)
COMPONENTS = 4
_EPS = float(np.finfo(np.float64).eps)
_LOW = 1 << 26
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a square matrix by QR-based dynamically weighted Halley steps.

    The weights follow a lower bound of the singular values, so that six or seven steps take
    them from rounding level to one.
    """
    m = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    low, eye = _EPS, np.eye(m)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:m] @ q[m:].T)
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if abs(low - 1) < 1e-12 and moved <= (5 * _EPS) ** (1 / 3):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of a symmetric matrix above and below its mean eigenvalue; None if all are equal."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    if spread <= 4 * _EPS * max(abs(mean), np.linalg.norm(a) / np.sqrt(m)):
        return None
    # The mean lies strictly between the ends; it moves only where it meets an eigenvalue, for which no sign is defined.
    for step in (0.0, 0.05, -0.05, 0.17, -0.17, 0.31, -0.31):
        sign = polar_factor(a - (mean + step * spread) * np.eye(m))
        projector = (sign + sign.T) / 4 + np.eye(m) / 2
        r = round(float(np.trace(projector)))
        if 0 < r < m and np.linalg.norm(projector @ projector - projector) < 1e-7 * m:
            basis = np.linalg.qr(projector @ np.random.default_rng(m).standard_normal((m, r)))[0]
            whole = np.linalg.qr(projector @ basis, mode="complete")[0]
            return whole[:, :r], whole[:, r:]
    return None


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their unit eigenvectors as columns; each has its largest entry positive.

    A subspace is split while it holds more than one component; the lower part is followed
    only where the upper one does not hold k.
    """
    found: list[np.ndarray] = []

    def follow(basis: np.ndarray) -> None:
        if len(found) >= k:
            return
        own = basis.T @ v @ basis
        parts = _split((own + own.T) / 2) if basis.shape[1] > 1 else None
        if parts is None:
            found.extend(basis.T)
            return
        for part in parts:
            follow(basis @ part)

    if len(v):
        follow(np.eye(len(v)))
    vectors = np.array(found[:k]).reshape(-1, len(v))
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    values = np.einsum("ki,ij,kj->k", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[order]
    peak = np.abs(vectors).argmax(axis=1) if len(vectors) else np.zeros(0, dtype=int)
    return values, (vectors * np.sign(vectors[np.arange(len(vectors)), peak])[:, None]).T


def _integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector: the rows that are whole, finite and measurable, as integers."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    held = values.is_valid().to_numpy(zero_copy_only=False)
    scaled = np.floor(SCALE * values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
    good = held & (np.abs(scaled) < LARGEST)  # false for what is not finite
    first = np.concatenate(([0], np.cumsum(size)))
    bad_before = np.concatenate(([0], np.cumsum(~good)))
    whole = (size > 0) & (bad_before[first[1:]] == bad_before[first[:-1]])
    for d in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == d))
        yield rows, scaled[first[rows][:, None] + np.arange(d)].astype(np.int64)


def _parts(batches, column: int, size: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            for rows, x in _integers(part.column(column)):
                yield part, rows, x


def _pack(batches):
    """Each measurable vector in the narrowest integers that hold it, so that equal vectors are equal bytes."""
    for _, _, x in _parts(batches, 0):
        peak = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
        width = np.where(peak < 1 << 15, 2, np.where(peak < 1 << 31, 4, 8))
        for w in np.unique(width).tolist():
            own = np.ascontiguousarray(x[width == w].astype(f"<i{w}"))
            at = np.arange(len(own) + 1, dtype=np.int32) * (own.shape[1] * w)
            packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(at), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), own.shape[1], dtype=np.int32)), packed], names=["dim", "packed"])


def _unpacked(batches, d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = [p for p, own in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if own == d]
        for width in (2, 4, 8):
            if own := [p for p in rows if len(p) == width * d]:
                yield np.frombuffer(b"".join(own), dtype=f"<i{width}").reshape(-1, d).astype(np.int64)


def _matrix_sum(fit: DataFrame, shape: tuple[int, int], d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix over all vectors: one per task, added up row by row in tasks in two rounds."""
    height, width = shape

    def partial(batches):
        total = np.zeros(shape)
        for x in _unpacked(batches, d):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], names=["at", "row"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["at", "row"])

    schema = "at int, row binary"
    once = fit.mapInArrow(partial, schema).withColumn("salt", F.spark_partition_id() % 32).repartition("at", "salt").select("at", "row").mapInArrow(add, schema)
    out = np.zeros(shape)
    for at, row in once.repartition("at").mapInArrow(add, schema).collect():
        out[at] = np.frombuffer(row)
    return out


class Whitening(NamedTuple):
    """n distinct vectors of dim entries with sums `sums`; column k of `components` has eigenvalue values[k]."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each entry: halves of integers are added as longs."""

    def partial(batches):
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for x in _unpacked(batches, d):
            n, high, low = n + len(x), high + (x // _LOW).sum(axis=0), low + (x % _LOW).sum(axis=0)
        at = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(at, names=["at", "n", "high", "low"])

    rows = fit.mapInArrow(partial, "at int, n long, high long, low long").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("at").collect()
    return rows[0].n, [r.high * _LOW + r.low for r in rows]


def fit(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table; None where no vector can be measured.

    Vectors that are null or empty, hold null or non-finite entries, or entries of 2**45 and
    more take no part; of vectors of several lengths the length of most distinct vectors
    counts (of several such lengths the largest). Components without variance are left out.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    distinct = embeddings.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_pack, "dim int, packed binary").distinct()
    kept = scratch.save(distinct, "fit")
    most = kept.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return None
    d = most.dim
    n, sums = _moments(kept, d)
    mean = np.array([s / n for s in sums])
    covariance = _matrix_sum(kept, (d, d), d, lambda x: (x - mean).T @ (x - mean)) / n
    values, vectors = leading_components((covariance + covariance.T) / 2, components)
    trace = float(np.trace(covariance))
    spread = values > d * _EPS * trace
    values, vectors = values[spread], vectors[:, spread]
    k, error = len(values), 0.0
    if k:
        scaled = vectors / np.sqrt(values)
        white = _matrix_sum(kept, (k, k), d, lambda x: ((x - mean) @ scaled).T @ ((x - mean) @ scaled)) / n
        error = float(np.abs(white - np.eye(k)).max())
    scratch.drop("fit")
    return Whitening(d, n, sums, values, vectors, values / trace if trace else values, error)


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """x less the mean, and the exact sums of squares of n * x - sums (None past 64 bits)."""
    bound = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    exact = np.int64 if bound * bound * model.dim < 1 << 63 else object
    apart = x.astype(exact) * model.n - np.array(model.sums, dtype=exact)
    squares = [int(s) if s < 1 << 63 else None for s in (apart * apart).sum(axis=1).tolist()]
    return (apart / model.n).astype(np.float64), squares


def transform(embeddings: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each measurable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that `fit` leaves out, by their entries or their length, have no rows; repeated
    rows repeat, a null id stays null, an empty table, or one of equal vectors, gives an
    empty result, and further columns are ignored. A deviation past 64 bits is null.
    """

    def run(batches):
        if model is None or not len(model.values):
            return
        k, scaled = len(model.values), model.components / np.sqrt(model.values)
        for part, rows, x in _parts(batches, 1):
            if x.shape[1] != model.dim:
                continue
            centred, squares = _centred(x, model)
            ids = part.column(0).take(pa.array(np.repeat(rows, k)))
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(m, model.n)),
                    pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array((centred @ scaled).reshape(-1)),
                    pa.array(np.tile(model.explained, len(rows))),
                    pa.array(np.full(m, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    vectors = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return vectors.mapInArrow(run, RESULT)

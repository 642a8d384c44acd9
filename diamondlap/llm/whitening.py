"""Whitening of embeddings, with eigenvectors corrected in higher precision.

Entries c become whole numbers x = floor(64 * c) + 1000000, and each distinct
x vector counts once. Sums over the vectors are exact; covariances are summed from
n * x - S, which is exact as well, divided by n before it is multiplied. Each task adds
its vectors up to one matrix, and a tree of tasks adds the matrices.

Of the covariance V the driver takes eigenvectors in single precision and corrects
them by the iterations of Ogita and Aishima: from R = I - X'X and S = X'VX follow
the eigenvalues S_ii / (1 - R_ii) and a correction E of X, entry by entry, by matrix
products in extended precision. Where eigenvalues are closer together than the
error allows to tell apart, the correction only makes the vectors orthogonal, and
the problem of the cluster, shifted by its mean, is solved by itself and turns them.
Iterations end when the correction is below double precision.

Defined cases: rows whose vector is null or empty or holds a null or non-finite
entry are left out. Entries are clipped at +-2**40 after scaling; n * x has to fit a
long, which allows 8 million distinct vectors if entries are as large as that and 2**42 if they are
below 2**20. Vectors of each
length are whitened by themselves, and n, S and V are those of their length.
Repeated rows are projected each and counted once. Components whose eigenvalue is
zero up to rounding (as with fewer vectors than dimensions, or a single one) have a
null `whitened` and do not count in identity_error, which is null if there are no
others; explained is null if all vectors are equal. A deviation that does not fit a
long is null. Rows without vec_id are kept. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlap.sources.staging import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MOST = 1 << 40
FANS = 16  # tasks of the last but one level of a tree of sums
ROUNDS = 12
SLICE = 4_096  # vectors multiplied at once


def whole(column: pa.Array) -> list[np.ndarray | None]:
    """x of every usable vector."""
    out: list[np.ndarray | None] = []
    for scalar in column:
        values = scalar.values
        c = None if values is None or not len(values) or values.null_count else np.asarray(values, np.float64)
        out.append(None if c is None or not np.isfinite(c).all() else np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + SHIFT)
    return out


def scaled(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, dim and x as bytes, of the usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1))
            own = [i for i, v in enumerate(x) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array([len(x[i]) for i in own], pa.int32()), pa.array([x[i].tobytes() for i in own], pa.binary())],
                names=["vec_id", "dim", "x"],
            )

    kind = vectors.schema[vec_id].dataType.simpleString()
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(run, f"vec_id {kind}, dim int, x binary")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their x as a matrix), in slices."""
    dims, x = np.asarray(batch.column("dim")), batch.column("x")
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        for low in range(0, len(own), SLICE):
            rows = own[low : low + SLICE]
            yield int(dim), rows, np.frombuffer(b"".join(x.take(pa.array(rows)).to_pylist()), np.int64).reshape(len(rows), dim)


def summed(rows: DataFrame, part: Callable[[int, np.ndarray], np.ndarray], dtype=np.float64) -> dict[int, np.ndarray]:
    """By length of the vectors, the sum over all of part(dim, x); tasks add up their own, and a tree of tasks adds these."""
    kind = np.dtype(dtype)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                value = part(dim, x)
                total[dim] = total[dim] + value if dim in total else value
        yield pack(total)

    def pack(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(kind).tobytes() for v in total.values()], pa.binary())], names=["dim", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("total").to_pylist()):
                value = np.frombuffer(raw, kind)
                total[dim] = total[dim] + value if dim in total else value
        yield pack(total)

    schema = "dim int, total binary"
    level = rows.mapInArrow(own, schema).withColumn("part", F.spark_partition_id())
    level = level.repartition(FANS, "part").sortWithinPartitions("part").select("dim", "total").mapInArrow(add, schema)
    level = level.withColumn("part", F.spark_partition_id()).repartition(1).sortWithinPartitions("part").select("dim", "total").mapInArrow(add, schema)
    return {r["dim"]: np.frombuffer(r["total"], kind) for r in level.collect()}  # one row per length


def clusters_of(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more ascending values, neighbours no further apart than gap."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refined(v: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix v, to double precision."""
    size = np.abs(v).max()
    if not size:
        return np.zeros(len(v)), np.eye(len(v))
    high = np.longdouble
    a = (v / size).astype(high)
    x = np.linalg.eigh((v / size).astype(np.float32))[1].astype(high)
    eye = np.eye(len(v), dtype=high)
    norm = np.linalg.norm(v / size)
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = np.linalg.norm((s - np.diag(values)).astype(np.float64))
        error = 2 * (off + norm * np.linalg.norm(r.astype(np.float64)))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > error
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for run in clusters_of(values, error):
            own = x[:, run]
            mean = values[run].mean()
            inner = own.T @ (a @ own - mean * own)  # shifted: the cluster's differences are not lost
            turned = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1]
            x[:, run] = own @ turned.astype(high)
        x = x + x @ (eye - x.T @ x) / 2  # the turns are orthogonal in double precision only
        if np.abs(e).max() < 1e-15:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (np.einsum("ij,ij->j", x, a @ x) * size).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    out = x[:, order].astype(np.float64)
    return values[order], out * np.where(out[np.abs(out).argmax(axis=0), np.arange(len(v))] < 0, -1, 1)


class Model(NamedTuple):
    n: int
    sums: np.ndarray
    values: np.ndarray  # of the components
    vectors: np.ndarray  # a column each
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(np.float64).eps * max(self.values[0], 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components, zero where the eigenvalue is."""
        root = np.sqrt(np.where(self.usable, self.values, 1))
        return np.where(self.usable, self.centred(x) / self.n @ self.vectors / root, 0.0)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """By length of the vectors, the components of the distinct vectors; x(dim, x) should be a written table without repetitions."""
    first = summed(x, lambda dim, rows: np.concatenate(([len(rows)], rows.sum(axis=0))), np.int64)

    def products(dim: int, rows: np.ndarray) -> np.ndarray:
        n, sums = int(first[dim][0]), first[dim][1:]
        z = (n * rows - sums) / n
        return (z.T @ z).ravel()

    out = {}
    for dim, total in summed(x, products).items():
        n = int(first[dim][0])
        v = total.reshape(dim, dim) / n
        values, vectors = refined((v + v.T) / 2)
        out[dim] = Model(n, first[dim][1:], values[:components], vectors[:, :components], float(np.trace(v)))
    return out


def identity_errors(x: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, components without a variance left out."""
    sums = summed(x, lambda dim, rows: models[dim].project(rows).sum(axis=0))

    def products(dim: int, rows: np.ndarray) -> np.ndarray:
        w = models[dim].project(rows) - sums[dim] / models[dim].n
        return (w.T @ w).ravel()

    out: dict[int, float | None] = {}
    for dim, total in summed(x, products).items():
        own = np.flatnonzero(models[dim].usable)
        k = len(models[dim].values)
        cov = total.reshape(k, k)[np.ix_(own, own)] / models[dim].n
        out[dim] = float(np.abs(cov - np.eye(len(own))).max()) if len(own) else None
    return out


def deviations(d: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row of whole numbers, null beyond a long."""
    if np.abs(d.astype(np.float64)).max(initial=0) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in d.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: n, deviation, whitened, explained, identity_error."""
    rows = stage(scaled(vectors, vec_id, embedding), "scaled")
    distinct = stage(rows.select("dim", "x").distinct(), "distinct")
    models = fit(distinct, components)
    errors = identity_errors(distinct, models)
    kind = rows.schema["vec_id"].dataType.simpleString()
    held = vectors.sparkSession.sparkContext.broadcast((models, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = held.value
        for batch in batches:
            for dim, own, x in matrices(batch):
                model = models[dim]
                k, m = len(model.values), len(own)
                every = np.repeat(own, k)
                hidden = np.tile(~model.usable, m)
                explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)), pa.array(deviations(model.centred(x)), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(model.project(x).ravel(), mask=hidden), pa.array(np.tile(explained, m), mask=np.full(m * k, not model.trace > 0)),
                        pa.array([errors[dim]] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")

"""Whitening of embeddings: covariance by Welford's updates, merged across partitions, and a symmetric QR eigen-solve.

`moments` updates mean and co-moments vector by vector inside each partition (a rank-one update each) and merges the partitions' results by the formula for two
samples, sixteen at a time in a tree, so one task never holds more than sixteen matrices of d x d. What reaches the driver is one such matrix: its size hangs on
the vectors' dimension alone. Values are taken relative to the partition's first vector, which keeps the precision of vectors far from zero.

Rows whose vector is null, empty or holds null, non-finite or huge entries (2^40 or more in size) have no result. If vectors differ in length, those of the most
frequent length count (of ties the longest), the others have none. Of equal vectors one enters the fit, all are whitened. Directions without variance (within the
rounding of the largest) are no components, so constant vectors and a single one give no rows; so does an empty table. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, dropped, written

#: So many partial results are merged at once.
FAN = 16
PARTIAL = "node long, n long, sums array<long>, origin array<double>, mean array<double>, comoment array<double>"


@dataclass
class Moments:
    """n vectors: their exact sums where they are whole numbers, mean = origin + mean, comoment = sum of (x - mean)(x - mean)^T."""

    n: int
    sums: np.ndarray
    origin: np.ndarray
    mean: np.ndarray
    comoment: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = (other.origin - self.origin) + (other.mean - self.mean)
        return Moments(n, self.sums + other.sums, self.origin, self.mean + gap * (other.n / n), self.comoment + other.comoment + np.outer(gap, gap) * (self.n * other.n / n))

    def row(self, node: int) -> dict:
        return {"node": [node], "n": [self.n], "sums": [self.sums.tolist()], "origin": [self.origin.tolist()], "mean": [self.mean.tolist()], "comoment": [self.comoment.reshape(-1).tolist()]}


def welford(vectors: np.ndarray, into: Moments | None) -> Moments | None:
    """Adds rows of `vectors` one after the other."""
    if not len(vectors):
        return into
    d = vectors.shape[1]
    if into is None:
        into = Moments(0, np.zeros(d, np.int64), vectors[0].astype(np.float64), np.zeros(d), np.zeros((d, d)))
    update = np.empty((d, d))
    for y in vectors - into.origin:
        into.n += 1
        gap = y - into.mean
        into.mean += gap / into.n
        into.comoment += np.multiply(gap[:, None], (y - into.mean)[None, :], out=update)
    if vectors.dtype == np.int64:
        into.sums += vectors.sum(axis=0)
    return into


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of d numbers, no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(vectors: DataFrame, d: int) -> Moments | None:
    """Moments of column x (arrays of d longs or doubles, no nulls); None of an empty table."""
    spark = vectors.sparkSession
    schema = arrow_schema(spark, PARTIAL)

    def partial(batches):
        at = None
        for batch in batches:
            at = welford(matrix(batch.column("x"), d), at)
        if at is not None:
            yield pa.RecordBatch.from_pydict(at.row(TaskContext.get().partitionId()), schema=schema)

    def merge(rows: pa.Table) -> pa.Table:
        out = None
        for r in rows.sort_by("node").to_pylist():
            one = Moments(r["n"], np.array(r["sums"], np.int64), np.array(r["origin"]), np.array(r["mean"]), np.array(r["comoment"]).reshape(d, d))
            out = one if out is None else out.merged(one)
        return pa.Table.from_pydict(out.row(rows["node"][0].as_py() // FAN), schema=schema)

    partials = written(vectors.select("x").mapInArrow(partial, PARTIAL), "moments")
    merged, width = partials, (partials.agg(F.max("node")).first()[0] or 0) + 1
    while width > 1:
        merged = merged.groupBy((F.col("node") / FAN).cast("long").alias("group")).applyInArrow(merge, PARTIAL)
        width = -(-width // FAN)
    row = merged.first()
    dropped(partials)
    return row and Moments(row["n"], np.array(row["sums"], np.int64), np.array(row["origin"]), np.array(row["mean"]), np.array(row["comoment"]).reshape(d, d))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: diagonal, side diagonal and the orthogonal q with a = q t q^T."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix: implicit QR steps with Wilkinson's shift on its tridiagonal form."""
    main, side, q = tridiagonal((a + a.T) / 2)
    vectors, high = np.ascontiguousarray(q.T), len(main) - 1
    tiny = np.finfo(float).eps
    while high > 0:
        small = np.abs(side[:high]) <= tiny * (np.abs(main[:high]) + np.abs(main[1 : high + 1]))
        side[:high][small] = 0
        if side[high - 1] == 0:
            high -= 1
            continue
        zeros = np.flatnonzero(side[:high] == 0)
        low = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (main[high - 1] - main[high]) / 2
        shift = main[high] - side[high - 1] ** 2 / (half + np.copysign(np.hypot(half, side[high - 1]), half))
        x, z = main[low] - shift, side[low]
        for k in range(low, high):
            # A rotation of rows k and k + 1 chases the bulge z down the side diagonal.
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                side[k - 1] = r
            one, two, between = main[k], main[k + 1], side[k]
            main[k], main[k + 1] = c * c * one + 2 * c * s * between + s * s * two, s * s * one - 2 * c * s * between + c * c * two
            side[k] = c * s * (two - one) + (c * c - s * s) * between
            x = side[k]
            if k < high - 1:
                z = s * side[k + 1]
                side[k + 1] *= c
            vectors[k], vectors[k + 1] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    order = np.argsort(-main, kind="stable")
    vectors = vectors[order]
    return main[order], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Whitening:
    """What a fit learns: n and the exact sums of its vectors, the leading eigenvalues and their unit vectors, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Whitened rows of whole-number vectors, and their exact sums of (n x - sums)^2 (None beyond a long)."""
        if len(x) and max(int(np.abs(x).max()) * self.n, int(np.abs(self.sums).max())) >= 1 << 61:
            x = x.astype(object)
        off = x * self.n - self.sums
        most = int(np.abs(off).max()) if off.size else 0
        if most * most * x.shape[1] >= 1 << 63:
            off = off.astype(object)
        square = (off * off).sum(axis=1).tolist()
        return (off / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values)[:, None]).T, [s if s < 1 << 63 else None for s in square]


def fit(x: DataFrame, d: int, k: int = 16) -> Whitening | None:
    """The whitening of whole-number vectors in column x; None of an empty table."""
    m = moments(x, d)
    if m is None:
        return None
    values, vectors = eigen(m.comoment / m.n)
    real = values[: min(k, d)] > max(values[0], 0) * d * np.finfo(float).eps
    return Whitening(m.n, m.sums, values[: min(k, d)][real], vectors[: min(k, d)][real], float(np.trace(m.comoment / m.n)))


def identity_error(x: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k = len(w.values)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                white, _ = w.apply(matrix(part.column("x"), len(w.sums)))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(white.reshape(-1), k).cast(pa.list_(pa.float64()))], names=["x"])

    m = moments(x.mapInArrow(run, "x array<double>"), k)
    return float(np.abs(m.comoment / m.n - np.eye(k)).max())


def whiten(vectors: DataFrame, w: Whitening, key: str = "vec_id") -> DataFrame:
    """key, component (from 1), deviation and whitened: a row for each vector of x and component."""
    k, of_key = len(w.values), vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {of_key}, component int, deviation long, whitened double"
    arrow = arrow_schema(vectors.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                white, off = w.apply(matrix(part.column("x"), len(w.sums)))
                rows = np.repeat(np.arange(part.num_rows), k)
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows)), pa.array(component), pa.array(off, pa.int64()).take(pa.array(rows)), pa.array(white.reshape(-1))], schema=arrow)

    return vectors.select(key, "x").mapInArrow(run, schema)


def whole_numbers(embeddings: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, x: entries as floor(scale * entry) + offset, of the rows that have a result."""
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float(1 << 40)), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") > 0) & fine)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + offset).alias("x"))


def whitened(embeddings: DataFrame, k: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of the `whole_numbers` of embeddings, fitted on the distinct ones."""
    spark = embeddings.sparkSession
    x = whole_numbers(embeddings)
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if sizes is None:
        return none
    x = x.filter(F.size("x") == sizes["d"])
    fitted = written(x.select("x").distinct(), "whitening")
    w = fit(fitted, sizes["d"], k)
    error = identity_error(fitted, w) if len(w.values) else None
    dropped(fitted)
    if error is None:
        return none
    explained = F.element_at(F.array(*[F.lit(float(e / w.trace)) for e in w.values]), F.col("component"))
    return whiten(x, w).select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

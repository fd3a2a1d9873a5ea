"""Whitening of embeddings: exact sums, a distributed centred covariance, its leading eigenvectors, and a broadcast projection.

Each component c of a vector becomes the integer x = floor(SCALE * c) + SHIFT. Tasks sum x exactly; then, with the exact
mean, each task adds up the products of its centred rows, and rows of the matrix meet in a shuffle. The driver holds
one matrix of dimension squared, never rows: Householder reflections make it tridiagonal, Sturm counts bisect for the leading
eigenvalues, inverse iteration gives their vectors, which are made orthogonal within clusters of close eigenvalues, and
the reflections turn them back. The components are broadcast (dimension times components doubles) and applied in one pass.

Vectors that are null or hold null or non-finite entries are left out, as are those whose x do not fit 53 bits and those of
another length than most have (of equally frequent lengths the longest counts). Other rows stay whatever their vec_id: repeated rows
count as often as they stand, null is an id like others. Components whose eigenvalue is not above LEAST times the trace
(vectors that span fewer dimensions, equal vectors, a single one) have no direction and are not returned; equal eigenvalues
give some orthogonal directions of their space. An empty table gives none. Other columns are ignored. `deviation` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

SCALE, SHIFT = 1024, 100_000
#: Share of the trace at which an eigenvalue counts as zero, and the most dimensions (a matrix of 134 MB on the driver).
LEAST, MOST_DIM = 1e-12, 4096
#: Eigenvalues closer than this share of the largest get their vectors made orthogonal to each other.
CLUSTER = 1e-3
#: Rows that the numpy kernels take at once, divided by the dimension.
PIECE = 2_000_000


# eigenvectors of a symmetric matrix ---------------------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and off-diagonal of Q^T a Q, and the Householder vectors of Q as (first row, unit vector)."""
    a = np.array(a, float)
    d = len(a)
    turns = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if size == 0 or not np.any(x[1:]):
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # the reflection 1 - 2 v v^T from both sides, as one update of rank two
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        q = p - (v @ p) * v
        rest -= 2 * (np.outer(v, q) + np.outer(q, v))
        column = x - 2 * v * (v @ x)
        a[k + 1 :, k] = a[k, k + 1 :] = column
        turns.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), turns


def count_below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: for each value of `at` the number of eigenvalues below it."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off**2, initial=0)))
    n, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(diag)):
        q = diag[i] - at - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        n += q < 0
    return n


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all of them at once."""
    d = len(diag)
    beside = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low, high = np.full(k, np.min(diag - beside)), np.full(k, np.max(diag + beside))
    pad = 1e-15 * max(abs(low[0]), abs(high[0])) * d + np.finfo(float).tiny
    low, high = low - pad, high + pad
    rank = d - np.arange(k)  # the first has d - 1 eigenvalues below it
    for _ in range(200):
        mid = (low + high) / 2
        if np.all((mid == low) | (mid == high)):
            break
        beyond = count_below(diag, off, mid) >= rank
        low, high = np.where(beyond, low, mid), np.where(beyond, mid, high)
    return (low + high) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots of zero become tiny ones."""
    d = len(diag)
    least = np.finfo(float).eps * (np.abs(diag).max() + np.max(np.abs(off), initial=0)) + np.finfo(float).tiny
    # each row of the triangle has three entries, as an exchange fills one more diagonal
    u, b = np.zeros((d, 3)), np.array(b, float)
    row = np.array([diag[0] - shift, off[0] if d > 1 else 0.0, 0.0])
    for i in range(d - 1):
        below = np.array([off[i], diag[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0])
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(row[0]) < least:
            row[0] = least
        f = below[0] / row[0]
        u[i] = row
        b[i + 1] -= f * b[i]
        row = np.array([below[1] - f * row[1], below[2] - f * row[2], 0.0])
    if abs(row[0]) < least:
        row[0] = least
    u[d - 1] = row
    x = np.zeros(d + 2)
    for i in range(d - 1, -1, -1):
        x[i] = (b[i] - u[i, 1] * x[i + 1] - u[i, 2] * x[i + 2]) / u[i, 0]
        if abs(x[i]) > 1e150:  # only the direction counts
            x[i:] /= 1e150
            b[: i + 1] /= 1e150
    return x[:d]


def leading_vectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    diag, off, turns = tridiagonal(a)
    # parts between off-diagonals of zero have eigenvectors of their own
    scale = np.abs(diag).max(initial=0) + np.abs(off).max(initial=0)
    off = np.where(np.abs(off) <= np.finfo(float).eps * scale * 1e-3, 0.0, off)
    values = leading(diag, off, k)
    r, vectors = np.random.default_rng(1), np.zeros((len(diag), k))
    first = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * max(abs(values[0]), np.finfo(float).tiny):
            first = j
        before = vectors[:, first:j]
        x = r.standard_normal(len(diag))
        # close values are taken a little apart, so that each shift finds its own direction
        shift = values[j] - np.finfo(float).eps * scale * (j - first)
        for _ in range(5):
            for _ in range(2):
                x -= before @ (before.T @ x)
            x = solve_shifted(diag, off, shift, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
        for _ in range(2):
            x -= before @ (before.T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    for at, v in reversed(turns):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    return values, vectors


# passes over the vectors --------------------------------------------------------------------------
def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of vectors without null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52 / SCALE)) & (F.size(v) > 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def integers(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """x of all rows of a batch."""
    v = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * v).astype(np.int64) + SHIFT


def pieces(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), max(1, PIECE // dim)):
            yield batch.slice(at, max(1, PIECE // dim))
    release()


def added(rows: DataFrame, dim: int, each: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of the size x size matrices that `each` gives for pieces of rows: a task adds its own up, then rows of the matrix meet by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for piece in pieces(batches, dim):
            if len(piece):
                total += each(piece)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist()):
                found[i] = found.get(i, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([r.tobytes() for r in found.values()], pa.binary())], names=["i", "row"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((size, size))
    # sorted by content, so that the sum does not depend on which task came first
    for r in rows.mapInArrow(run, "i long, row binary").repartition(min(parts, size), "i").sortWithinPartitions("i", "row").mapInArrow(meet, "i long, row binary").collect():
        out[r.i] = np.frombuffer(r.row)
    return out


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums of x; components as columns, with their eigenvalues, the trace, and the identity error (None until it is measured)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in exact integers; Python's where 64 bits do not hold them."""
        s = np.array(self.sums, object)
        most = self.n * (2**53 + SHIFT)
        if most < 2**62 or self.n * int(np.abs(x).max(initial=0)) + int(np.abs(s).max(initial=0)) < 2**62:
            return self.n * x - s.astype(np.int64)
        return self.n * x.astype(object) - s

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(float) / self.n) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)^2, exact; None beyond a long."""
        y = self.centred(x)
        if y.dtype != object and self.dim * int(np.abs(y).max(initial=0)) ** 2 < 2**63:
            return (y * y).sum(1).tolist()
        return [int(t) if (t := sum(int(c) * int(c) for c in row)) < 2**63 else None for row in y]


def totals(rows: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """The rows of the most frequent length, their number, and their exact sums of x by dimension."""
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return rows, 0, []
    n, dim = lengths.n, lengths.dim
    if dim > MOST_DIM:
        raise ValueError(f"vectors of {dim} dimensions, more than {MOST_DIM}")
    rows = rows.where(F.size("v") == dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for piece in pieces(batches, dim):
            x = integers(piece, dim)
            if len(x):
                fits = int(np.abs(x).max()) * len(x) < 2**62
                total = total + (x.sum(0) if fits else x.astype(object).sum(0)).astype(object)
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([str(int(t)) for t in total])], names=["i", "s"])

    found = rows.mapInArrow(run, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * dim
    for r in found:
        sums[r.i] = int(r.s)
    return rows, n, sums


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors(vec_id, embedding); None if there are none."""
    bounded_batches(vectors.sparkSession)
    rows, n, sums = totals(usable(vectors))
    if not n:
        return None
    dim, start = len(sums), Whitening(n, tuple(sums), np.zeros(0), np.zeros((len(sums), 0)), 0.0)

    def products(piece: pa.RecordBatch) -> np.ndarray:
        y = start.centred(integers(piece, dim)).astype(float) / n
        return y.T @ y

    v = added(rows, dim, products, dim) / n
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    values, found = leading_vectors(v, min(components, dim))
    real = (values > LEAST * trace) & (trace > 0)
    model = Whitening(n, tuple(sums), values[real], found[:, real], trace)
    k = int(real.sum())
    if not k:
        return model

    def check(piece: pa.RecordBatch) -> np.ndarray:
        w = model.whiten(integers(piece, dim))  # its mean is zero, as that of n * x - S is
        return w.T @ w

    error = float(np.abs(added(rows, dim, check, k) / n - np.eye(k)).max())
    return Whitening(n, tuple(sums), values[real], found[:, real], trace, error)


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (array, falling eigenvalues) of the usable vectors that have the model's length."""
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors).where(F.size("v") == model.dim)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for piece in pieces(batches, m.dim):
            x = integers(piece, m.dim)
            w = pa.array(m.whiten(x).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32) if k else np.zeros(len(x) + 1, np.int32)), w)
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(m.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def report(vectors: DataFrame, components: int = 8) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if len(model.values) else F.array().cast("array<double>")
    out = apply(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("place")).alias("explained"), F.lit(model.error).cast("double").alias("identity_error"),
    )

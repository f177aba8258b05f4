"""Whitening of embeddings by mixed-precision refinement of the covariance's eigenvectors.

Entries become whole numbers, so counts and sums are exact, and each row is centred before it is multiplied. Tasks add their
rows' products up, and Spark adds the tasks' sums. The eigenvectors of that covariance are found in float32 and corrected by
Ogita and Aishima's iteration: matrix products in extended precision give, for each pair of vectors, the part of the one
to take from the other, and each step squares the error. Pairs whose eigenvalues are closer than the step can tell apart are
only made orthogonal; they form clusters, and each cluster is solved as a small problem of its own, shifted by its mean so
that the differences within it are what the solver sees, by the same method. The iteration then goes on with all vectors.

What the driver holds is a matrix of dimensions by dimensions, whatever the number of rows.

Defined cases: rows whose vector is null or has null or non-finite entries go, and so do rows of another dimension
than the commonest (ties: the larger) and empty vectors; repeated rows and rows with a null id are rows of their own;
directions without variance (all of them where there is one row) have no whitened value, so null, and are not part of the
identity error, which is null where no direction has variance; equal eigenvalues have any orthonormal basis, one for all rows;
entries or sums beyond 64 bits raise an error; an empty table gives an empty result; other columns are not read, so their
names are free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Rows that are multiplied at a time.
ROWS = 4096
#: Steps of refinement at most; each squares the error, so that float32 needs three.
STEPS = 30
#: Variances below this share of the largest are rounding.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """What whitening needs of the rows it was fitted on."""

    n: int
    sums: np.ndarray  # exact, by dimension
    vectors: np.ndarray  # a column a component, by falling eigenvalue
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied by; NaN for directions without variance."""
        kept = self.values > LEAST_SHARE * max(float(self.values[0]), 0.0) if len(self.values) else np.zeros(0, bool)
        return np.where(kept, 1 / np.sqrt(np.where(kept, self.values, 1.0)), np.nan)


def _wide(matrix: np.ndarray) -> np.ndarray:
    return np.asarray(matrix, np.longdouble)


def _correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(what to add to x is x @ this, the eigenvalues, the distance of eigenvalues that this step tells apart)."""
    eye = np.eye(len(a), dtype=np.longdouble)
    r, s = eye - x.T @ x, x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    apart = float(2 * (np.abs(s - np.diag(values)).sum(axis=1).max() + np.abs(a).sum(axis=1).max() * np.abs(r).sum(axis=1).max()))
    apart = min(apart, 2 * float(np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float))))
    differences = values[None, :] - values[:, None]
    far = np.abs(differences) > apart
    step = np.where(far, (s + values[None, :] * r) / np.where(far, differences, 1), r / 2)
    return step, values, apart


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within that distance, where there is more than one."""
    order = np.argsort(-values, kind="stable")
    cuts = np.nonzero(-np.diff(values[order]) > apart)[0] + 1
    return [own for own in np.split(order, cuts) if len(own) > 1]


def _start(a: np.ndarray) -> np.ndarray:
    """Eigenvectors in float32, of the matrix brought to unit size."""
    size = float(np.abs(a).max()) or 1.0
    return _wide(np.linalg.eigh((a / size).astype(np.float32))[1])


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors by column) of a symmetric matrix, by falling value, refined from float32 in extended precision."""
    a = _wide(a)
    x = refined(a, _start(a)) if len(a) else a
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def refined(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = float(np.finfo(np.float64).eps) / 64
    before = np.inf
    for _ in range(STEPS):
        step, values, apart = _correction(a, x)
        x = x + x @ step
        size = float(np.abs(step).max())
        if size < 1e-3:
            # Vectors are only as good as their cluster: solve each on its own, then go on.
            for own in _clusters(values, apart):
                if len(own) < len(a):
                    x[:, own] = x[:, own] @ _within(a, x[:, own])
                elif before == np.inf:
                    x = x @ _within(a, x)
        if size < tiny or size >= before and size < 1e-12:
            break
        before = size
    return _orthonormal(x)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so to the extended precision."""
    for _ in range(3):
        x = x + x @ (np.eye(x.shape[1], dtype=np.longdouble) - x.T @ x) / 2
    return x


def _within(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rotation that parts the vectors of a cluster: the eigenvectors of the matrix in their space, less its mean."""
    inner = x.T @ (a @ x)
    inner = (inner + inner.T) / 2
    inner = inner - np.eye(len(inner), dtype=np.longdouble) * np.trace(inner) / len(inner)
    size = np.abs(inner).max()
    if not size:
        return np.eye(len(inner), dtype=np.longdouble)
    return _orthonormal(_wide(np.linalg.eigh((inner / size).astype(float))[1]))  # the differences are of its own size now


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dimension)


def scaled(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): the vectors that can be used, as whole numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long")).alias("x"))


def _dimension(rows: DataFrame) -> int:
    """The commonest length; lengths are few, and only the one most frequent comes back."""
    own = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own["d"] if own else 0


def _sums(rows: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums by dimension, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = _matrix(batch.column(0).slice(at, ROWS), dimension)
                n += len(part)
                # Two halves of each number, so that no sum of a batch leaves 64 bits.
                high, low = part >> 32, part & 0xFFFFFFFF
                total = [t + (h << 32) + w for t, h, w in zip(total, high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "sums"])

    each = rows.select("x").mapInArrow(run, "n long, sums array<long>")
    added = each.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return (int(added[0]["n"]), np.array([r["s"] for r in added], np.int64)) if added else (0, np.zeros(0, np.int64))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sum, exact; x - mean, rounded once)."""
    spread = np.abs(x).max(initial=0).item() * n + np.abs(sums).max(initial=0).item()
    if spread >= 1 << 63:
        raise ArithmeticError("n * x - sum is beyond 64 bits")
    exact = n * x - sums
    return exact, exact / float(n)


def covariance(rows: DataFrame, dimension: int, n: int, sums: np.ndarray, *, onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the rows, or of their projections onto the columns of ``onto``; divisor n, centred first."""
    width = dimension if onto is None else onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = _centred(_matrix(batch.column(0).slice(at, ROWS), dimension), n, sums)[1]
                part = part if onto is None else part @ onto
                total += part.T @ part
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], ["i", "products"])

    each = rows.select("x").mapInArrow(run, "i int, products array<double>")
    cells = each.select("i", F.posexplode("products").alias("j", "p")).where(F.col("j") >= F.col("i"))
    added = cells.groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()  # dimensions by dimensions
    out = np.zeros((width, width))
    out[added["i"], added["j"]] = added["p"] / n
    return np.triu(out) + np.triu(out, 1).T


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> tuple[Whitening, int] | None:
    """The whitening of scaled rows and their dimension; None without rows. Four passes over the rows."""
    dimension = _dimension(rows)
    if not dimension:
        return None
    rows = rows.where(F.size("x") == dimension)
    n, sums = _sums(rows, dimension)
    v = covariance(rows, dimension, n, sums)
    values, vectors = eigenvectors(v)
    found = Whitening(n, sums, vectors[:, :components], values[:components], float(np.trace(v)))
    kept = ~np.isnan(found.scales)
    if kept.any():
        onto = found.vectors[:, kept] * found.scales[kept]
        found.identity_error = float(np.abs(covariance(rows, dimension, n, sums, onto=onto) - np.eye(int(kept.sum()))).max())
    return found, dimension


def transform(rows: DataFrame, whitening: Whitening, dimension: int) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of each scaled row of the dimension."""
    n, sums, scales = whitening.n, whitening.sums, whitening.scales
    onto = whitening.vectors * np.where(np.isnan(scales), 0, scales)
    lost = np.isnan(scales)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                exact, rounded = _centred(_matrix(part.column(1), dimension), n, sums)
                if np.abs(exact).max(initial=0).item() ** 2 * dimension >= 1 << 63 and (exact.astype(float) ** 2).sum(axis=1).max() > 0.99 * 2**63:
                    raise ArithmeticError("a deviation is beyond 64 bits")
                projected = rounded @ onto
                flat = pa.array(projected.ravel(), mask=np.tile(lost, len(projected))) if lost.any() else pa.array(projected.ravel())
                ends = pa.array(np.arange(len(projected) + 1, dtype=np.int32) * projected.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((exact * exact).sum(axis=1)), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "whitened"])

    return rows.where(F.size("x") == dimension).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT
) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = scaled(vectors, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift)
    found = fit(rows, components=components)
    if found is None:
        each = rows.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        whitening = Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    else:
        whitening = found[0]
        each = transform(rows, *found)
    shares = F.array(*[F.lit(float(e) / whitening.trace if whitening.trace > 0 else None) for e in whitening.values]).cast("array<double>")
    wide = each.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(whitening.n).cast("long").alias("n"), "deviation", "whitened",
        _share(shares, len(whitening.values)).alias("explained"), F.lit(whitening.identity_error).cast("double").alias("identity_error"),
    )


def _share(shares: Column, n: int) -> Column:
    return F.get(shares, F.col("at")) if n else F.lit(None).cast("double")

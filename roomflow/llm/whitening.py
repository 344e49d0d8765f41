"""Embedding whitening by shifted Cholesky QR.

Vectors become integer vectors x (grid ``SCALE``, offset ``OFFSET``). The fit list
holds each distinct x once. Centred rows form a tall matrix A that no task and no
driver ever holds; what meets are Gram matrices of dims x dims numbers:

1. Sums of x per dimension, exactly, give the mean.
2. A pass streams the fit list: rows are centred (``x - S/n`` by integers, so no
   digits cancel), multiplied by the inverses of the triangular factors found so
   far (triangular solves, R never inverted) and their Gram matrix is summed, task
   by task, then by entry.
3. The driver factors the Gram matrix by Cholesky. The first pass adds the shift
   ``11 (m n + n (n + 1)) u trace`` that keeps it positive definite for any rows;
   later passes add one only where the plain factorisation fails. Factors are
   composed, ``R = R_k ... R_1``, until the rows are orthonormal where they have
   any extent.
4. The SVD of R gives components (right vectors) and eigenvalues ``s^2 / n`` of the
   covariance, without forming it: small ones keep their digits.

Directions in which the rows have no extent (constant or dependent dimensions)
leave singular values at rounding level; they are no components.

Defined results: rows whose vector is null or holds a null or non-finite entry
are dropped; repeated vectors count once in the fit and each get their rows; an
empty table gives an empty table; a single distinct vector has no component, so no
rows; vectors of different lengths and entries beyond 2**40 are errors; null ids
pass through; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
PASSES = 8  # at most; three do for full rank
ROUNDOFF = 2.0 ** -53
FLAT = 1e-11  # singular values below this part of the largest are rounding
WIDE = 1 << 40  # entries are smaller than this


class Whitener(NamedTuple):
    """Fitted on ``n`` distinct vectors with per-dimension sums ``total``."""

    n: int
    total: np.ndarray
    components: np.ndarray  # a unit vector per column, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


def grid(vector: Column) -> Column:
    """``x`` of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("bigint"))


def usable(vector: Column) -> Column:
    """A vector without null, NaN or infinite entries."""
    def finite(c: Column) -> Column:
        d = c.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def grid_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of the usable rows of ``vectors``."""
    v = F.col("v")
    wide = F.exists(v, lambda c: F.abs(c.cast("double")) >= F.lit(float(WIDE)))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(v))
    return kept.select("id", F.when(wide, F.raise_error(F.lit("an entry is beyond 2**40")).cast("array<bigint>"))
                       .otherwise(grid(v)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as int64; lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def _summed(rows: DataFrame, of_matrix, kind: str) -> dict[int, float]:
    """Sums by place of the vectors that ``of_matrix`` makes of each batch's rows
    (one vector a task, then one number a place)."""
    number = pa.int64() if kind == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of_matrix(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, number)],
                                             names=["k", "v"])

    sums = map_arrow(rows.select("x"), run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v"))
    return {r["k"]: r["v"] for r in sums.collect()}  # a number for each place of a matrix


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - total / n`` to double precision: whole parts are taken off first."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole) - rest


def _upper(g: np.ndarray) -> np.ndarray:
    return g[np.triu_indices(g.shape[0])]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows r^-1`` for upper triangular ``r``, column by column."""
    out = np.empty_like(rows, order="F")
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(fit: DataFrame, n: int, total: list[int], factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves by ``factors``."""
    def part(x: np.ndarray) -> np.ndarray:
        q = centred(x, n, total)
        for r in factors:
            q = solved(q, r)
        return _upper(q.T @ q)

    d = len(total)
    sums = _summed(fit, part, "double")
    g = np.zeros((d, d))
    g[np.triu_indices(d)] = [sums[k] for k in range(d * (d + 1) // 2)]
    return g + np.triu(g, 1).T


def _cholesky(g: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper triangular factor; shifted where asked or needed."""
    d = g.shape[0]
    shift = 11 * (rows * d + d * (d + 1)) * ROUNDOFF * max(np.trace(g), np.finfo(float).tiny)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Components of the written table ``fit`` of distinct rows ``x``; None if empty."""
    sizes = fit.select(F.size("x").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).limit(2).collect()
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    d, n = sizes[0]["d"], sizes[0]["n"]
    if d == 0:
        return Whitener(n, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    sums = _summed(fit, lambda x: x.sum(axis=0), "bigint")
    total = [int(sums[k]) for k in range(d)]
    factors: list[np.ndarray] = []
    product = np.eye(d)
    for k in range(PASSES):
        g = _gram(fit, n, total, factors)
        if k == 0:
            trace = float(np.trace(g)) / n
            if not trace:
                return Whitener(n, np.array(total), np.zeros((d, 0)), np.zeros(0), 0.0)
        if np.abs(g - np.eye(d)).max() < 64 * d * ROUNDOFF:
            break
        r = _cholesky(g, n, shifted=k == 0)
        factors.append(r)
        product = r @ product
        if k > 1 and _settled(g, product):
            break
    _, s, vt = np.linalg.svd(product)
    keep = s > FLAT * s[0]
    return Whitener(n, np.array(total), vt[keep][:components].T.copy(), s[keep][:components] ** 2 / n, trace)


def _settled(g: np.ndarray, product: np.ndarray) -> bool:
    """Whether rows are orthonormal in every direction that they extend in: those
    of singular values of the composed factor above rounding."""
    u, s, _ = np.linalg.svd(product)
    q = u[:, s > FLAT * s[0]]
    return bool(np.abs(q.T @ g @ q - np.eye(q.shape[1])).max() < 64 * len(g) * ROUNDOFF)


def _projected(x: np.ndarray, w: Whitener) -> np.ndarray:
    return centred(x, w.n, [int(t) for t in w.total]) @ w.components / np.sqrt(w.eigenvalues)


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """Largest entry of (covariance of the whitened fit list minus identity)."""
    k = w.components.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        y = _projected(x, w)
        return np.concatenate([y.sum(axis=0), _upper(y.T @ y)])

    sums = _summed(fit, part, "double")
    mean = np.array([sums[i] for i in range(k)]) / w.n
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = [sums[k + i] / w.n for i in range(k * (k + 1) // 2)]
    return float(np.abs(_upper(cov - np.outer(mean, mean) - np.eye(k))).max())


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """``sum (n x - total)^2`` of every row, exactly: by 64-bit integers where they
    hold it, by Python's beyond."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([s % n for s in total], dtype=np.int64)
    off = x - whole
    most = int(np.abs(off).max(initial=0)) * n + n
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((off * n - rest) ** 2).sum(axis=1).tolist()
    return [sum((int(o) * n - int(r)) ** 2 for o, r in zip(row, rest)) for row in off]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``id, n, deviation, whitened, explained, identity_error`` per usable row:
    ``whitened`` and ``explained`` are arrays by component, ``deviation`` a
    ``decimal(38,0)``. Building it runs the passes."""
    rows = materialize(grid_rows(vectors, id_col, vector_col), "whiten-rows")
    fit = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("c")).select("x"), "whiten-fit")
    w = fit_whitener(fit, components)
    kind = rows.schema["id"].dataType.simpleString()
    made = "deviation decimal(38,0), whitened array<double>"
    if w is None or not len(w.eigenvalues):
        none = rows.limit(0) if w is None else rows
        out = none.select("id", F.lit(w.n if w else 0).cast("bigint").alias("n"),
                          F.lit(0).cast("decimal(38,0)").alias("deviation"),
                          F.array().cast("array<double>").alias("whitened"))
        return out.withColumn("explained", F.array().cast("array<double>")).withColumn(
            "identity_error", F.lit(0.0))
    error = identity_error(fit, w)
    k = w.components.shape[1]
    total = [int(t) for t in w.total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            y = _projected(x, w)
            ends = pa.array(np.arange(0, (len(y) + 1) * k, k), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(deviations(x, w.n, total), pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["id", "deviation", "whitened"])

    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.eigenvalues])
    return map_arrow(rows.select("id", "x"), run, f"id {kind}, {made}").select(
        "id", F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).alias("identity_error"))


def by_component(white: DataFrame) -> DataFrame:
    """A row per row and component of :func:`whiten`."""
    return white.select("id", "n", "deviation", "explained", "identity_error",
                        F.posexplode("whitened").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error")

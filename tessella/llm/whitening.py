"""Whitening of embeddings by matrix-free block subspace iteration.

Each finite vector c becomes the integers x = floor(64 c) + 1000000. Each distinct x counts once for sums, covariance and
components. A pass over these rows gives the product of the covariance with a block Q of columns, from rows centred
with exact integer sums, (n x - S) / n; the covariance itself is never formed. QR and Rayleigh-Ritz on the driver, of
d x block numbers, go on until the residuals certify every wanted component: each at most ``tolerance`` of the largest
eigenvalue, and no longer falling, unless they are at the level of rounding. Where the Ritz values predict many passes, as for
a flat spectrum, the block is doubled; a block of all dimensions ends at once.

Defined cases: a vector that is null, or has null or non-finite entries or entries beyond 2**40, is dropped. So is one of
another length than most distinct vectors have, of equally frequent lengths the longest. Repeated vectors are whitened
alike and fitted once; repeated or null ids are kept. Components whose eigenvalue is below 1e-12 of the largest can't be
whitened and are left out: one distinct vector gives no rows, and so does an empty table. Components of equal eigenvalues are any
basis of their space. A deviation beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

_EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """What is fitted: number and sums of the distinct vectors, unit components as columns, eigenvalues, trace, and the error of the whitened covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def integers(rows: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The rows whose vector is whole and finite, with x, its integers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= float(1 << 40)))  # NaN is above all numbers
    return rows.where(F.col(vector).isNotNull() & finite).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit integers, or Python's where these don't hold it."""
    whole, rest = sums // n, sums % n
    x = x - whole
    if len(x) and int(np.abs(x).max()) * n >= 1 << 62:
        x = x.astype(object)
    return x * n - rest


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_apart(x, n, sums) / n).astype(float)


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str = "double") -> np.ndarray:
    """The sum over all partitions of a matrix that each batch of vectors gives; combined by row in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(shape[1]))], names=["i", *(f"y{j}" for j in range(shape[1]))])

    names = [f"y{j}" for j in range(shape[1])]
    rows = fit.select("x").mapInArrow(run, ", ".join(["i long", *(f"{k} {kind}" for k in names)]))
    out = np.zeros(shape, np.int64 if kind == "long" else float)
    for row in rows.groupBy("i").agg(*(F.sum(k).alias(k) for k in names)).collect():
        out[row["i"]] = row[1:]
    return out


def fit_whitening(distinct: DataFrame, components: int = 16, spare: int = 16, tolerance: float = 1e-12, most_passes: int = 300, seed: int = 0) -> Whitening | None:
    """The largest components of distinct integer vectors x, a stored table; None where there are no vectors or all have no length."""
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return None
    d, n = lengths["d"], lengths["count"]
    fit = distinct.where(F.size("x") == d)
    sums = _summed(fit, lambda x: x.sum(0)[:, None], (d, 1), "long")[:, 0]
    trace = float(_summed(fit, lambda x: (_centred(x, n, sums) ** 2).sum(0)[:, None], (d, 1)).sum()) / n
    k, block, draw = min(components, d), min(d, components + spare), np.random.default_rng(seed)
    q, _ = np.linalg.qr(draw.standard_normal((d, block)))
    before = math.inf
    for _ in range(most_passes):
        y = _summed(fit, lambda x, q=q: (c := _centred(x, n, sums)).T @ (c @ q), q.shape) / n
        h = q.T @ y
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        z, y = q @ u, y @ u
        worst = float(np.linalg.norm(y[:, :k] - z[:, :k] * values[:k], axis=0).max())
        top = max(float(values[0]), 0.0)
        if worst <= 16 * _EPS * top or (worst <= tolerance * top and worst > before / 2):
            break
        before = worst
        rate = min(max(float(values[-1] / values[k - 1]) if values[k - 1] > 0 else 0.0, 1e-300), 1 - _EPS)
        if block < d and math.log(max(_EPS * top / worst, 1e-300)) / math.log(rate) > 8:
            block = min(d, 2 * block)
            y = np.concatenate([y, draw.standard_normal((d, block - y.shape[1])) * np.linalg.norm(y[:, -1])], 1)
        q, _ = np.linalg.qr(y)
    else:
        raise RuntimeError(f"the components are not certain after {most_passes} passes")
    k = int((values[:k] > 1e-12 * top).sum()) if top > 0 else 0
    z, values = z[:, :k], values[:k]
    error = 0.0
    if k:
        white = _summed(fit, lambda x: (w := np.hstack([_centred(x, n, sums) @ (z / np.sqrt(values)), np.ones((len(x), 1))])).T @ w, (k + 1, k + 1)) / n
        error = float(np.abs(white[:k, :k] - np.outer(white[:k, k], white[:k, k]) - np.eye(k)).max())
    return Whitening(n, sums, z, values, trace, error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares of n x - S."""
    apart = _apart(x, n, sums)
    if not len(x) or int(np.abs(apart).max()) ** 2 * x.shape[1] < 1 << 62:
        return (apart * apart).sum(1).tolist()
    exact = [sum(v * v for v in row) for row in apart.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Of each whole vector and component: key, component, n, deviation, whitened, explained and identity_error."""
    kept = integers(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector").select("key", "x")
    fit = fit_whitening(shared.cut(kept.select("x").distinct()), components)
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    schema = T.StructType([rows.schema[key], *(T.StructField(k, t) for k, t in zip(names, (T.IntegerType(), T.LongType(), T.LongType(), *[T.DoubleType()] * 3), strict=True))])
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, turned = len(fit.values), fit.components / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                m = len(x) * k
                columns = [
                    batch.column("key").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(m, fit.n, np.int64)),
                    pa.array([v for v in _deviations(x, fit.n, fit.sums) for _ in range(k)], pa.int64()),
                    pa.array((_centred(x, fit.n, fit.sums) @ turned).reshape(-1)),
                    pa.array(np.tile(fit.values / fit.trace, len(x))),
                    pa.array(np.full(m, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.where(F.size("x") == len(fit.sums)).mapInArrow(run, schema)

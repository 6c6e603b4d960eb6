"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Entries become integers on a grid; each distinct grid vector is in the fit list once.
2. Two passes over the fit list, each added up per task and then by Spark: the exact sums, and the
   scatter of the centred vectors. What reaches the driver has the size of the dimension squared.
3. Pivoted Cholesky factors the scatter, ``P^T C P = L L^T``; it stops where nothing is left, so flat
   directions have no component. One-sided Jacobi rotates the columns of ``L`` until they are
   orthogonal: their squared norms are the eigenvalues of ``C``, the normalised columns its vectors.
4. A pass over the fit list measures the covariance of the whitened vectors, and a last one over all
   rows projects them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import ship, stored, vector_rows

ship(sys.modules[__name__])

#: Grid values are kept this far from the ends of a long.
FURTHEST = 2.0**61


def grid(values: np.ndarray, steps: int, shift: int) -> np.ndarray:
    """``floor(steps * value) + shift``, held at +-2^61."""
    return np.clip(np.floor(values * steps), -FURTHEST, FURTHEST).astype(np.int64) + shift


def _listed(steps: int, shift: int):
    """(dim, digest, x) of rows with finite entries only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, values = vector_rows(batch.column(0))
            x = grid(values, steps, shift)
            edges = np.concatenate(([0], np.cumsum(length)))
            raw = [x[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            # Grid values near the shift are small numbers apart from it: four bytes each do, where they fit.
            near = x - shift
            small = [(near[a:b].astype(np.int32).tobytes() if b > a and abs(near[a:b]).max() < 2**31 else r)
                     for (a, b), r in zip(zip(edges, edges[1:]), raw)]
            yield pa.RecordBatch.from_arrays([pa.array(length.astype(np.int32)), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary()),
                                              pa.array(small, pa.binary())], names=["dim", "digest", "x"])
    return run


def _matrix(column: pa.Array, dim: int, shift: int) -> np.ndarray:
    """Grid vectors of a batch, a row each."""
    rows = [np.frombuffer(x.as_buffer(), np.int32 if len(x.as_buffer()) == 4 * dim else np.int64) for x in column]
    return np.array([r.astype(np.int64) + (shift if r.dtype == np.int32 else 0) for r in rows], np.int64).reshape(len(rows), dim)


def _sums(dim: int, shift: int):
    """(place, value): the sums of a task's vectors by place, and their number at place ``dim``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim + 1)
        for batch in batches:
            x = _matrix(batch.column(0), dim, shift)
            exact = x.size == 0 or np.abs(x.astype(float)).max() * len(x) < FURTHEST
            found = x.sum(0).tolist() if exact else x.astype(object).sum(0).tolist()
            total = [a + b for a, b in zip(total, [*found, len(x)])]
        import decimal
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(map(decimal.Decimal, total), pa.decimal128(38, 0))],
                                         names=["place", "value"])
    return run


@dataclass
class Centre:
    """The number of vectors and their sums, exactly."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean; whole steps are taken off before anything is rounded."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - S)^2`` of each row; None where that is no long."""
        whole, rest = np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)
        rough = ((self.n * (x - whole).astype(float) - rest) ** 2).sum(1)
        fits = rough < 9.0e18
        out = np.empty(len(x), object)
        out[fits] = ((self.n * (x[fits] - whole) - rest) ** 2).sum(1).tolist()
        for i in np.flatnonzero(~fits):
            exact = sum((self.n * int(a) - b) ** 2 for a, b in zip(x[i], self.sums))
            out[i] = exact if exact < 2**63 else None
        return out.tolist()


def _products(dim: int, shift: int, centre: Centre, basis: np.ndarray | None = None):
    """(place, value): the upper triangle of the sum of outer products of the centred vectors, or of what
    ``basis`` makes of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dim if basis is None else basis.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            y = centre.centred(_matrix(batch.column(0), dim, shift))
            y = y if basis is None else y @ basis
            total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array((i * size + j).astype(np.int64)), pa.array(total[i, j])], names=["place", "value"])
    return run


def _gathered(fit: DataFrame, task, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for place, value in fit.mapInArrow(task, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        out[divmod(place, size)] = value
    return np.triu(out) + np.triu(out, 1).T


def pivoted_cholesky(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, factor): ``c[order][:, order] = factor factor^T`` with a lower trapezoid as factor. Each step
    takes the largest pivot left and ends where that is rounding only."""
    left, order, d = c.copy(), np.arange(len(c)), len(c)
    factor, least = np.zeros_like(c), d * np.finfo(float).eps * max(c.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(left.diagonal()[k:].argmax())
        if not left[p, p] > least:
            return order, factor[:, :k]
        swap = [p, k]
        left[[k, p]] = left[swap]
        left[:, [k, p]] = left[:, swap]
        factor[[k, p]], order[[k, p]] = factor[swap], order[swap]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1:, k] = left[k + 1:, k] / factor[k, k]
        left[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return order, factor


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` turned until they are orthogonal. Each round of a sweep turns disjoint
    pairs of columns at once; after a sweep every two columns have met."""
    g, n = factor.copy(), factor.shape[1]
    ring = list(range(n + n % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a < n and b < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = map(np.array, zip(*pairs))
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, cosine.max())
            turn = cosine > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * (x - t * y), c * (y + t * x)
        if worst < 1e-15:
            break
    return g


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a scatter matrix, largest first, as far as its rank goes."""
    order, factor = pivoted_cholesky(scatter)
    turned = rotated(factor)
    norms = np.sqrt((turned * turned).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    vectors = np.empty((len(scatter), len(norms)))
    vectors[order] = turned[:, by_size] / norms[by_size]
    return norms[by_size] ** 2, vectors


def _projected(dim: int, steps: int, shift: int, centre: Centre, basis: np.ndarray, explained: list[float], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        for batch in batches:
            rows, length, values = vector_rows(batch.column(1))
            ours = length == dim
            x = grid(values[np.repeat(ours, length)], steps, shift).reshape(-1, dim)
            white, n = centre.centred(x) @ basis, len(x)
            every = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[ours][every])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                 pa.array(np.full(n * k, centre.n)), pa.array(centre.deviation(x), pa.int64()).take(pa.array(every)), pa.array(white.ravel()),
                 pa.array(np.tile(np.array(explained), n)), pa.array(np.full(n * k, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, steps: int = 64,
             shift: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row of ``vectors``
    and each of its first ``components`` components.

    Rows whose vector is null or holds null or non-finite entries are left out, as are those of another
    length than most distinct vectors have (the longer of a tie). Entries become ``floor(steps * entry) + shift``,
    held at +-2^61. Repeated rows and repeated keys are projected each, but count once in the fit. There are
    as many components as the rank allows: a table of one distinct vector, of none, or of empty vectors gives no rows.
    deviation is null where it is no long. Null keys stay null; extra columns are not read.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [F.col("key").alias(key), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    column = F.col(f"`{vector}`").alias("vector")
    fit = stored(vectors.select(column).mapInArrow(_listed(steps, shift), "dim int, digest binary, x binary")
                 .dropDuplicates(["digest"]).select("dim", "x"))
    most = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    none = vectors.sparkSession.createDataFrame([], schema).select(*names)
    if most is None or most["dim"] == 0:
        return none
    dim, fit = most["dim"], fit.filter(F.col("dim") == most["dim"]).select("x")
    found = dict(fit.mapInArrow(_sums(dim, shift), "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value")).collect())
    centre = Centre(int(found[dim]), [int(found[i]) for i in range(dim)])
    scatter = _gathered(fit, _products(dim, shift, centre), dim)
    values, units = eigen(scatter)
    k = min(components, len(values))
    if k == 0:
        return none
    basis = units[:, :k] / np.sqrt(values[:k] / centre.n)
    covariance = _gathered(fit, _products(dim, shift, centre, basis), k) / centre.n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = (values[:k] / scatter.trace()).tolist()
    return (vectors.select(F.col(f"`{key}`").alias("key"), column)
            .mapInArrow(_projected(dim, steps, shift, centre, basis, explained, error), schema).select(*names))

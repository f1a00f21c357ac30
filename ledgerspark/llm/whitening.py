"""Whitening of embeddings by the eigenvectors of their covariance, in two passes and a check.

Entries become whole numbers, so the first pass sums them exactly, whatever the order, and the mean
is a fraction without rounding. The second pass centres each batch on it before multiplying, and
adds up outer products with one matrix product a batch. Partial matrices, one for each partition,
are merged in a tree over the executors; the driver gets a few of them, of width * width doubles
each, and takes LAPACK's symmetric eigenvectors. The projection, width * components doubles, is
broadcast, and every row is projected where it lies: no vector is ever shuffled. A third pass
measures what was reached, the covariance of the whitened rows against the identity.

The input is read once for each pass, so it should be a stored table or staged by the caller.

Nulls: a vector that is null, or holds a null or an entry that isn't finite, is dropped; a null id
stays, with its row. A shorter vector counts as filled up with zeros. Repeated rows are rows of
their own. Components whose eigenvalue is zero up to rounding have no direction and are left out, so
fewer than ``components`` come back for vectors of a lower rank, none if all are equal; so do empty
tables. Entries of any finite size are exact: beyond 64 bits sums and deviations are Python
integers, and a deviation that is no 64-bit integer is returned as the nearest one. Other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerspark.llm.shared import filled, floored, merged, nearest_long, vectors_of

#: Rows of one matrix product: bounds a task's memory at BLOCK * width doubles, whatever a batch holds.
BLOCK = 4_096


def blocks(batches: Iterator[pa.RecordBatch], scale: float, shift: int, width: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the positions of usable vectors and these as whole numbers, as wide as their widest or ``width``."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            kept, vectors = vectors_of(some.column("v"))
            if len(kept):
                yield some, kept, floored(filled(vectors, width or max(map(len, vectors))), scale, shift)


def added(a: list[int], b: list[int]) -> list[int]:
    short, long = sorted((a, b), key=len)
    return [x + y for x, y in zip(short, long)] + long[len(short) :]


def sums(rows: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """First pass: the number of usable vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for _, kept, x in blocks(batches, scale, 0):
            n += len(kept)
            wide = x.dtype == object or np.abs(x).max(initial=0) * len(x) >= 2.0**62
            total = added(total, [int(s) for s in (x.astype(object) if wide else x).sum(0)])
        if n:
            yield pa.record_batch([pa.array([pickle.dumps((n, total))], pa.binary())], ["part"])

    n, total = merged(rows.mapInArrow(run, "part binary"), lambda a, b: (a[0] + b[0], added(a[1], b[1])), (0, []))
    return n, [s + n * shift for s in total]  # the shift of every entry, those filled up too


class Centred:
    """Rows less the exact mean ``total / n``: an integer quotient goes first, what remains is below one."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n = n
        self.quotient = [s // n for s in total]
        self.rest = [s - q * n for s, q in zip(total, self.quotient, strict=True)]

    def whole(self, x: np.ndarray) -> np.ndarray:
        """x less the quotient, exact."""
        wide = x.dtype == object or max(map(abs, self.quotient), default=0) >= 1 << 62
        return (x.astype(object) if wide else x) - np.array(self.quotient, object if wide else np.int64)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - total) squared, exact."""
        away = self.whole(x)
        wide = away.dtype == object or x.shape[1] * (float(np.abs(away).max()) * self.n + self.n) ** 2 >= 2.0**62
        if wide:
            away = away.astype(object)
        return nearest_long(((self.n * away - np.array(self.rest, object if wide else np.int64)) ** 2).sum(1))


def covariance(rows: DataFrame, scale: float, shift: int, centred: Centred) -> np.ndarray:
    """Second pass: the mean of the outer products of the centred rows."""
    width = len(centred.rest)
    shared = rows.sparkSession.sparkContext.broadcast(centred)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, _, x in blocks(batches, scale, shift, width):
            y = shared.value.doubles(x)
            total += y.T @ y
        yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    return merged(rows.mapInArrow(run, "part binary"), np.add, np.zeros((width, width))) / centred.n


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that aren't zero up to rounding, falling, and their unit eigenvectors as columns."""
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    size = np.abs(v).max() or 1.0
    e, vectors = np.linalg.eigh((v + v.T) / (2 * size))
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > len(v) * np.finfo(float).eps * max(e.max(), 0.0)]
    return e[order] * size, vectors[:, order]


def moments(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sum of centred outer products."""
    mean = y.mean(0)
    return len(y), mean, (y - mean).T @ (y - mean)


def joined(a: tuple, b: tuple) -> tuple:
    """Moments of both, centred on the mean of both."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


def identity_error(rows: DataFrame, scale: float, shift: int, centred: Centred, projection: np.ndarray) -> float:
    """Third pass: the largest entry of the whitened rows' covariance less the identity."""
    width, found = projection.shape
    shared = rows.sparkSession.sparkContext.broadcast((centred, projection))
    nothing = (0, np.zeros(found), np.zeros((found, found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, project = shared.value
        total = nothing
        for _, _, x in blocks(batches, scale, shift, width):
            total = joined(total, moments(centre.doubles(x) @ project))
        yield pa.record_batch([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    n, _, total = merged(rows.mapInArrow(run, "part binary"), joined, nothing)
    return float(np.abs(total / n - np.eye(found)).max())


def whiten(
    vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each usable row's coordinates: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c counts as floor(scale * c) + shift.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector].alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, total = sums(rows, scale, shift)
    if not n or not total:
        return vectors.sparkSession.createDataFrame([], out)
    centred = Centred(n, total)
    v = covariance(rows, scale, shift, centred)
    e, directions = principal(v, components)
    if not len(e):
        return vectors.sparkSession.createDataFrame([], out)
    projection = directions / np.sqrt(e)
    error = identity_error(rows, scale, shift, centred, projection)
    share = e / np.trace(v)
    shared = vectors.sparkSession.sparkContext.broadcast((centred, projection))
    found = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, project = shared.value
        for some, kept, x in blocks(batches, scale, shift, len(project)):
            y, each = centre.doubles(x) @ project, np.repeat(np.arange(len(kept)), found)
            yield pa.record_batch(
                [
                    some.column("id").take(pa.array(kept[each])),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(kept))),
                    pa.array(np.full(len(each), n)),
                    pa.array(np.array(centre.deviation(x), np.int64)[each]),
                    pa.array(y.ravel()),
                    pa.array(np.tile(share, len(kept))),
                    pa.array(np.full(len(each), error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out)

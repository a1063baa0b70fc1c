"""NumPy kernels on Arrow batches of vectors.

A matrix product selects candidates; the distances that are reported are summed again as
differences in order of position, so they equal those of the column expressions bit for bit.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Further candidates that a selection by matrix product keeps, against its rounding.
MARGIN = 8
#: Distances of one matrix product.
PRODUCT = 1 << 21
#: Digits at which distances are ranked; ties go to the smaller id.
RANK_DIGITS = 9


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's folder, where they share it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column as rows."""
    return np.asarray(column.flatten(), dtype=np.float32 if column.type.value_type == pa.float32() else np.float64).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def exact_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed in order of position."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j].astype(np.float64) - b[:, j].astype(np.float64)
        total += d * d
    return total


def all_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed in order of position."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return total


def nearest(vectors: np.ndarray, centroids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest centroids of each vector, nearest first, ties by id."""
    k = min(k, len(ids))
    _, at, d = top_pairs(vectors, centroids, ids, k)
    return ids[at].reshape(-1, k), d.reshape(-1, k)


def top_pairs(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest vectors: query rows, vector rows and exact distances.

    Works through the queries in blocks, so that a block's distances take PRODUCT values at most.
    """
    v = vectors.astype(np.float64)
    v_sq = (v * v).sum(1)
    m = min(k + MARGIN, len(v))
    rows, ats, ds = [], [], []
    for s in range(0, len(queries), step := max(1, PRODUCT // max(1, len(v)))):
        own = queries[s : s + step]
        q = own.astype(np.float64)
        if m < len(v):
            rough = (q * q).sum(1)[:, None] + v_sq[None, :] - 2 * q @ v.T
            at = np.argpartition(rough, m - 1, axis=1)[:, :m].ravel()
        else:
            at = np.tile(np.arange(len(v)), len(q))
        row = np.repeat(np.arange(len(q)), m)
        d = exact_l2(own[row], vectors[at])
        order = np.lexsort((ids[at], np.round(d, RANK_DIGITS), row))
        row, at, d = row[order], at[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[keep] + s)
        ats.append(at[keep])
        ds.append(d[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(ats), np.concatenate(ds)


class TopK:
    """The k nearest rows of each query among all that are added, one row per id, in bounded memory."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.most = k, 2 * n_queries * k + (1 << 16)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, row: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.parts.append((row, ids, dist))
        self.size += len(row)
        if self.size > self.most:
            self._cut()

    def _cut(self) -> None:
        row, ids, dist = (np.concatenate([p[c] for p in self.parts]) for c in range(3))
        order = np.lexsort((ids, np.round(dist, RANK_DIGITS), row))
        row, ids, dist = row[order], ids[order], dist[order]
        # a vector has the same distance wherever it is found, so its rows adjoin
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, ids, dist = row[new], ids[new], dist[new]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.parts = [(row[keep], ids[keep], dist[keep])]
        self.size = int(keep.sum())

    def batches(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What is left, as (query_id, vec_id, dist)."""
        if self.parts:
            self._cut()
            row, ids, dist = self.parts[0]
            for at in range(0, len(row), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row[own]]), pa.array(ids[own]), pa.array(dist[own])], names=["query_id", "vec_id", "dist"])


def fixed_point(x: np.ndarray, scale: float) -> np.ndarray:
    """Rounded multiples of 1 / scale, halves away from zero."""
    y = x.astype(np.float64) * scale
    return (np.sign(y) * np.floor(np.abs(y) + 0.5)).astype(np.int64)


def totals(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """Sums over all rows of the integers that ``add`` adds to an array of ``size`` for a batch; one job, whatever the number of rows."""
    on_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                add(out, batch)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "n"])

    found = rows.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[np.asarray(found["at"])] = np.asarray(found["n"])
    return out


def order_statistics(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], ranks: np.ndarray, bits: int = 31, step: int = 11) -> np.ndarray:
    """Exact order statistics of columns over all rows, without a sort.

    ``values`` makes a batch a matrix of integers from 0 to under 2**bits, a column for each
    column of ``ranks`` (wanted, columns; from 0). Each pass counts the next ``step`` bits of the
    values that share a wanted one's bits so far.
    """
    wanted, width = ranks.shape
    prefix, left, low = np.zeros(ranks.shape, np.int64), ranks.astype(np.int64), bits
    while low > 0:
        take = min(step, low)
        low -= take

        def add(out: np.ndarray, batch: pa.RecordBatch, prefix=prefix, low=low, take=take) -> None:
            x = values(batch)
            bin_of = np.arange(width) << take | (x >> low & (1 << take) - 1)
            for k in range(wanted):
                own = bin_of[x >> (low + take) == prefix[k]]
                out[k * width << take : (k + 1) * width << take] += np.bincount(own, minlength=width << take)

        below = totals(rows, wanted * width << take, add).reshape(wanted, width, -1).cumsum(2)
        at = (below <= left[:, :, None]).sum(2)
        left = left - np.where(at > 0, np.take_along_axis(below, np.maximum(at - 1, 0)[:, :, None], 2)[:, :, 0], 0)
        prefix = prefix << take | at
    return prefix

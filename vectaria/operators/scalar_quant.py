"""Scalar quantiser: rotation, one codebook for all coordinates, optional calibration.

A vector is normalised, rotated and quantised coordinate by coordinate; its code keeps a scale
that makes the estimated inner product unbiased in the direction of the vector, and its squared
norm. Scores are sums of table entries, one table per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.kernels import TopK, matrix, on_workers, order_statistics, totals
from vectaria.functions.state import durable
from vectaria.operators.rank import nearest_of
from vectaria.operators.search import Queries, in_passes, probe_pass

#: Fixed values of the quantiser.
ROTATION_SEED = 42
TRAIN_ROWS = 50_000
POOL_VALUES = 2_000_000
LLOYD_ROUNDS = 50
LLOYD_STOP = 1e-7
CALIBRATION_ROWS = 1000
TINY = 1e-10
LUT_STRIDE = 16


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """A random orthogonal matrix, at nine digits."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return np.round(q * np.sign(np.diag(r)), 9)


def in_order_dot(m: np.ndarray, u: np.ndarray) -> np.ndarray:
    """u @ m.T with products summed in order of position."""
    out = np.zeros((len(u), len(m)))
    for j in range(m.shape[1]):
        out += u[:, j, None] * m[None, :, j]
    return out


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and squared norms; norms of at most TINY give zero rows."""
    v = v.astype(np.float64)
    sq = np.zeros(len(v))
    for j in range(v.shape[1]):
        sq += v[:, j] * v[:, j]
    norm = np.sqrt(sq)
    return np.where(norm[:, None] <= TINY, 0.0, v / np.maximum(norm, TINY)[:, None]), sq


def lloyd_max(pool: np.ndarray, levels: int, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """Centroids of a one-dimensional quantiser on fixed-point values (1e-9); a value on a boundary is in the lower bin."""
    pool = np.sort(pool)
    n = len(pool)
    at = np.minimum(n - 1, ((np.arange(levels) + 0.5) / levels * n).astype(np.int64))
    c = pool[at] / 1e9
    total = np.concatenate([[0], np.cumsum(pool)])
    values = pool / 1e9
    for _ in range(rounds):
        cuts = np.concatenate([[0], np.searchsorted(values, (c[1:] + c[:-1]) / 2, "right"), [n]])
        count = np.diff(cuts)
        new = np.where(count > 0, (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(count, 1) / 1e9, c)
        moved = np.abs(new - c).max()
        c = new
        if moved < LLOYD_STOP:
            break
    return c


def calibrate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shift and scale that map each coordinate's 5 % and 95 % order statistics onto those of a pool of one coordinate a row."""
    n, dim = x.shape
    lo, hi = int(0.05 * n), int(0.95 * n)
    s = np.sort(x, axis=0)
    pool = np.sort(x[np.arange(n), np.arange(n) % dim])
    return _onto(s[lo], s[hi], pool[lo], pool[hi])


def _onto(lo: np.ndarray, hi: np.ndarray, pool_lo: float, pool_hi: float) -> tuple[np.ndarray, np.ndarray]:
    """Shift and scale that map lo and hi onto the pool's."""
    wide = hi - lo
    goal = pool_hi - pool_lo
    scale = np.where((wide < 1e-6) | (goal < 1e-6), 1.0, goal / np.maximum(wide, 1e-6))
    return np.where(wide < 1e-6, 0.0, pool_lo / scale - lo), scale


@dataclass
class ScalarQuantiser:
    """What a fit leaves: rotation, centroids, shift and scale of each coordinate."""

    bits: int
    rotation: np.ndarray
    centroids: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    boundaries: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must be from 1 to 8")
        self.boundaries = (self.centroids[1:] + self.centroids[:-1]) / 2

    def rotated(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, sq = unit(v)
        return np.round(in_order_dot(self.rotation, u), 9), sq

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, scales and squared norms."""
        r, sq = self.rotated(v)
        code = np.searchsorted(self.boundaries, (r + self.shift) * self.scale, side="left").astype(np.uint8)
        back = self.centroids[code] / self.scale - self.shift
        ip = np.zeros(len(v))
        for j in range(v.shape[1]):
            ip += r[:, j] * back[:, j]
        return code, np.sqrt(sq) / np.maximum(ip, TINY), sq

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query: entries by coordinate and code, and a bias."""
        r = np.round(in_order_dot(self.rotation, q.astype(np.float64)), 9)
        return (r / self.scale)[:, :, None] * self.centroids[None, None, :], -(r * self.shift).sum(1)

    def bytes_per_vector(self, stored: bool = True) -> int:
        packed = -(-self.bits * len(self.scale) // 8)
        return packed + 8 * stored


def bounded_sample(vectors: DataFrame, dim: int, max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """All vectors in order of id or, of more than ``max_rows``, about that many chosen by a hash of the id."""
    n = vectors.count()
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30))) if n > max_rows else vectors
    sample = rows.orderBy("vec_id").select("embedding").toArrow()
    return np.array(sample["embedding"].to_pylist(), np.float32).reshape(-1, dim)


def fit(vectors: DataFrame, dim: int, bits: int, *, calibration: bool = False, rounds: int = LLOYD_ROUNDS, seed: int = ROTATION_SEED, max_rows: int | None = TRAIN_ROWS) -> ScalarQuantiser:
    """Fits on a bounded sample (of more than ``max_rows`` rows, a share chosen by a hash of the id) or, with ``max_rows`` None, on every value of all rows, by a job a pass."""
    turn = rotation(dim, seed)
    if max_rows is None:
        shift, scale = calibrate_all(vectors, dim, turn) if calibration and vectors.count() >= CALIBRATION_ROWS else (np.zeros(dim), np.ones(dim))
        return ScalarQuantiser(bits, turn, lloyd_max_all(vectors, dim, turn, 1 << bits, rounds), shift, scale)
    x = bounded_sample(vectors, dim, max_rows)
    r = np.round(in_order_dot(turn, unit(x)[0]), 9)
    pool = np.rint(r.ravel() * 1e9).astype(np.int64)
    pool = pool[:: max(1, -(-len(pool) // POOL_VALUES))]
    if not len(pool):
        pool = np.zeros(1, np.int64)
    shift, scale = calibrate(r) if calibration and len(r) >= CALIBRATION_ROWS else (np.zeros(dim), np.ones(dim))
    return ScalarQuantiser(bits, turn, lloyd_max(pool, 1 << bits, rounds), shift, scale)


def fixed_rotated(turn: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rotated unit rows in fixed point (1e-9); all are under 2**30 in size."""
    return np.rint(np.round(in_order_dot(turn, unit(v)[0]), 9) * 1e9).astype(np.int64)


def lloyd_max_all(vectors: DataFrame, dim: int, turn: np.ndarray, levels: int, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """``lloyd_max`` on every rotated value of all rows: exact quantiles, then a job a round."""
    rows = vectors.select("embedding")
    n = rows.count() * dim
    if not n:
        return np.zeros(levels)
    values = lambda batch: fixed_rotated(turn, matrix(batch.column(0), dim))
    at = np.minimum(n - 1, ((np.arange(levels) + 0.5) / levels * n).astype(np.int64))
    c = (order_statistics(rows, lambda batch: values(batch).reshape(-1, 1) + (1 << 30), at[:, None])[:, 0] - (1 << 30)) / 1e9
    for _ in range(rounds):

        def add(out: np.ndarray, batch: pa.RecordBatch, edges=(c[1:] + c[:-1]) / 2) -> None:
            x = values(batch).ravel()
            own = np.searchsorted(edges, x / 1e9, "left")
            out[:levels] += np.bincount(own, minlength=levels)
            np.add.at(out[levels:], own, x)

        count, total = totals(rows, 2 * levels, add).reshape(2, levels)
        new = np.where(count > 0, total / np.maximum(count, 1) / 1e9, c)
        if (new == c).all():
            break
        c = new
    return c


def calibrate_all(vectors: DataFrame, dim: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``calibrate`` on all rotated rows in order of id; nothing for no rows.

    Rows are sorted once, as the pool's coordinate goes by a row's place; the order statistics
    need no sort of the values.
    """
    rows = durable(vectors.orderBy("vec_id").select(F.monotonically_increasing_id().alias("m"), "embedding"))
    # dense places: rows of the partitions before, and the row's number in its own
    counts = dict(rows.groupBy(F.shiftright("m", 33).alias("p")).count().collect())
    first = np.zeros(max(counts, default=0) + 1, np.int64)
    for p, k in counts.items():
        first[p + 1 :] += k
    n = sum(counts.values())
    if not n:
        return np.zeros(0), np.zeros(0)

    def values(batch: pa.RecordBatch) -> np.ndarray:
        m = np.asarray(batch.column(0))
        place = first[m >> 33] + (m & (1 << 33) - 1)
        x = fixed_rotated(turn, matrix(batch.column(1), dim)) + (1 << 30)
        return np.concatenate([x, x[np.arange(len(x)), place % dim, None]], 1)

    ranks = np.array([[int(0.05 * n)] * (dim + 1), [int(0.95 * n)] * (dim + 1)])
    lo, hi = (order_statistics(rows, values, ranks) - (1 << 30)) / 1e9
    return _onto(lo[:dim], hi[:dim], lo[dim], hi[dim])


CODES = "cluster_id int, vec_id bigint, codes binary, scale double, sqnorm double"


def encode(postings: DataFrame, quantiser: ScalarQuantiser) -> DataFrame:
    """Code rows of posting rows (cluster_id, vec_id, embedding)."""
    on_workers(postings.sparkSession)
    shared = postings.sparkSession.sparkContext.broadcast(quantiser)
    dim = len(quantiser.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, scale, sq = shared.value.encode(matrix(batch.column(2), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(sq)], names=["cluster_id", "vec_id", "codes", "scale", "sqnorm"])

    return postings.select("cluster_id", "vec_id", "embedding").mapInArrow(run, CODES)


def quantise_table(table: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A query's table at 8 bits: integers, least value and step (1.0 for a constant table)."""
    lo = float(table.min())
    span = float(table.max()) - lo
    step = span / 255 if span > 0 else 1.0
    x = (table - lo) / step
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8), lo, step


def estimates(quantiser: ScalarQuantiser, q: np.ndarray, code: np.ndarray, scale: np.ndarray, sq: np.ndarray, lut_bits: int = 0) -> np.ndarray:
    """Estimated squared distance of each query to each coded vector; with lut_bits 8 through integer tables."""
    table, bias = quantiser.tables(q)
    q_sq = unit(q)[1]
    total = np.zeros((len(q), len(code)))
    if lut_bits == 8:
        for k in range(len(q)):
            lut, lo, step = quantise_table(table[k])
            s = np.zeros(len(code), np.int64)
            for j in range(code.shape[1]):
                s += lut[j, code[:, j]]
            total[k] = step * s + code.shape[1] * lo
    else:
        for j in range(code.shape[1]):
            total += table[:, j, :][:, code[:, j]]
    return q_sq[:, None] + sq[None, :] - 2 * ((bias[:, None] + total) * scale[None, :])


def scores(queries: DataFrame, codes: DataFrame, quantiser: ScalarQuantiser, *, lut_bits: int = 0) -> DataFrame:
    """(query_id, vec_id, dist): the estimate of every query to every code, without a ranking."""
    dim = len(quantiser.scale)

    def one_pass(q: Queries) -> DataFrame:
        shared = q.send(codes.sparkSession, quantiser)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, quantiser = shared.value
            for batch in batches:
                ids, scale, sq = (np.asarray(batch.column(c)) for c in (0, 2, 3))
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, dim)
                for b in range(0, len(q.ids), 256):
                    est = np.round(estimates(quantiser, q.vectors[b : b + 256], code, scale, sq, lut_bits), 7)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids[b : b + 256], len(ids))), pa.array(np.tile(ids, len(est))), pa.array(est.ravel())], names=["query_id", "vec_id", "dist"])

        return codes.select("vec_id", "codes", "scale", "sqnorm").mapInArrow(run, "query_id bigint, vec_id bigint, dist double")

    on_workers(codes.sparkSession)
    return in_passes(queries, one_pass, dim)


def search(queries: DataFrame, codes: DataFrame, cells, quantiser: ScalarQuantiser, k: int, nprobe: int, *, lut_bits: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k least estimates among the probed cells, one per vector."""
    if k <= 0:
        raise ValueError("k must be positive")
    dim = len(quantiser.scale)

    def one_pass(q: Queries) -> DataFrame:
        probe_pass(q, cells, nprobe)
        wanted = sorted(q.probed)
        shared = q.send(codes.sparkSession, quantiser)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, quantiser = shared.value
            best = TopK(len(q.ids), k)
            for batch in batches:
                cell, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, dim)
                scale, sq = np.asarray(batch.column(3)), np.asarray(batch.column(4))
                for c in np.unique(cell).tolist():
                    rows = q.probed.get(c)
                    if rows is None:
                        continue
                    at = np.flatnonzero(cell == c)
                    for b in range(0, len(rows), 256):
                        own = rows[b : b + 256]
                        est = np.round(estimates(quantiser, q.vectors[own], code[at], scale[at], sq[at], lut_bits), 7)
                        # ties go to the smaller id
                        by = np.argsort(ids[at], kind="stable")
                        pick = by[np.argsort(est[:, by], axis=1, kind="stable")[:, :k]]
                        best.add(np.repeat(own, pick.shape[1]), ids[at][pick.ravel()], np.take_along_axis(est, pick, 1).ravel())
            yield from best.batches(q.ids)

        return codes.where(F.col("cluster_id").isin(wanted)).mapInArrow(run, "query_id bigint, vec_id bigint, dist double")

    on_workers(codes.sparkSession)
    return nearest_of(in_passes(queries, one_pass, dim), k)

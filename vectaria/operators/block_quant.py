"""Block vector quantiser: rotated unit vectors cut in blocks, one codebook a block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.kernels import TopK, all_l2, matrix, on_workers, totals
from vectaria.operators.rank import nearest_of
from vectaria.operators.scalar_quant import ROTATION_SEED, TINY, TRAIN_ROWS, bounded_sample, in_order_dot, rotation, unit
from vectaria.operators.search import Queries, in_passes

#: Fixed value: rounds of training at most.
ROUNDS = 25


@dataclass
class BlockQuantiser:
    """Rotation and codebook (blocks, words, block size)."""

    rotation: np.ndarray
    book: np.ndarray

    @property
    def dim(self) -> int:
        return self.book.shape[0] * self.book.shape[2]

    def rotated(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, sq = unit(v)
        return np.round(in_order_dot(self.rotation, u), 9), sq

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, scales and squared norms; ties go to the lowest code."""
        r, sq = self.rotated(v)
        size = self.book.shape[2]
        code = np.empty((len(v), len(self.book)), np.int32)
        ip = np.zeros(len(v))
        for g, words in enumerate(self.book):
            part = r[:, g * size : (g + 1) * size]
            code[:, g] = np.round(all_l2(part, words), 9).argmin(1)
            back = words[code[:, g]]
            for j in range(size):
                ip += part[:, j] * back[:, j]
        return code, np.sqrt(sq) / np.maximum(ip, TINY), sq

    def decode(self, code: np.ndarray, sq: np.ndarray) -> np.ndarray:
        """Vectors of the original norm in the direction of the code words."""
        x = self.book[np.arange(len(self.book))[None, :], code].reshape(len(code), -1)
        total = (x * x).sum(1)
        y = in_order_dot(self.rotation.T, x)
        return np.where(total[:, None] <= 1e-12, 0.0, np.sqrt(sq)[:, None] * y / np.sqrt(np.maximum(total, 1e-12))[:, None])

    def estimates(self, q: np.ndarray, code: np.ndarray, scale: np.ndarray, sq: np.ndarray) -> np.ndarray:
        r = np.round(in_order_dot(self.rotation, q.astype(np.float64)), 9)
        size = self.book.shape[2]
        total = np.zeros((len(q), len(code)))
        for g, words in enumerate(self.book):
            lut = in_order_dot(words, r[:, g * size : (g + 1) * size])
            total += lut[:, code[:, g]]
        return unit(q)[1][:, None] + sq[None, :] - 2 * total * scale[None, :]

    def bytes_per_vector(self) -> int:
        bits = int(np.ceil(np.log2(max(2, self.book.shape[1]))))
        return -(-bits * len(self.book) // 8) + 8


def block_kmeans(x: np.ndarray, words: int, rounds: int = ROUNDS, seed: int | None = ROTATION_SEED) -> np.ndarray:
    """Code words of one block.

    Seeds are drawn with replacement (or, with ``seed`` None, are the first rows); an empty
    word is drawn anew (or stays); training stops when no row changes its word.
    """
    rng = np.random.default_rng(seed) if seed is not None else None
    c = x[rng.integers(0, len(x), words)].copy() if rng is not None else x[:words].copy()
    words = len(c)
    last = None
    for _ in range(rounds):
        own = np.round(all_l2(x, c), 9).argmin(1)
        if last is not None and (own == last).all():
            break
        last = own
        count = np.bincount(own, minlength=words)
        total = np.zeros(c.shape, np.int64)
        np.add.at(total, own, np.rint(x * 1e9).astype(np.int64))
        full = count > 0
        c[full] = total[full] / count[full, None] / 1e9
        if rng is not None and not full.all():
            c[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return c


def fit(vectors: DataFrame, dim: int, block: int, words: int, *, rounds: int = ROUNDS, seed: int | None = ROTATION_SEED, max_rows: int | None = TRAIN_ROWS) -> BlockQuantiser:
    """Fits on a bounded sample (blocks are independent and are trained as a job, one group each) or, with ``max_rows`` None, on all rows by a job a round."""
    if dim % block:
        raise ValueError("the block size must divide the dimension")
    if max_rows is None:
        return fit_all(vectors, dim, block, words, rounds, seed)
    spark = vectors.sparkSession
    on_workers(spark)
    x = bounded_sample(vectors, dim, max_rows)
    turn = rotation(dim)
    shared = spark.sparkContext.broadcast(np.round(in_order_dot(turn, unit(x)[0]), 9))
    n_blocks = dim // block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                c = block_kmeans(shared.value[:, g * block : (g + 1) * block], words, rounds, None if seed is None else seed + g)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(c), pa.int64()), pa.array(range(len(c)), pa.int32()), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["g", "code", "word"])

    made = spark.range(0, n_blocks, 1, min(n_blocks, 64)).mapInArrow(run, "g bigint, code int, word array<double>").orderBy("g", "code").collect()
    return BlockQuantiser(turn, np.array([r["word"] for r in made]).reshape(n_blocks, -1, block))


def fit_all(vectors: DataFrame, dim: int, block: int, words: int, rounds: int = ROUNDS, seed: int | None = ROTATION_SEED) -> BlockQuantiser:
    """Fits on all rows: tasks assign them and emit fixed-point sums for each word, so that the sums' order can't matter.

    Seeds are the rows of the least hashes of (seed, id) or, with ``seed`` None, of the least ids; an empty word stays.
    """
    order = [F.xxhash64(F.lit(seed), F.col("vec_id"))] if seed is not None else []
    start = vectors.orderBy(*order, "vec_id").limit(words).collect()
    turn, n_blocks, m = rotation(dim), dim // block, len(start)
    rotated = lambda v: np.round(in_order_dot(turn, unit(v)[0]), 9)
    x = rotated(np.array([r["embedding"] for r in start], np.float32).reshape(-1, dim))
    book = np.ascontiguousarray(x.reshape(m, n_blocks, block).swapaxes(0, 1))
    for _ in range(rounds if m else 0):

        def add(out: np.ndarray, batch: pa.RecordBatch, book=book) -> None:
            r, sums = rotated(matrix(batch.column(0), dim)), out.reshape(n_blocks, m, block + 1)
            for g, words in enumerate(book):
                part = r[:, g * block : (g + 1) * block]
                own = np.round(all_l2(part, words), 9).argmin(1)
                sums[g, :, 0] += np.bincount(own, minlength=m)
                np.add.at(sums[g, :, 1:], own, np.rint(part * 1e9).astype(np.int64))

        sums = totals(vectors.select("embedding"), n_blocks * m * (block + 1), add).reshape(n_blocks, m, block + 1)
        count = sums[:, :, :1]
        new = np.where(count > 0, sums[:, :, 1:] / np.maximum(count, 1) / 1e9, book)
        if (new == book).all():
            break
        book = new
    return BlockQuantiser(turn, book)


CODES = "vec_id bigint, codes array<int>, scale double, sqnorm double"


def encode(vectors: DataFrame, quantiser: BlockQuantiser) -> DataFrame:
    on_workers(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, scale, sq = shared.value.encode(matrix(batch.column(1), shared.value.dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.tolist(), pa.list_(pa.int32())), pa.array(scale), pa.array(sq)], names=["vec_id", "codes", "scale", "sqnorm"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, CODES)


def decode(codes: DataFrame, quantiser: BlockQuantiser) -> DataFrame:
    """(vec_id, decoded) of code rows."""
    on_workers(codes.sparkSession)
    shared = codes.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array(batch.column(1).to_pylist(), np.int64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.decode(code, np.asarray(batch.column(2))).tolist(), pa.list_(pa.float64()))], names=["vec_id", "decoded"])

    return codes.select("vec_id", "codes", "sqnorm").mapInArrow(run, "vec_id bigint, decoded array<double>")


def scores(queries: DataFrame, codes: DataFrame, quantiser: BlockQuantiser) -> DataFrame:
    """(query_id, vec_id, dist): the estimate of every query to every code, without a ranking."""
    on_workers(codes.sparkSession)

    def one_pass(q: Queries) -> DataFrame:
        shared = q.send(codes.sparkSession, quantiser)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, quantiser = shared.value
            for batch in batches:
                ids, scale, sq = (np.asarray(batch.column(c)) for c in (0, 2, 3))
                code = np.array(batch.column(1).to_pylist(), np.int64).reshape(batch.num_rows, -1)
                for b in range(0, len(q.ids) if len(ids) else 0, 256):
                    est = np.round(quantiser.estimates(q.vectors[b : b + 256], code, scale, sq), 7)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids[b : b + 256], len(ids))), pa.array(np.tile(ids, len(est))), pa.array(est.ravel())], names=["query_id", "vec_id", "dist"])

        return codes.mapInArrow(run, "query_id bigint, vec_id bigint, dist double")

    return in_passes(queries, one_pass, quantiser.dim)


def search(queries: DataFrame, codes: DataFrame, quantiser: BlockQuantiser, k: int) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k least estimates over all codes."""
    if k <= 0:
        raise ValueError("k must be positive")
    on_workers(codes.sparkSession)

    def one_pass(q: Queries) -> DataFrame:
        shared = q.send(codes.sparkSession, quantiser)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, quantiser = shared.value
            best = TopK(len(q.ids), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.asarray(batch.column(0))
                code = np.array(batch.column(1).to_pylist(), np.int64).reshape(batch.num_rows, -1)
                scale, sq = np.asarray(batch.column(2)), np.asarray(batch.column(3))
                by = np.argsort(ids, kind="stable")
                for b in range(0, len(q.ids), 256):
                    est = np.round(quantiser.estimates(q.vectors[b : b + 256], code, scale, sq), 7)
                    pick = by[np.argsort(est[:, by], axis=1, kind="stable")[:, :k]]
                    best.add(np.repeat(np.arange(b, b + len(pick)), pick.shape[1]), ids[pick.ravel()], np.take_along_axis(est, pick, 1).ravel())
            yield from best.batches(q.ids)

        return codes.mapInArrow(run, "query_id bigint, vec_id bigint, dist double")

    return nearest_of(in_passes(queries, one_pass, quantiser.dim), k)

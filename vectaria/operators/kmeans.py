"""K-means training (Lloyd) and its parts.

A round is one job: every task assigns its vectors and emits sums per cell, which Spark adds up;
the driver gets n_clusters times (dim + 1) numbers. Sums are in fixed point, so their order cannot
matter. What training reads is written once, if it is a share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.kernels import fixed_point, matrix, nearest, on_workers
from vectaria.functions.state import durable

SCALE = 1e9
#: Fixed values of the training rule.
ROUNDS = 25
#: Rows that training reads at most unless a caller asks for another bound; a hash picks them.
TRAIN_ROWS = 2_000_000


class Centroids:
    """A bounded set of cell centres: ids, vectors, and the round in which each was made."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, made: np.ndarray | None = None):
        self.ids, self.vectors = np.asarray(ids, np.int32), np.asarray(vectors, np.float64)
        self.made = np.full(len(self.ids), -1, np.int32) if made is None else np.asarray(made, np.int32)

    def frame(self, spark) -> DataFrame:
        rows = [(int(i), [float(x) for x in v], int(m)) for i, v, m in zip(self.ids, self.vectors, self.made, strict=True)]
        return spark.createDataFrame(rows, "cluster_id int, centroid array<double>, created_round int")

    @staticmethod
    def of(df: DataFrame) -> Centroids:
        rows = df.orderBy("cluster_id").collect()
        return Centroids(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def cell_sums(vectors: DataFrame, cells: Centroids, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and fixed-point sums of the vectors nearest to each centroid."""
    on_workers(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        count, total = np.zeros(len(c.ids), np.int64), np.zeros((len(c.ids), dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), dim)
                own = np.searchsorted(c.ids, nearest(v, c.vectors, c.ids, 1)[0][:, 0])
                count += np.bincount(own, minlength=len(c.ids))
                np.add.at(total, own, fixed_point(v, SCALE))
        at = np.flatnonzero(count)
        width = dim + 1
        both = np.concatenate([count[at, None], total[at]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, width)), pa.array(np.tile(np.arange(width), len(at))), pa.array(both.ravel())], names=["cell", "at", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "cell bigint, at bigint, n bigint").groupBy("cell", "at").agg(F.sum("n").alias("n"))
    out = np.zeros((len(cells.ids), dim + 1), np.int64)
    for cell, at, n in sums.collect():
        out[cell, at] = n
    return out[:, 0], out[:, 1:]


def vector_mean(vectors: DataFrame, by: str) -> DataFrame:
    """(by, mean) of each group's vectors, element by element, from fixed-point sums."""
    e = vectors.select(by, F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy(by, "pos").agg((F.sum(F.round(F.col("x").cast("double") * SCALE).cast("long")) / F.count(F.lit(1)) / SCALE).alias("x"))
    return m.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def train(vectors: DataFrame, n_clusters: int, dim: int, *, rounds: int = ROUNDS, seed: int | None = 42, empty: str = "keep", max_rows: int | None = TRAIN_ROWS) -> Centroids:
    """Centroids of (vec_id, embedding) rows.

    Starting points are the rows of the ``n_clusters`` least hashes of (seed, id), or with
    ``seed`` None of the least ids. With fewer rows than cells, centroids are uniform random
    in [-1, 1]. An empty cell keeps its centroid, or becomes zero (``empty="zero"``). Above
    ``max_rows`` rows training reads a share of them chosen by a hash of the id.
    """
    if empty not in ("keep", "zero"):
        raise ValueError("empty must be keep or zero")
    order = [F.xxhash64(F.lit(seed), F.col("vec_id"))] if seed is not None else []
    start = vectors.orderBy(*order, "vec_id").limit(n_clusters).collect()
    if len(start) < n_clusters:
        rng = np.random.default_rng(seed or 0)
        return Centroids(np.arange(n_clusters), rng.uniform(-1, 1, (n_clusters, dim)))
    cells = Centroids(np.arange(n_clusters), np.array([r["embedding"] for r in start], np.float64))
    if max_rows is not None and (n := vectors.count()) > max_rows:
        vectors = durable(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30))))
    for _ in range(rounds):
        count, total = cell_sums(vectors, cells, dim)
        mean = total / np.maximum(count, 1)[:, None] / SCALE
        cells.vectors = np.where(count[:, None] > 0, mean, cells.vectors if empty == "keep" else 0.0)
    return cells

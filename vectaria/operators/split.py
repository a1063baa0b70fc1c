"""Adaptive splitting of overloaded cells.

Cells whose live rows exceed the integer part of mean times threshold are split by 2-means
over their live rows, all cells at once and with partial sums, so no cell is gathered into one
task. Seeds are each cell's two least live ids; ties go to side 0; an empty side keeps its
centroid; rows go to the side of the last assignment, before the last update of the means.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.kernels import exact_l2, fixed_point, matrix, on_workers
from vectaria.operators.kmeans import SCALE


def cell_sizes(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(cluster_id, physical_size, live_size) of cells with rows."""
    dead = tombstones.select("vec_id", F.lit(True).alias("dead"))
    return postings.select("cluster_id", "vec_id").join(dead, "vec_id", "left").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("physical_size"), F.count_if(F.col("dead").isNull()).alias("live_size"))


def limit_of(total_live: int, n_clusters: int, threshold: float) -> int:
    return math.floor(total_live / n_clusters * threshold)


def overloaded(sizes: DataFrame, n_clusters: int, threshold: float) -> DataFrame:
    """(cluster_id, live_size) of the cells to split."""
    total = sizes.agg(F.coalesce(F.sum("live_size"), F.lit(0))).first()[0]
    return sizes.where(F.col("live_size") > limit_of(total, n_clusters, threshold)).select("cluster_id", "live_size")


def _sides(v: np.ndarray, cell: np.ndarray, centers: dict[int, np.ndarray]) -> np.ndarray:
    side = np.zeros(len(cell), np.int32)
    for c in np.unique(cell).tolist():
        at = np.flatnonzero(cell == c)
        a, b = (np.broadcast_to(centers[c][s], v[at].shape) for s in (0, 1))
        side[at] = np.round(exact_l2(v[at], b), 9) < np.round(exact_l2(v[at], a), 9)
    return side


def two_means(live: DataFrame, cells: list[int], dim: int, rounds: int) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Centres of both sides of each cell, and (cluster_id, vec_id, side) of its live postings."""
    on_workers(live.sparkSession)
    rows = live.where(F.col("cluster_id").isin(cells)).select("cluster_id", "vec_id", "embedding")
    least = rows.groupBy("cluster_id").agg(F.min(F.struct("vec_id", "embedding")).alias("a"))
    second = rows.join(least, "cluster_id").where("vec_id > a.vec_id").groupBy("cluster_id").agg(F.min(F.struct("vec_id", "embedding")).alias("b"))
    centers = {r[0]: np.array([r[1], r[2]], np.float64) for r in least.join(second, "cluster_id").select("cluster_id", "a.embedding", "b.embedding").collect()}
    rows = rows.where(F.col("cluster_id").isin(sorted(centers)))
    used = centers
    for _ in range(max(1, rounds)):
        used = centers
        shared = live.sparkSession.sparkContext.broadcast(used)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                cell, v = np.asarray(batch.column(0)), matrix(batch.column(2), dim)
                side, fixed = _sides(v, cell, c), fixed_point(v, SCALE)
                for key in set(zip(cell.tolist(), side.tolist(), strict=True)):
                    own = (cell == key[0]) & (side == key[1])
                    sums[key] = sums.get(key, 0) + np.append(own.sum(), fixed[own].sum(0))
            width = dim + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([k[s] for k in sums], np.int64), width)) for s in (0, 1)] + [pa.array(np.tile(np.arange(width), len(sums))), pa.array(np.concatenate(list(sums.values())).astype(np.int64) if sums else np.zeros(0, np.int64))],
                names=["cell", "side", "at", "n"],
            )

        got = rows.mapInArrow(run, "cell bigint, side bigint, at bigint, n bigint").groupBy("cell", "side", "at").agg(F.sum("n").alias("n")).collect()
        sums = {}
        for cell, side, at, n in got:
            sums.setdefault((cell, side), np.zeros(dim + 1, np.int64))[at] = n
        centers = {c: np.array([sums[c, s][1:] / sums[c, s][0] / SCALE if (c, s) in sums else m[s] for s in (0, 1)]) for c, m in used.items()}
    shared = live.sparkSession.sparkContext.broadcast(used)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column(0))
            side = _sides(matrix(batch.column(2), dim), cell, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(side)], names=["cluster_id", "vec_id", "side"])

    return centers, rows.mapInArrow(label, "cluster_id int, vec_id bigint, side int")

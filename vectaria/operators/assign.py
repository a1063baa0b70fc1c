"""Vectors or queries against centroids: the k nearest cells of each row.

Centroids are bounded by the index's number of cells and go to every task; rows stay where
they are, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectaria.functions.kernels import matrix, nearest, on_workers
from vectaria.functions.vectors import l2_distance
from vectaria.operators.kmeans import Centroids
from vectaria.operators.rank import top_k


def nearest_cells(rows: DataFrame, cells: Centroids, k: int, *, key: str = "vec_id", vector: str = "embedding", rank: str = "assign_rank") -> DataFrame:
    """Rows (key, rank, cluster_id, cell_dist), one for each of the k nearest cells, by the kernel."""
    on_workers(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(cells)
    dim = cells.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, d = nearest(matrix(batch.column(1), dim), c.vectors, c.ids, k)
                m = ids.shape[1]
                key_of = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), m)))
                yield pa.RecordBatch.from_arrays([key_of, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), batch.num_rows)), pa.array(ids.ravel().astype(np.int32)), pa.array(d.ravel())], names=[key, rank, "cluster_id", "cell_dist"])

    schema = T.StructType([rows.schema[key], T.StructField(rank, T.IntegerType()), T.StructField("cluster_id", T.IntegerType()), T.StructField("cell_dist", T.DoubleType())])
    return rows.select(key, vector).mapInArrow(run, schema)


def nearest_cells_sql(rows: DataFrame, centroids: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", rank: str = "assign_rank") -> DataFrame:
    """The same by column expressions: a join with the broadcast centroids and a ranked window."""
    pairs = rows.select(key, vector).crossJoin(F.broadcast(centroids.select("cluster_id", "centroid")))
    d = pairs.select(key, "cluster_id", l2_distance(F.col(vector), F.col("centroid")).alias("cell_dist"))
    return top_k(d, k, by=key, dist="cell_dist", tie="cluster_id", rank=rank).select(key, rank, "cluster_id", "cell_dist")


def postings_of(vectors: DataFrame, cells: Centroids, soft_k: int) -> DataFrame:
    """Posting rows of (vec_id, embedding): one for each of the soft_k nearest cells."""
    on_workers(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    dim = cells.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), dim)
                ids, _ = nearest(v, c.vectors, c.ids, soft_k)
                m = ids.shape[1]
                at = pa.array(np.repeat(np.arange(batch.num_rows), m))
                norm = np.zeros(len(v))
                for j in range(dim):
                    norm += v[:, j].astype(np.float64) ** 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.ravel().astype(np.int32)), batch.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), batch.num_rows)), batch.column(1).take(at), pa.array(np.repeat(norm, m))],
                    names=["cluster_id", "vec_id", "assign_rank", "embedding", "norm_sq"],
                )

    return vectors.select("vec_id", "embedding").mapInArrow(run, POSTINGS)


POSTINGS = "cluster_id int, vec_id bigint, assign_rank int, embedding array<float>, norm_sq double"

"""Search operators: exact, by cells, and their parts.

Queries are a set of bounded size per pass: they go to the tasks that read vectors, as do the ids
of deleted vectors up to ``BROADCAST_IDS``, so vectors are not shuffled; each task keeps the k
nearest of each query over all that it reads and sends on no more. Larger query sets are worked
through in passes of ``QUERY_BLOCK``, whose results are written before the next pass begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectaria.functions.kernels import TopK, matrix, on_workers, top_pairs
from vectaria.functions.state import durable
from vectaria.functions.vectors import l2_distance
from vectaria.operators.assign import nearest_cells
from vectaria.operators.kmeans import Centroids
from vectaria.operators.rank import dedup, nearest_of, top_k

#: Queries in one pass (at 1,000 dimensions 200 MB of float32).
QUERY_BLOCK = 50_000
#: Deleted ids that are sent to all tasks at most (about 56 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Vectors in one matrix product.
VECTOR_BLOCK = 4096

FOUND = "query_id bigint, vec_id bigint, dist double"


class Queries:
    """Ids and vectors of one pass, and the cells that each query probes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, probed: dict[int, np.ndarray] | None = None):
        self.ids, self.vectors, self.probed = ids, vectors, probed
        self.shared: list = []

    def __getstate__(self) -> dict:
        return {**self.__dict__, "shared": []}

    def send(self, spark, *more):
        """The queries, and what else a pass needs, as a broadcast that ends with the pass."""
        self.shared.append(spark.sparkContext.broadcast((self, *more)))
        return self.shared[-1]


def in_passes(queries: DataFrame, run: Callable[[Queries], DataFrame], dim: int) -> DataFrame:
    """``run`` on blocks of the queries, results united."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = []
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = part.select("query_id", F.col("qv").cast("array<float>")).toArrow().combine_chunks()
        ids = np.asarray(rows["query_id"].to_numpy(), np.int64)
        q = Queries(ids, matrix(rows["qv"].combine_chunks() if isinstance(rows["qv"], pa.ChunkedArray) else rows["qv"], dim))
        found = run(q)
        if blocks > 1:
            found = durable(found)
            for shared in q.shared:
                shared.destroy()
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def live(rows: DataFrame, tombstones: DataFrame, n: int | None = None) -> DataFrame:
    """Rows whose vector isn't one of the ``n`` deleted ones (counted if not given); before any distance is computed."""
    dead = tombstones.select("vec_id")
    n = dead.count() if n is None else n
    return rows.join(F.broadcast(dead) if n <= BROADCAST_IDS else dead, "vec_id", "left_anti").select(*rows.columns) if n else rows


def brute_force(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest of all vectors."""
    if k <= 0:
        raise ValueError("k must be positive")
    on_workers(vectors.sparkSession)

    def one_pass(q: Queries) -> DataFrame:
        shared = q.send(vectors.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (q,) = shared.value
            best = TopK(len(q.ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows if len(q.ids) else 0, VECTOR_BLOCK):
                    part = batch.slice(at, VECTOR_BLOCK)
                    ids = np.asarray(part.column(0))
                    row, v, d = top_pairs(q.vectors, matrix(part.column(1), dim), ids, k)
                    best.add(row, ids[v], d)
            yield from best.batches(q.ids)

        return vectors.select("vec_id", "embedding").mapInArrow(run, FOUND)

    return nearest_of(in_passes(queries, one_pass, dim), k)


def all_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query beside every vector, the queries in blocks of a checked size that go to all tasks."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    part = lambda k: queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
    return reduce(DataFrame.unionByName, [vectors.crossJoin(F.broadcast(part(k))) for k in range(blocks)])


def brute_force_sql(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same by column expressions, for small query sets."""
    pairs = all_pairs(queries, vectors)
    d = pairs.select("query_id", "vec_id", l2_distance(F.col("qv"), F.col("embedding")).alias("dist"))
    return top_k(d, k).select("query_id", "rank", "vec_id", "dist")


def probes(queries: DataFrame, cells: Centroids, nprobe: int) -> DataFrame:
    """(query_id, probe_rank, cluster_id, cell_dist): the nprobe nearest cells of each query."""
    q = queries.select("query_id", F.col("qv").cast("array<float>").alias("qv"))
    return nearest_cells(q, cells, max(1, min(nprobe, len(cells.ids))), key="query_id", vector="qv", rank="probe_rank")


def probe_pass(q: Queries, cells: Centroids, nprobe: int) -> Queries:
    """The same for the queries of a pass: which queries probe each cell."""
    row, at, _ = top_pairs(q.vectors, cells.vectors, cells.ids, max(1, min(nprobe, len(cells.ids))))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    q.probed = {int(cells.ids[a[0]]): r for a, r in zip(np.split(at, cuts), np.split(row, cuts), strict=True) if len(a)}
    return q


def ivf(queries: DataFrame, postings: DataFrame, cells: Centroids, k: int, nprobe: int) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest among the postings of each query's probed cells.

    ``postings`` are live rows. The filter on probed cells reaches the scan; an index keeps its
    files in order of cells, so that other cells' rows are mostly passed over.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    on_workers(postings.sparkSession)
    dim = cells.vectors.shape[1]

    def one_pass(q: Queries) -> DataFrame:
        probe_pass(q, cells, nprobe)
        wanted = sorted(q.probed)
        shared = q.send(postings.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (q,) = shared.value
            best = TopK(len(q.ids), k)
            for batch in batches:
                cell, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                v = matrix(batch.column(2), dim)
                for c in np.unique(cell).tolist():
                    rows = q.probed.get(c)
                    at = np.flatnonzero(cell == c)
                    for s in range(0, len(at) if rows is not None else 0, VECTOR_BLOCK):
                        own = at[s : s + VECTOR_BLOCK]
                        row, hit, d = top_pairs(q.vectors[rows], v[own], ids[own], k)
                        best.add(rows[row], ids[own[hit]], d)
            yield from best.batches(q.ids)

        return postings.where(F.col("cluster_id").isin(wanted)).select("cluster_id", "vec_id", "embedding").mapInArrow(run, FOUND)

    return nearest_of(in_passes(queries, one_pass, dim), k)


def ivf_sql(queries: DataFrame, postings: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """The same by an equi-join of probes and postings and column expressions."""
    pairs = postings.join(probed.select("query_id", "cluster_id"), "cluster_id").join(queries, "query_id")
    d = pairs.select("query_id", "vec_id", l2_distance(F.col("qv"), F.col("embedding")).alias("dist"))
    return top_k(dedup(d), k).select("query_id", "rank", "vec_id", "dist")

"""SQL surface: results of a search as a temporary view, and a table function over postings."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from vectaria.functions.kernels import RANK_DIGITS, on_workers
from vectaria.plans.index import VectorIndex


def register_search(index: VectorIndex, view: str, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
    """Registers ``view`` over the results of (query_id, qv) rows, for use in SQL; returns them."""
    found = index.search(queries, k, nprobe)
    found.createOrReplaceTempView(view)
    return found


def ann_search(index: VectorIndex, query: list[float], k: int = 10, nprobe: int | None = None) -> DataFrame:
    """One query: (rank, vec_id, dist)."""
    q = index.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, qv array<float>")
    return index.search(q, k, nprobe).select("rank", "vec_id", "dist").orderBy("rank")


class CellTopK:
    """The k rows (cluster_id, vec_id, embedding) of a partition nearest to a vector; keeps k rows at most."""

    def __init__(self):
        self.best: list[tuple[float, int, float, int]] = []
        self.k = 0

    def eval(self, row, query: list[float], k: int):
        self.k = k
        d = 0.0
        for x, y in zip(query, row["embedding"], strict=True):
            d += (x - y) * (x - y)
        entry = (-round(d, RANK_DIGITS), -row["vec_id"], d, row["cluster_id"])
        if len(self.best) < k:
            heapq.heappush(self.best, entry)
        elif k and entry > self.best[0]:
            heapq.heapreplace(self.best, entry)

    def terminate(self):
        for _, vec_id, d, cell in sorted(self.best, reverse=True):
            yield cell, -vec_id, d


def register_cell_top_k(spark: SparkSession, name: str = "cell_top_k") -> None:
    """``SELECT * FROM cell_top_k(TABLE(postings) PARTITION BY (cluster_id), array(...), k)``: cluster_id, vec_id, dist."""
    on_workers(spark)
    spark.udtf.register(name, udtf(CellTopK, returnType="cluster_id int, vec_id bigint, dist double"))

"""Evaluation operators: recall, distance ratio, leaks, imbalance, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectaria.functions.state import durable
from vectaria.functions.vectors import l2_distance
from vectaria.operators.rank import top_k
from vectaria.operators.search import BROADCAST_IDS


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: shared results over queries times k."""
    hits = found.select("query_id", "vec_id").join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"])
    n = truth.agg(F.count_distinct("query_id").alias("n_queries"))
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(n).select("n_queries", "hits", F.round(F.col("hits") / (F.col("n_queries") * k), 6).alias("recall"))


def resorted(truth: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Given neighbours (query_id, vec_id), such as a published file's, in order of their true distances: (query_id, rank, vec_id, dist).

    The truth's ids go to the tasks that read vectors if they are few, so these aren't shuffled.
    """
    pairs = truth.select("query_id", "vec_id").distinct()
    n = pairs.count()
    at = vectors.join(F.broadcast(pairs) if n <= BROADCAST_IDS else pairs, "vec_id")
    found = at.join(queries, "query_id").select("query_id", "vec_id", l2_distance(F.col("qv"), F.col("embedding")).alias("dist"))
    return top_k(found, k).select("query_id", "rank", "vec_id", "dist")


def distance_ratio(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mean over queries of mean found distance over mean true distance."""
    mean = lambda df, c: df.groupBy("query_id").agg(F.avg(F.sqrt("dist")).alias(c))
    both = mean(found, "f").join(mean(truth, "t"), "query_id")
    return both.agg(F.round(F.avg(F.col("f") / (F.col("t") + 1e-10)), 6).alias("ratio"))


def leaks(found: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Results that are deleted vectors; must be empty."""
    return found.join(tombstones.select("vec_id"), "vec_id", "left_semi")


def pareto(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points not dominated: no other has x at most as large and a larger or equal y (ties keep the first by x, -y)."""
    # one row per x in ranges of x; a range starts from the largest y of those before it
    best = points.groupBy(x).agg(F.max(y).alias(y)).repartitionByRange(x)
    best = durable(best.select(x, y, F.spark_partition_id().alias("__range")))
    most = best.groupBy("__range").agg(F.max(y).alias("__most"))
    before = most.select("__range", F.max("__most").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    w = Window.partitionBy("__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    m = F.greatest(F.max(y).over(w), F.col("__before"))
    return best.join(F.broadcast(before), "__range").withColumn("__m", m).where(F.col("__m").isNull() | (F.col(y) > F.col("__m"))).select(x, y)


def cluster_hits(probed: DataFrame) -> DataFrame:
    """Queries that probe each cell."""
    return probed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("hits"))

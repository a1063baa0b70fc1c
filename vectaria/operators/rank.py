"""Rankings with a total order: distance at nine digits, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectaria.functions.state import durable


def top_k(rows: DataFrame, k: int, by: str = "query_id", dist: str = "dist", tie: str = "vec_id", rank: str = "rank") -> DataFrame:
    """The k rows of least distance of each ``by``, with their rank from 1; planned as a group limit."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(by).orderBy(F.round(dist, 9), tie)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def nearest_of(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest of each query, one row per vector, after a single exchange by query."""
    return top_k(dedup(rows.repartition("query_id")), k).select("query_id", "rank", "vec_id", "dist")


def dedup(rows: DataFrame, dist: str = "dist") -> DataFrame:
    """One row per query and vector, that of the least distance."""
    return rows.groupBy("query_id", "vec_id").agg(F.min(dist).alias(dist))


def first_ids(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` least of distinct (vec_id) rows, from ranges of ids and their numbers; no task gets more than a range."""
    ranged = durable(ids.select("vec_id").repartitionByRange("vec_id").select("vec_id", F.spark_partition_id().alias("p")))
    whole, rest = [], None
    for p, count in sorted(ranged.groupBy("p").count().collect()):
        if n >= count:
            whole.append(p)
            n -= count
        else:
            rest = p
            break
    rank = F.row_number().over(Window.partitionBy("p").orderBy("vec_id"))
    part = ranged.where(F.col("p") == (-1 if rest is None else rest)).withColumn("r", rank).where(F.col("r") <= n).select("vec_id")
    return ranged.where(F.col("p").isin(whole)).select("vec_id").union(part)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """A value at the digits of query results; never negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)

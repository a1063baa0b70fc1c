"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it Spark removes a query's shuffle files once the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only on a local master where none is set, as in tests."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if found is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="vectaria-state-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold for queries made and run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession):
    """Queries made and run inside leave no shuffle files behind; their results must not be lazy."""
    return settings(spark, **{CLEAN: "true"})


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and cut from their lineage."""
    checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's file systems, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables of one operation in the shared folder, dropped once they are done with."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        self.spark, self.base, self.at = spark, base or f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a table; a former table of the name is dropped once this one is written."""
        former, path = self.at.get(name), f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        self.at[name] = path
        if former:
            remove(self.spark, former)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """``df`` as a table of its own, which nothing drops but ``remove``; its folder and its rows."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.at.pop(name, None):
                remove(self.spark, path)

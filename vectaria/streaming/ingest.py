"""Streaming inserts: micro-batches into an index, each applied once.

With ``path`` every batch ends with a save there, whose manifest holds the batch's number beside
the index: after a restart, ``store.load(spark, path)`` and the same stream checkpoint go on where
the last complete save stands, and a batch that is replayed is ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectaria.plans.index import VectorIndex
from vectaria.sources import store


def apply_batch(index: VectorIndex, batch: DataFrame, batch_id: int, id_col: str | None, vec_col: str, path: str | None = None) -> None:
    """Adds a micro-batch unless it was added before; a replay leaves the index as it is."""
    if batch_id <= index.last_batch:
        return
    index.add(batch, id_col, vec_col)
    index.last_batch = batch_id
    if path is not None:
        store.save(index, path)


def insert_stream(
    index: VectorIndex, stream: DataFrame, checkpoint: str, *, id_col: str | None = "vec_id", vec_col: str = "embedding", available_now: bool = True, path: str | None = None
) -> StreamingQuery:
    """Starts a query that adds each micro-batch; batch sizes are the source's (maxFilesPerTrigger and the like)."""
    writer = stream.writeStream.foreachBatch(lambda df, k: apply_batch(index, df, k, id_col, vec_col, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def insert_chunks(index: VectorIndex, vectors: Iterable[list[float]], chunk_size: int = 1000) -> tuple[int, int] | None:
    """Adds vectors of a Python iterator in chunks; returns the first and last id, None for no vectors."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be positive")
    it: Iterator = iter(vectors)
    first, last = None, None
    while chunk := [([float(x) for x in v],) for v in islice(it, chunk_size)]:
        got = index.add(index.spark.createDataFrame(chunk, "embedding array<float>").coalesce(1), None)
        first, last = (got[0] if first is None else first), got[1]
    return None if first is None else (first, last)

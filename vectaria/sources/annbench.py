"""Files of nearest-neighbour benchmarks: arrays ``train``, ``test`` and ``neighbors`` of one data set.

A folder holds them as ``<name>.npy``; an ``.hdf5`` or ``.h5`` file holds them as data sets, for which
h5py must be installed on the workers. Tasks read ranges of rows themselves, so no array passes
through the driver; the file must lie where all of them can open it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vectaria.functions.kernels import on_workers

#: Rows that one task reads.
ROWS = 16_384


def _open(path: str, name: str) -> np.ndarray:
    """The array, read on access."""
    if path.endswith((".hdf5", ".h5")):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("h5py is needed to read HDF5 files; a folder of .npy files needs nothing") from e
        return h5py.File(path, "r")[name]
    return np.load(f"{path.rstrip('/')}/{name}.npy", mmap_mode="r")


def load(spark: SparkSession, path: str, name: str = "train", *, limit: int | None = None, normalise: bool = False) -> DataFrame:
    """(vec_id, embedding) of ``train``, (query_id, qv) of ``test``, or (query_id, rank, vec_id) of ``neighbors``.

    Ids are positions from 0. ``limit`` takes the first rows; with ``normalise`` vectors get unit
    length (zero vectors stay).
    """
    if name not in ("train", "test", "neighbors"):
        raise ValueError("name must be train, test or neighbors")
    on_workers(spark)
    n = _open(path, name).shape[0]
    n = n if limit is None else min(n, limit)
    fields = {"train": ["vec_id", "embedding"], "test": ["query_id", "qv"], "neighbors": ["query_id", "rank", "vec_id"]}[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                x = np.asarray(_open(path, name)[a : min(a + ROWS, n)])
                ids = np.arange(a, a + len(x))
                if name == "neighbors":
                    k = x.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(x.ravel().astype(np.int64))], names=fields)
                    continue
                x = x.astype(np.float32)
                if normalise:
                    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                    x = (x / np.where(norm > 1e-10, norm, 1.0)[:, None]).astype(np.float32)
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=fields)

    ddl = {"train": "vec_id bigint, embedding array<float>", "test": "query_id bigint, qv array<float>", "neighbors": "query_id bigint, rank int, vec_id bigint"}[name]
    return spark.range(0, n, ROWS, max(1, -(-n // ROWS))).mapInArrow(run, ddl)

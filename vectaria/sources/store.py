"""Saving and loading an index: Parquet pieces and a manifest for each generation.

A save writes pieces that the path hasn't got yet under fresh names, and then a new manifest
that names all of an index's pieces; nothing that a former manifest names is changed. Readers take
the newest complete manifest, so they see the index as it was before or after a save. An index
that was loaded from a path, or saved to it, writes its pieces there, so its next save there
writes a manifest alone. All goes through Spark's file systems.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from vectaria.functions.state import Scratch, remove
from vectaria.operators.kmeans import Centroids
from vectaria.operators.scalar_quant import ScalarQuantiser
from vectaria.plans.config import IndexConfig
from vectaria.plans.index import VectorIndex

COUNTERS = ("n_issued", "next_id", "round", "generation", "last_batch", "n_dead", "n_purged")


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete manifests, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("manifest-"))
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def _read(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{name}").first()[0])


def save(index: VectorIndex, path: str) -> str:
    """Writes the index under ``path``, which is its home from then on; returns the manifest's folder."""
    spark, path = index.spark, path.rstrip("/")
    home = f"{path}/pieces"
    if index.tables.base != home:
        index.tables = Scratch(spark, "index", home)
    for name, piece in index.pieces.items():
        # pieces of another home are copied as one, in order of cells
        if any(not p.startswith(f"{home}/") for p in piece.paths):
            index.superseded += [p for p in piece.replace(index.tables, name, piece.rows) if not p.startswith(f"{home}/")]
    q = index.quantiser
    cells = index.cells and [(int(i), v.tolist(), int(m)) for i, v, m in zip(index.cells.ids, index.cells.vectors, index.cells.made, strict=True)]
    manifest = {
        "config": index.config.as_dict(), "pieces": {name: {p.removeprefix(f"{path}/"): cells for p, cells in piece.hidden.items()} for name, piece in index.pieces.items()}, "cells": cells,
        **{k: getattr(index, k) for k in COUNTERS}, "physical": list(index.physical.items()), "dead": list(index.dead.items()),
        "quantiser": q and {"bits": q.bits, **{k: getattr(q, k).tolist() for k in ("rotation", "centroids", "shift", "scale")}},
    }
    every = _manifests(spark, path)
    number = int(every[-1].rsplit("-", 1)[1]) + 1 if every else 0
    out = f"{path}/manifest-{number:012d}"
    # an existing folder of the name, left by a save that was broken off, is not taken for this one
    remove(spark, out)
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(out)
    return out


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index as it was saved last; it can be added to, deleted from and saved again, there or elsewhere."""
    path = path.rstrip("/")
    every = _manifests(spark, path)
    if not every:
        raise FileNotFoundError(f"no index at {path}")
    return restore(spark, path, _read(spark, path, every[-1]))


def restore(spark: SparkSession, path: str, manifest: dict) -> VectorIndex:
    """An index from what a manifest says: its tables, centroids and counts."""
    m = manifest
    index = VectorIndex(spark, IndexConfig(**m["config"]), f"{path}/pieces")
    for name, paths in m["pieces"].items():
        index.pieces[name].read({f"{path}/{p}": cells for p, cells in paths.items()})
    if m["cells"]:
        index.cells = Centroids(*(np.array([c[k] for c in m["cells"]]) for k in range(3)))
    for k in COUNTERS:
        setattr(index, k, m[k])
    index.physical, index.dead = ({int(c): int(n) for c, n in m[k]} for k in ("physical", "dead"))
    if (q := m["quantiser"]) is not None:
        index.quantiser = ScalarQuantiser(q["bits"], *(np.array(q[k]) for k in ("rotation", "centroids", "shift", "scale")))
    return index


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all manifests but the newest ``keep``, and the pieces that none of these names."""
    path = path.rstrip("/")
    every = _manifests(spark, path)
    used = {p for name in every[-keep:] for paths in _read(spark, path, name)["pieces"].values() for p in paths}
    for name in every[:-keep]:
        remove(spark, f"{path}/{name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pieces")
    for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
        if f"pieces/{f.getPath().getName()}" not in used:
            remove(spark, f"{path}/pieces/{f.getPath().getName()}")

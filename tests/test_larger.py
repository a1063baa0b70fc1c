"""Queries against their SQL on tables larger than the given ones, and at the edges of their rules."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vectaria.functions.kernels import order_statistics
from vectaria.operators import block_quant, scalar_quant
from vectaria.operators.scalar_quant import TRAIN_ROWS
from vectaria.oracles import ORACLE_SQL
from vectaria.queries import BASE_IDS, DIM, QUERIES

duckdb = pytest.importorskip("duckdb")


def embeddings(folder, ids):
    """A table of unit vectors with the given ids; its folder."""
    v = np.random.default_rng(3).standard_normal((len(ids), DIM))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    at = pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.ListArray.from_arrays(at, pa.array(v.ravel())), "label": pa.array(np.asarray(ids) % 10, pa.int64())}), f"{folder}/embeddings.parquet")
    return str(folder)


def both(spark, name, d):
    """A query's rows and its SQL's, columns and rows in order."""
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
        theirs = db.sql(ORACLE_SQL[name])
        columns, want = sorted(theirs.columns), theirs.fetchall()
        own = [theirs.columns.index(c) for c in columns]
    mine = QUERIES[name](spark, d)
    assert sorted(mine.columns) == columns
    cell = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(tuple(cell(r[c]) for c in columns) for r in mine.collect()), sorted(tuple(cell(r[k]) for k in own) for r in want)


# 58 of the first 400 ids are deleted: compacted below 580 rows, not from 580 on
@pytest.mark.parametrize(("n", "rows"), [(579, 1), (580, 0), (1500, 0), (BASE_IDS, 0)])
def test_auto_compact_with_few_deletes(spark, tmp_path, n, rows):
    mine, want = both(spark, "auto_compact", embeddings(tmp_path, range(n)))
    assert mine == want
    assert n == BASE_IDS or len(mine) == rows


@pytest.fixture(scope="module")
def above_the_bound(tmp_path_factory):
    """More rows than a quantiser's sample has at most; ids with gaps, not in order."""
    ids = np.arange(TRAIN_ROWS + 1500) * 3 + 1
    return embeddings(tmp_path_factory.mktemp("many"), np.random.default_rng(5).permutation(ids))


@pytest.mark.parametrize("name", ["tq_calibration", "tq_codebook"])
def test_scalar_fits_read_all_rows(spark, above_the_bound, name):
    mine, want = both(spark, name, above_the_bound)
    assert mine == want


def test_order_statistics_equal_sorting(spark):
    x = np.random.default_rng(1).integers(0, 1 << 31, (5000, 3))
    x[:2000, 1] = 7
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(5)
    ranks = np.array([[0, 1999, 2500], [4999, 2000, 2500]])
    found = order_statistics(rows, lambda batch: np.asarray(batch.column(0).flatten()).reshape(-1, 3), ranks)
    assert (found == np.take_along_axis(np.sort(x, axis=0), ranks, 0)).all()


@pytest.mark.parametrize("n", [0, 1, 1500])
def test_fits_on_all_rows_equal_fits_on_arrays(spark, tmp_path, n):
    e = spark.read.parquet(embeddings(tmp_path, range(n)) + "/embeddings.parquet").repartition(6)
    a, b = (scalar_quant.fit(e, DIM, 3, calibration=True, rounds=4, max_rows=m) for m in (TRAIN_ROWS, None))
    assert (a.centroids == b.centroids).all() and (a.shift == b.shift).all() and (a.scale == b.scale).all()


def test_block_fit_reads_all_rows(spark, above_the_bound):
    mine, want = both(spark, "block_vq_train", above_the_bound)
    assert mine == want


@pytest.mark.parametrize("n", [3, 1500])
def test_block_fit_on_all_rows_equals_fit_on_arrays(spark, tmp_path, n):
    e = spark.read.parquet(embeddings(tmp_path, range(n)) + "/embeddings.parquet").repartition(6)
    a, b = (block_quant.fit(e, DIM, 8, 16, rounds=4, seed=None, max_rows=m) for m in (TRAIN_ROWS, None))
    assert (a.book == b.book).all()

"""Behaviour of the index: recall, deletes, splits, quantisers, persistence, streams."""

import numpy as np
import pytest

from vectaria.functions.state import checkpoint_dir
from vectaria.functions.udtf import ann_search, register_search
from vectaria.operators import search
from vectaria.operators.assign import nearest_cells, nearest_cells_sql, postings_of
from vectaria.plans.config import IndexConfig
from vectaria.plans.flat_vq import FlatVQIndex
from vectaria.plans.index import VectorIndex
from vectaria.sources import store
from vectaria.streaming.ingest import apply_batch, insert_chunks, insert_stream


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)


def asked(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "query_id bigint, qv array<float>")


def build(spark, x, **more):
    i = VectorIndex(spark, IndexConfig(**({"dim": x.shape[1], "n_clusters": 8, "nprobe": 8, "train_rounds": 5} | more)))
    i.add(frame(spark, x))
    return i


def ids(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def truth(x, q, k, alive=None):
    d = ((q[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    if alive is not None:
        d[:, ~alive] = np.inf
    return d.argsort(1, kind="stable")[:, :k]


def recall(found, want):
    return np.mean([len(set(found.get(i, [])) & set(w.tolist())) / len(w) for i, w in enumerate(want)])


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(42).standard_normal((600, 32)).astype(np.float32)


def test_full_probe_is_exact(spark, data):
    i = build(spark, data, soft_k=2)
    found = ids(i.search(asked(spark, data[:20]), 10))
    assert recall(found, truth(data, data[:20], 10)) == 1.0
    assert all(len(v) == len(set(v)) == 10 and v[0] == k for k, v in found.items())
    assert ids(i.brute_force(asked(spark, data[:20]), 10)) == found


def test_delete_compact_and_delete_again(spark, data):
    i = build(spark, data, soft_k=2)
    assert i.delete(range(0, 200)) == 200 and i.delete([5, -1, 10**6]) == 0
    q = asked(spark, data[:10])
    assert min(min(v) for v in ids(i.search(q, 10)).values()) >= 200
    assert i.stats()["deleted_count"] == 200
    i.compact()
    s = i.stats()
    assert (s["deleted_count"], s["purged_count"], s["n_live"], s["n_vectors"]) == (0, 200, 400, 600)
    assert i.delete([5]) == 0
    alive = np.arange(600) >= 200
    assert recall(ids(i.search(q, 10)), truth(data, data[:10], 10, alive)) == 1.0


def test_spike_is_found_then_gone(spark, data):
    i = build(spark, data)
    spike = np.zeros((1, 32), np.float32)
    spike[0, 0] = 1e4
    assert i.add(frame(spark, spike, 600)) == (600, 600)
    assert ids(i.search(asked(spark, spike), 5))[0][0] == 600
    i.delete(600)
    assert 600 not in ids(i.search(asked(spark, spike), 20))[0]


def test_wrong_input(spark, data):
    i = build(spark, data[:50])
    for bad in ([1.0, 2.0], None):
        with pytest.raises(ValueError):
            i.add(spark.createDataFrame([(99, bad)], "vec_id bigint, embedding array<float>"))
    with pytest.raises(ValueError):
        i.search(asked(spark, data[:1, :5]))
    with pytest.raises(ValueError):
        i.search(asked(spark, data[:1]), 0)
    with pytest.raises(ValueError):
        i.add(frame(spark, data[:1]))
    with pytest.raises(ValueError):
        IndexConfig(dim=4, quant="pq")
    assert i.add(frame(spark, data[:0])) is None
    assert i.search(asked(spark, data[:0]), 3).count() == 0


def test_few_rows_and_k_beyond(spark, data):
    i = build(spark, data[:5], n_clusters=8)
    assert sorted(ids(i.search(asked(spark, data[:1]), 50))[0]) == [0, 1, 2, 3, 4]


def test_split_on_drift_without_leaks(spark):
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((200, 16)).astype(np.float32), (rng.standard_normal((400, 16)) + 50).astype(np.float32)
    i = build(spark, a, n_clusters=4, nprobe=4, split_threshold=2.0)
    i.delete(range(0, 200, 2))
    i.add(frame(spark, b, 200))
    assert i.stats()["n_clusters"] > 4
    every = np.concatenate([a, b])
    alive = ~((np.arange(600) < 200) & (np.arange(600) % 2 == 0))
    found = ids(i.search(asked(spark, every[::60]), 10, nprobe=100))
    assert all(alive[v] for r in found.values() for v in r)
    assert recall(found, truth(every, every[::60], 10, alive)) > 0.95
    assert i.cluster_stats().where("last_split_round >= 0").count() > 0


def test_kernel_equals_expressions(spark, data):
    i = build(spark, data, soft_k=2)
    q, p = asked(spark, data[:7]), i.live()
    e = frame(spark, data)
    one = nearest_cells(e, i.cells, 3).collect()
    assert sorted(one) == sorted(nearest_cells_sql(e, i.centroids(), 3).collect())
    probed = search.probes(q, i.cells, 3)
    assert sorted(search.ivf(q, p, i.cells, 5, 3).collect()) == sorted(search.ivf_sql(q, p, probed, 5).collect())
    assert sorted(search.brute_force(q, e, 5, 32).collect()) == sorted(search.brute_force_sql(q, e, 5).collect())
    assert postings_of(e, i.cells, 20).where("vec_id = 3").count() == 8


def test_queries_in_several_passes(spark, data, monkeypatch):
    i = build(spark, data)
    q = asked(spark, data[:20])
    want = ids(i.search(q, 5))
    monkeypatch.setattr(search, "QUERY_BLOCK", 6)
    assert ids(i.search(q, 5)) == want


@pytest.mark.parametrize("bits,least", [(4, 0.8), (2, 0.5)])
def test_scalar_quantiser(spark, data, bits, least):
    i = build(spark, data, quant="tq", tq_bits=bits)
    q, want = asked(spark, data[:20]), truth(data, data[:20], 10)
    assert recall(ids(i.search(q, 10, rerank=False)), want) >= least
    assert recall(ids(i.search(q, 10)), want) >= 0.97
    i.delete([0, 1])
    assert not {0, 1} & {v for r in ids(i.search(q, 10)).values() for v in r}


def test_block_quantiser(spark, data):
    f = FlatVQIndex(spark, 32, 2, 64)
    f.train(frame(spark, data))
    assert f.add(frame(spark, data)) == (0, 600)
    q = asked(spark, data[:20])
    assert recall(ids(f.search(q, 10)), truth(data, data[:20], 10)) > 0.6
    f.remove([0, 7, 9999])
    assert f.n_live() == 598 and f.bytes_per_vector() == 12 + 8
    assert [len(r.ids) for r in f.search_padded(q.limit(1), 700).collect()] == [700]


def test_save_load_then_add(spark, data, tmp_path):
    i = build(spark, data[:500], soft_k=2, quant="tq")
    i.delete([0, 1])
    store.save(i, str(tmp_path / "x"))
    j = store.load(spark, str(tmp_path / "x"))
    q = asked(spark, data[:10])
    assert ids(j.search(q, 10)) == ids(i.search(q, 10))
    assert j.stats() == i.stats()
    j.add(frame(spark, data[500:], 500))
    assert j.stats()["n_vectors"] == 600


def test_dense_ids_without_a_key(spark, data):
    i = build(spark, data[:100])
    assert insert_chunks(i, (row for row in data[100:160]), 25) == (100, 159)
    assert insert_chunks(i, iter(())) is None
    assert i.postings.select("vec_id").distinct().count() == 160
    got = ids(i.search(asked(spark, data[100:103]), 1))
    assert [got[k][0] for k in range(3)] == [100, 101, 102]


def test_replayed_batch_is_ignored(spark, data):
    i = build(spark, data[:100])
    for _ in range(2):
        apply_batch(i, frame(spark, data[100:120], 100), 0, "vec_id", "embedding")
    assert i.stats()["n_vectors"] == 120


def test_views(spark, data):
    i = build(spark, data[:100])
    assert ann_search(i, data[3].tolist(), 1).first().vec_id == 3
    register_search(i, "found", asked(spark, data[:2]), 2)
    assert spark.sql("SELECT count(*) FROM found WHERE rank = 1 AND query_id = vec_id").first()[0] == 2


def test_table_function(spark, data):
    from vectaria.functions.udtf import register_cell_top_k

    i = build(spark, data[:100], soft_k=1)
    register_cell_top_k(spark)
    i.postings.createOrReplaceTempView("cells")
    query = ", ".join(f"{x:.9f}D" for x in data[7].tolist())
    got = spark.sql(f"SELECT * FROM cell_top_k(TABLE(SELECT cluster_id, vec_id, embedding FROM cells) PARTITION BY (cluster_id), array({query}), 3)").collect()
    per = {}
    for r in got:
        per.setdefault(r.cluster_id, []).append(r.dist)
    assert all(len(d) <= 3 and d == sorted(d) for d in per.values()) and len(per) == len(i.physical)
    assert min(got, key=lambda r: r.dist).vec_id == 7


def test_settings_can_change(spark, data):
    i = build(spark, data[:300], soft_k=2)
    i.config.soft_k = 1
    r = ids(i.search(asked(spark, data[:5]), 20))
    assert all(len(v) == len(set(v)) for v in r.values())


def test_search_after_deletes_shuffles_no_vectors(spark, data):
    for quant in ("none", "tq"):
        i = build(spark, data, soft_k=2, quant=quant)
        i.delete(range(0, 300, 3))
        i.add(frame(spark, data[:100] + 1, 600))
        for found in (i.search(asked(spark, data[:10]), 10, rerank=False), i.brute_force(asked(spark, data[:10]), 10)):
            text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            exchanges = [part for part in text.split("\n\n") if ") Exchange" in part.strip().split("\n")[0]]
            assert exchanges and not any("embedding" in x or "codes" in x for x in exchanges), text


def test_probed_cells_reach_the_scan(spark, data):
    i = build(spark, data)
    text = i.search(asked(spark, data[:1]), 3, nprobe=1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cluster_id), EqualTo(cluster_id" in text or "PushedFilters: [In(cluster_id" in text, text


def test_additions_look_at_nothing_else(spark, data, monkeypatch):
    i = build(spark, data[:300], soft_k=2, split_threshold=100.0)
    monkeypatch.setattr(VectorIndex, "known", lambda *a: 1 / 0)
    monkeypatch.setattr("vectaria.operators.split.cell_sizes", lambda *a: 1 / 0)
    before = i.pieces["postings"].paths
    i.add(frame(spark, data[300:400], 300))
    assert i.pieces["postings"].paths[: len(before)] == before and len(i.pieces["postings"].paths) == len(before) + 1
    assert i.delete(range(350, 500)) == 50 and i.stats()["n_live"] == 350
    assert i.add_one(data[0].tolist()) == 400 and i.add_one(data[1].tolist(), 900) == 900 and i.next_id == 901


def test_numbers_kept_equal_numbers_counted(spark):
    rng = np.random.default_rng(7)
    i = build(spark, rng.standard_normal((200, 16)).astype(np.float32), n_clusters=4, nprobe=4, soft_k=2, split_threshold=1.2, quant="tq")

    def same():
        kept = (dict(i.physical), {c: n for c, n in i.dead.items() if n}, i.n_dead, i.n_purged, i.stats())
        i.recount()
        assert kept == (i.physical, {c: n for c, n in i.dead.items() if n}, i.n_dead, i.n_purged, i.stats())
        assert i.codes.count() == i.postings.count() == sum(i.physical.values())

    i.delete(range(0, 20, 2))
    same()
    i.add(frame(spark, (rng.standard_normal((300, 16)) + 20).astype(np.float32), 200))
    assert i.stats()["n_clusters"] > 4
    same()
    i.delete(range(0, 200))
    same()
    i.add(frame(spark, (rng.standard_normal((50, 16)) - 20).astype(np.float32), 500))
    same()
    i.compact()
    same()
    i.vacuum()
    assert i.search(asked(spark, rng.standard_normal((3, 16))), 5, nprobe=100).count() == 15


def test_a_zero_vector_is_stored_and_found(spark, data):
    for quant in ("none", "tq"):
        i = build(spark, data[:100], quant=quant)
        assert i.add_one([0.0] * 32) == 100
        assert ids(i.search(asked(spark, np.zeros((1, 32))), 1))[0] == [100]


def test_mixed_steps(spark, data):
    i, have = build(spark, data[:200], n_clusters=4, nprobe=4), set(range(200))
    for step in range(12):
        if step % 3 == 0:
            i.add(frame(spark, data[200 + 10 * step : 210 + 10 * step], 200 + 10 * step))
            have |= set(range(200 + 10 * step, 210 + 10 * step))
        elif step % 3 == 1:
            assert i.delete([step * 7, step * 7]) == (1 if step * 7 in have else 0)
            have.discard(step * 7)
        else:
            alive = np.isin(np.arange(600), sorted(have))
            assert recall(ids(i.search(asked(spark, data[:10]), 10)), truth(data, data[:10], 10, alive)) == 1.0
    assert i.stats()["n_live"] == len(have)


def test_given_cells_find_what_assigned_ones_do(spark, data):
    a, b = build(spark, data[:400], nprobe=4), build(spark, data[:400], nprobe=4)
    new = frame(spark, data[400:500], 400)
    a.add(new)
    b.add_assigned(new, nearest_cells(new, b.cells, 1))
    found, other = ids(a.search(asked(spark, data[400:410]), 10)), ids(b.search(asked(spark, data[400:410]), 10))
    assert all(len(set(found[k]) & set(other[k])) >= 8 for k in found)


@pytest.mark.parametrize("bits,loss", [(4, 0.08), (3, 0.15), (2, 0.15)])
def test_quantised_recall_is_near_exact_recall(spark, bits, loss):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    i, q, want = build(spark, x, n_clusters=32, nprobe=12, quant="tq", tq_bits=bits), asked(spark, x[:100]), truth(x, x[:100], 10)
    plain = search.ivf(q, i.live(), i.cells, 10, 12)
    assert recall(ids(i.search(q, 10)), want) > recall(ids(plain), want) - loss


def test_quantised_churn(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    i = build(spark, x[:2000], n_clusters=16, nprobe=8, quant="tq")
    i.delete(range(700))
    i.add(frame(spark, x[2000:], 2000))
    q, alive = asked(spark, x[-60:]), np.arange(4000) >= 700
    found, want = ids(i.search(q, 10)), truth(x, x[-60:], 10, alive)
    assert min(min(v) for v in found.values()) >= 700
    assert recall(found, want) > recall(ids(search.ivf(q, i.live(), i.cells, 10, 8)), want) - 0.1


def test_cells_on_disk(spark, data):
    i = build(spark, data[:300], soft_k=2, storage="DISK_ONLY")
    assert i.postings.storageLevel.useDisk and not i.postings.storageLevel.useMemory
    q = asked(spark, data[:5])
    want = ids(i.search(q, 5))
    i.config.storage = ""
    assert not i.postings.storageLevel.useDisk and ids(i.search(q, 5)) == want
    with pytest.raises(ValueError):
        i.config.storage = "TAPE"
    with pytest.raises(ValueError):
        i.config.split_threshold = 0
    assert i.config.storage == "" and i.config.split_threshold == 3.0


def test_save_again_in_place(spark, data, tmp_path):
    path, q = str(tmp_path / "x"), asked(spark, data[:10])
    i = build(spark, data[:400], soft_k=2, quant="tq")
    i.delete([0, 1, 2])
    store.save(i, path)
    j = store.load(spark, path)
    pieces = j.pieces["postings"].paths
    store.save(j, path)
    assert store.load(spark, path).pieces["postings"].paths == pieces
    j.delete([3])
    j.add(frame(spark, data[400:], 400))
    former = store.load(spark, path)
    store.save(j, path)
    now = store.load(spark, path)
    assert former.stats()["n_vectors"] == 400 and now.stats() == j.stats() and now.stats()["n_vectors"] == 600
    assert ids(now.search(q, 10)) == ids(j.search(q, 10))
    # a save that was broken off is not read
    (tmp_path / "x" / "manifest-000000000099").mkdir()
    assert store.load(spark, path).stats() == j.stats()
    store.vacuum(spark, path)
    assert ids(store.load(spark, path).search(q, 10)) == ids(j.search(q, 10))
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_a_stream_goes_on_after_a_restart(spark, data, tmp_path):
    path, place = str(tmp_path / "index"), str(tmp_path / "in")
    i = build(spark, data[:100])
    store.save(i, path)
    read = lambda: spark.readStream.schema("vec_id bigint, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(place)
    frame(spark, data[100:200], 100).coalesce(1).write.parquet(place)
    insert_stream(i, read(), str(tmp_path / "c"), path=path).awaitTermination()
    frame(spark, data[200:260], 200).coalesce(1).write.mode("append").parquet(place)

    def fails(df, k):
        j = store.load(spark, path)
        apply_batch(j, df, k, "vec_id", "embedding", path)
        raise RuntimeError("killed after the save, before the stream's own commit")

    with pytest.raises(Exception, match="killed"):
        read().writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    frame(spark, data[260:300], 260).coalesce(1).write.mode("append").parquet(place)
    j = store.load(spark, path)
    assert j.n_issued == 260
    insert_stream(j, read(), str(tmp_path / "c"), path=path).awaitTermination()
    assert store.load(spark, path).stats()["n_vectors"] == 300
    assert checkpoint_dir(spark)


def test_running_top_k_equals_sorting():
    from vectaria.functions.kernels import TopK

    rng = np.random.default_rng(4)
    best = TopK(5, 3)
    best.most = 10
    rows = [(int(rng.integers(5)), int(rng.integers(40))) for _ in range(400)]
    dist = rng.integers(0, 6, 40).astype(float)
    for a in range(0, 400, 7):
        part = rows[a : a + 7]
        best.add(np.array([r for r, _ in part]), np.array([v for _, v in part]), dist[[v for _, v in part]])
    got = [x for b in best.batches(np.arange(5) * 10) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(10 * r, v, dist[v]) for r in range(5) for v in sorted({v for own, v in rows if own == r}, key=lambda v: (dist[v], v))[:3]]
    assert got == want


def test_first_ids_and_pareto(spark):
    import pandas as pd

    from vectaria.operators.metrics import pareto
    from vectaria.operators.rank import first_ids

    rng = np.random.default_rng(5)
    some = rng.permutation(1000)[:500]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": some})).repartition(7)
    for n in (0, 1, 137, 500, 900):
        assert sorted(r[0] for r in first_ids(df, n).collect()) == sorted(some.tolist())[:n]
    points = pd.DataFrame({"x": rng.integers(0, 200, 400), "y": rng.integers(0, 100, 400)})
    want, most = [], -1
    for x, y in sorted(points.groupby("x").y.max().items()):
        if y > most:
            want.append((x, y))
            most = y
    assert sorted(map(tuple, pareto(spark.createDataFrame(points), "x", "y").collect())) == want


def test_restored_from_tables(spark, data):
    i = build(spark, data[:300], soft_k=2, quant="tq")
    i.delete([0, 5])
    j = VectorIndex.of_tables(spark, i.config, i.centroids(), i.postings, i.tombstones)
    assert j.stats() == i.stats() and ids(j.search(asked(spark, data[:5]), 5)) == ids(i.search(asked(spark, data[:5]), 5))
    j.add(frame(spark, data[300:310], 300))
    assert j.stats()["n_vectors"] == 310 and j.delete([0, 300]) == 1


def test_benchmark_files(spark, data, tmp_path, monkeypatch):
    from vectaria.operators import metrics
    from vectaria.sources import annbench

    want = truth(data, data[:20], 10)
    for name, x in (("train", data), ("test", data[:20]), ("neighbors", want[:, ::-1])):
        np.save(tmp_path / f"{name}.npy", x)
    monkeypatch.setattr(annbench, "ROWS", 250)
    train, test, given = (annbench.load(spark, str(tmp_path), name) for name in ("train", "test", "neighbors"))
    assert np.array_equal(np.array([r.embedding for r in train.orderBy("vec_id").collect()], np.float32), data)
    assert annbench.load(spark, str(tmp_path), limit=7).count() == 7
    assert ids(metrics.resorted(given, test, train, 10)) == {k: w.tolist() for k, w in enumerate(want)}
    unit = annbench.load(spark, str(tmp_path), "test", normalise=True).collect()
    assert all(abs(np.linalg.norm(r.qv) - 1) < 1e-5 for r in unit)
    with pytest.raises(ValueError):
        annbench.load(spark, str(tmp_path), "distances")
    with pytest.raises((ImportError, OSError)):
        annbench.load(spark, str(tmp_path / "none.hdf5"))

"""A vector index as tables: centroids, postings, codes, tombstones and purged ids.

Every mutation makes the next generation of the tables it changes; searches never write. A table
is a list of pieces, Parquet folders that are never changed: an addition or a deletion writes a
piece of its own rows, and after MOST_PIECES all pieces are written as one. Pieces of postings
are in order of cells, so that searches read the probed cells' parts of them. Centroids and each
cell's numbers of rows are bounded by the number of cells and live on the driver, so an addition
or deletion costs as much as its own rows, not the index's: additions of ids above all former
ones look at nothing else, and deletions read only ids (not vectors), of pieces whose range of
ids they meet. Superseded pieces stay, for results that are still to be read, until ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectaria.functions.state import Scratch, durable, remove
from vectaria.functions.vectors import check_dimension, l2_distance, norm_sq, scan_vectors
from vectaria.operators import kmeans, scalar_quant, search, split
from vectaria.operators.assign import POSTINGS, postings_of
from vectaria.operators.kmeans import Centroids
from vectaria.operators.rank import top_k
from vectaria.plans.config import IndexConfig


#: Pieces of a table before all are written as one.
MOST_PIECES = 32


class Pieces:
    """A table as folders of Parquet files; of a folder, the rows of some cells may be hidden."""

    def __init__(self, spark: SparkSession, schema: str, order: tuple[str, ...] = ()):
        self.spark, self.order = spark, order
        self.empty = spark.createDataFrame([], schema)
        self.rows, self.hidden, self.frames = self.empty, {}, {}

    @property
    def paths(self) -> list[str]:
        return list(self.hidden)

    def read(self, hidden: dict[str, list[int]]) -> None:
        """Takes folders, with the cells that are hidden in each."""
        self.hidden = {p: sorted(cells) for p, cells in hidden.items()}
        self.frames = {p: self.frames[p] if p in self.frames else self.spark.read.schema(self.empty.schema).parquet(p) for p in self.hidden}
        frames = [self.frames[p].where(~F.col("cluster_id").isin(cells)) if cells else self.frames[p] for p, cells in self.hidden.items()]
        self.rows = union_all(frames) if frames else self.empty

    def add(self, tables: Scratch, name: str, df: DataFrame, hide: list[int] | None = None) -> DataFrame:
        """Writes a piece; returns its rows. Rows of the cells ``hide`` are hidden in former pieces."""
        df = df.select(*self.empty.columns)
        path, rows = tables.keep(name, df.sortWithinPartitions(*self.order) if self.order else df)
        self.read({p: sorted({*cells, *(hide or [])}) for p, cells in self.hidden.items()} | {path: []})
        return rows

    def replace(self, tables: Scratch, name: str, df: DataFrame) -> list[str]:
        """Writes all rows anew, cell by cell; returns the former folders."""
        former, df = self.paths, df.select(*self.empty.columns)
        path, _ = tables.keep(name, df.repartitionByRange(*self.order).sortWithinPartitions(*self.order) if self.order else df)
        self.read({path: []})
        return former


class VectorIndex:
    """Build, add, delete, search, compact, split and describe; see IndexConfig for parameters."""

    def __init__(self, spark: SparkSession, config: IndexConfig, base: str | None = None):
        self.spark, self.config = spark, config
        self.tables = Scratch(spark, "index", base)
        self.cells: Centroids | None = None
        by_cell = ("cluster_id", "vec_id")
        self.pieces = {
            "postings": Pieces(spark, POSTINGS, by_cell), "codes": Pieces(spark, scalar_quant.CODES, by_cell),
            "tombstones": Pieces(spark, "vec_id bigint", ("vec_id",)), "purged": Pieces(spark, "vec_id bigint", ("vec_id",)),
        }
        self.quantiser: scalar_quant.ScalarQuantiser | None = None
        self.n_issued = self.next_id = self.round = self.generation = self.n_dead = self.n_purged = 0
        #: physical rows and dead rows of each cell
        self.physical: dict[int, int] = {}
        self.dead: dict[int, int] = {}
        self.last_batch = -1
        self.superseded: list[str] = []
        self._stored: tuple[int, str, DataFrame] | None = None

    @classmethod
    def of_tables(cls, spark: SparkSession, config: IndexConfig, centroids: DataFrame, postings: DataFrame, tombstones: DataFrame | None = None) -> VectorIndex:
        """An index from its parts: (cluster_id, centroid, created_round), (cluster_id, vec_id, assign_rank, embedding) and deleted ids.

        Norms and numbers of rows are made anew; deleted ids without rows count as purged.
        """
        index = cls(spark, config)
        index.cells = Centroids.of(centroids.select(F.col("cluster_id").cast("int"), "centroid", "created_round"))
        check_dimension(postings, "embedding", config.dim)
        rows = postings.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("cluster_id", "int"), ("vec_id", "long"), ("assign_rank", "int"), ("embedding", "array<float>"))])
        index._put("postings", rows.withColumn("norm_sq", norm_sq(F.col("embedding"))))
        if config.quant == "tq":
            index.quantiser = scalar_quant.fit(index.postings.where("assign_rank = 1").select("vec_id", "embedding"), config.dim, config.tq_bits, calibration=config.calibrate)
            index._put("codes", scalar_quant.encode(index.postings, index.quantiser))
        ids = index.postings.select("vec_id").distinct()
        if tombstones is not None:
            dead = durable(tombstones.select(F.col("vec_id").cast("long").alias("vec_id")).distinct())
            index._put("tombstones", dead.join(ids, "vec_id", "left_semi"))
            index._put("purged", dead.join(ids, "vec_id", "left_anti"))
        index.recount()
        n, last = ids.union(index.purged).agg(F.count(F.lit(1)), F.max("vec_id")).first()
        index.n_issued, index.next_id, index.generation = n, (-1 if last is None else last) + 1, 1
        return index

    @property
    def postings(self) -> DataFrame:
        """(cluster_id, vec_id, assign_rank, embedding, norm_sq), rows of deleted vectors included."""
        rows = self.pieces["postings"].rows
        level = self.config.storage
        if self._stored is not None and self._stored[:2] != (id(rows), level):
            self._stored[2].unpersist()
            self._stored = None
        if level and self._stored is None:
            self._stored = id(rows), level, rows.persist(getattr(StorageLevel, level))
        return rows

    @property
    def codes(self) -> DataFrame | None:
        return self.pieces["codes"].rows if self.quantiser is not None else None

    @property
    def tombstones(self) -> DataFrame:
        return self.pieces["tombstones"].rows

    @property
    def purged(self) -> DataFrame:
        return self.pieces["purged"].rows

    def _put(self, name: str, df: DataFrame, hide: list[int] | None = None) -> DataFrame:
        """A new piece; many pieces become one."""
        piece = self.pieces[name]
        rows = piece.add(self.tables, name, df, hide)
        if len(piece.paths) > MOST_PIECES:
            self.superseded += piece.replace(self.tables, name, piece.rows)
        return rows

    def _replace(self, name: str, df: DataFrame) -> None:
        self.superseded += self.pieces[name].replace(self.tables, name, df)

    def vacuum(self) -> None:
        """Removes superseded pieces; results of earlier searches that were not read yet can't be read any more."""
        for path in self.superseded:
            remove(self.spark, path)
        self.superseded = []

    def recount(self) -> None:
        """Numbers of rows from the tables, as after loading."""
        sizes = split.cell_sizes(self.postings, self.tombstones).collect()
        self.physical = {r[0]: r[1] for r in sizes}
        self.dead = {r[0]: r[1] - r[2] for r in sizes}
        self.n_dead, self.n_purged = self.tombstones.count(), self.purged.count()

    # ---- inserts

    def _with_ids(self, df: DataFrame, id_col: str | None, vec_col: str) -> DataFrame:
        """(vec_id, embedding); without an id column ids follow on from the last, dense, in the rows' order."""
        if id_col is not None:
            rows = scan_vectors(df, id_col, vec_col, self.config.dim)
            check_dimension(df.select(vec_col), vec_col, self.config.dim)
            return durable(rows)
        check_dimension(df.select(vec_col), vec_col, self.config.dim)
        # dense ids without one task for all rows: counts per partition, then offsets
        numbered = durable(df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), F.col(vec_col).cast("array<float>").alias("embedding")))
        counts = numbered.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
        offsets = counts.withColumn("at", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = numbered.join(F.broadcast(offsets.select("p", "first", "at")), "p")
        return durable(rows.select((F.col("at") + F.col("m") - F.col("first") + self.next_id).alias("vec_id"), "embedding"))

    def add(self, df: DataFrame, id_col: str | None = "vec_id", vec_col: str = "embedding", *, maintain: bool = True) -> tuple[int, int] | None:
        """Adds rows; the first addition trains. Returns the first and last id, None for no rows.

        An id that the index has or had raises ValueError: an update is a delete and an
        addition under a new id. A compaction that is due follows, after no rows too, unless
        ``maintain`` is off.
        """
        rows = self._with_ids(df, id_col, vec_col)
        span = self._span(rows)
        if not span[0]:
            if maintain:
                self._auto_compact()
            return None
        first = self.n_issued == 0
        if first:
            c = self.config
            self.cells = kmeans.train(rows, c.n_clusters, c.dim, rounds=c.train_rounds, seed=c.seed, empty=c.empty_policy)
            if c.quant == "tq":
                self.quantiser = scalar_quant.fit(rows, c.dim, c.tq_bits, calibration=c.calibrate)
        self._append(postings_of(rows, self.cells, self.config.soft_k), span)
        if not first:
            self.rebalance()
            if maintain:
                self._auto_compact()
        return span[1], span[2]

    def add_one(self, vector: list[float], vec_id: int | None = None) -> int:
        """Adds one vector, under the next id or a given one, without compaction; returns its id."""
        rows = [([float(x) for x in vector],)] if vec_id is None else [([float(x) for x in vector], int(vec_id))]
        df = self.spark.createDataFrame(rows, "embedding array<float>" + (", vec_id bigint" if vec_id is not None else "")).coalesce(1)
        return self.add(df, "vec_id" if vec_id is not None else None, maintain=False)[0]

    def _span(self, rows: DataFrame) -> tuple[int, int, int]:
        """Number of rows, first and last id; ids must be new."""
        n, low, high, distinct = rows.agg(F.count(F.lit(1)), F.min("vec_id"), F.max("vec_id"), F.count_distinct("vec_id")).first()
        # ids above all former ones need no look at these
        if n and (distinct != n or (self.n_issued and low < self.next_id and not self.known(rows.select("vec_id"), low, high).isEmpty())):
            raise ValueError("ids must be new")
        return n, low, high

    def add_assigned(self, df: DataFrame, assignments: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Adds rows to given cells, (vec_id, assign_rank, cluster_id); unknown cells are skipped."""
        if self.cells is None:
            raise ValueError("the index has no centroids yet")
        rows = self._with_ids(df, id_col, vec_col)
        span = self._span(rows)
        if not span[0]:
            return
        known = self.spark.createDataFrame([(int(c),) for c in self.cells.ids], "cluster_id int")
        a = assignments.select("vec_id", F.col("assign_rank").cast("int").alias("assign_rank"), F.col("cluster_id").cast("int").alias("cluster_id")).join(F.broadcast(known), "cluster_id", "left_semi")
        # ranks close up over skipped cells, so every stored vector has a row of rank 1
        a = a.withColumn("assign_rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("assign_rank", "cluster_id")))
        norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        self._append(a.join(rows, "vec_id").select("cluster_id", "vec_id", "assign_rank", "embedding", norm.alias("norm_sq")), span, rows.select("vec_id"))
        self.rebalance()
        self._auto_compact()

    def _append(self, postings: DataFrame, span: tuple[int, int, int], ids: DataFrame | None = None) -> None:
        new = self._put("postings", postings)
        for c, n in new.groupBy("cluster_id").count().collect():
            self.physical[c] = self.physical.get(c, 0) + n
        if self.quantiser is not None:
            self._put("codes", scalar_quant.encode(new, self.quantiser))
        if ids is not None:
            # rows without any location still count as issued
            lost = durable(ids.join(new.select("vec_id").distinct(), "vec_id", "left_anti"))
            if n := lost.count():
                self._put("purged", lost)
                self.n_purged += n
        self.n_issued += span[0]
        self.next_id = max(self.next_id, span[2] + 1)
        self.round += 1
        self.generation += 1

    def known(self, ids: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
        """Those of the ids (between ``low`` and ``high``, if given) that were ever issued."""
        every = self.pieces["postings"].rows.select("vec_id").union(self.purged)
        if low is not None:
            every = every.where(F.col("vec_id").between(low, high))
        return ids.join(every, "vec_id", "left_semi")

    # ---- deletes and maintenance

    def delete(self, ids: DataFrame | Iterable[int] | int) -> int:
        """Hides vectors; unknown, repeated and already deleted ids are ignored. Returns how many were hidden."""
        if isinstance(ids, int):
            ids = [ids]
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "vec_id bigint")
        ids = durable(ids.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct())
        asked, low, high = ids.agg(F.count(F.lit(1)), F.min("vec_id"), F.max("vec_id")).first()
        if not asked:
            return 0
        near = F.col("vec_id").between(low, high)
        few = F.broadcast(ids) if asked <= search.BROADCAST_IDS else ids
        at = self.pieces["postings"].rows.select("vec_id", "cluster_id").where(near).join(few, "vec_id", "left_semi")
        at = durable(search.live(at, self.tombstones.where(near), self.n_dead))
        rows = dict(at.groupBy("cluster_id").count().collect())
        if not rows:
            return 0
        new = self._put("tombstones", at.select("vec_id").distinct())
        n = new.count()
        for c, k in rows.items():
            self.dead[c] = self.dead.get(c, 0) + k
        self.n_dead += n
        self.generation += 1
        return n

    def live(self) -> DataFrame:
        return search.live(self.postings, self.tombstones, self.n_dead)

    def vectors(self) -> DataFrame:
        """(vec_id, embedding) of live vectors, one row each."""
        return self.live().where("assign_rank = 1").select("vec_id", "embedding")

    def compact(self) -> int:
        """Rewrites postings without deleted vectors; their ids stay known. Returns how many ids were purged."""
        n = self.n_dead
        if n:
            if self.quantiser is not None:
                self._replace("codes", search.live(self.codes, self.tombstones, n))
            self._replace("postings", search.live(self.pieces["postings"].rows, self.tombstones, n))
            self._put("purged", self.tombstones)
            self._forget_tombstones(None)
            self.n_purged += n
            self.physical = {c: k for c in self.physical if (k := self.physical[c] - self.dead.get(c, 0))}
            self.dead = {}
            self.generation += 1
        return n

    def _forget_tombstones(self, left: DataFrame | None) -> None:
        if left is not None:
            self._replace("tombstones", left)
            self.n_dead = self.tombstones.count()
        else:
            self.superseded += self.pieces["tombstones"].paths
            self.pieces["tombstones"] = Pieces(self.spark, "vec_id bigint", ("vec_id",))
            self.n_dead = 0

    def _auto_compact(self) -> None:
        if self.n_dead > self.n_issued // 10:
            self.compact()

    def live_sizes(self) -> dict[int, int]:
        return {c: n - self.dead.get(c, 0) for c, n in self.physical.items()}

    def rebalance(self) -> int:
        """One pass of splits of overloaded cells; returns how many cells were split."""
        sizes = self.live_sizes()
        limit = split.limit_of(sum(sizes.values()), len(self.cells.ids), self.config.split_threshold)
        cells = sorted(c for c, n in sizes.items() if n > limit)
        if not cells:
            return 0
        centers, sides = split.two_means(self.live(), cells, self.config.dim, self.config.max_split_iters)
        sides = durable(sides)
        both = {r[0] for r in sides.groupBy("cluster_id").agg(F.count_distinct("side").alias("n")).where("n = 2").collect()}
        moved = {}
        for c in sorted(both & set(centers)):
            new = int(self.cells.ids.max()) + 1
            self.cells.vectors[self.cells.ids == c] = centers[c][0]
            self.cells.ids = np.append(self.cells.ids, np.int32(new))
            self.cells.vectors = np.vstack([self.cells.vectors, centers[c][1]])
            self.cells.made = np.append(self.cells.made, np.int32(self.round))
            moved[c] = new
        if not moved:
            return 0
        to = self.spark.createDataFrame(list(moved.items()), "cluster_id int, new_id int")
        go = sides.where("side = 1").join(F.broadcast(to), "cluster_id").select("cluster_id", "vec_id", "new_id")
        # the split cells are written as a piece of their own, without their dead rows; the rest stays where it is
        touched, postings = F.col("cluster_id").isin(list(moved)), self.pieces["postings"]
        rows = search.live(postings.rows.where(touched), self.tombstones, self.n_dead).join(go, ["cluster_id", "vec_id"], "left").withColumn("cluster_id", F.coalesce("new_id", "cluster_id"))
        rows = self._put("postings", rows, list(moved))
        if self.quantiser is not None:
            self._put("codes", scalar_quant.encode(rows, self.quantiser), list(moved))
        for c in moved:
            self.physical.pop(c, None)
            self.dead.pop(c, None)
        for c, n in rows.groupBy("cluster_id").count().collect():
            self.physical[c] = n
        if self.n_dead:
            # a split may leave ids that have no rows any more
            gone = durable(self.tombstones.join(self.pieces["postings"].rows.select("vec_id"), "vec_id", "left_anti"))
            if n := gone.count():
                self._put("purged", gone)
                self.n_purged += n
                self._forget_tombstones(self.tombstones.join(gone, "vec_id", "left_anti"))
        self.generation += 1
        return len(moved)

    # ---- searches

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, *, rerank: bool = True) -> DataFrame:
        """(query_id, rank, vec_id, dist) of (query_id, qv) rows; squared distances.

        A quantised index ranks by estimates; with ``rerank`` the best max(rerank_k, k) of each
        query get exact distances, without it the estimates are returned.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        check_dimension(queries, "qv", self.config.dim)
        nprobe = nprobe or self.config.nprobe
        if self.cells is None:
            return self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, dist double")
        if self.quantiser is None:
            return search.ivf(queries, self.live(), self.cells, k, nprobe)
        codes = search.live(self.codes, self.tombstones, self.n_dead)
        lut = self.config.lut_bits if self.config.tq_bits <= 4 else 0
        found = scalar_quant.search(queries, codes, self.cells, self.quantiser, max(self.config.rerank_k, k) if rerank else k, nprobe, lut_bits=lut)
        if not rerank:
            return found
        return rerank_exact(found, self.live(), queries, k)

    def brute_force(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The same over all live vectors."""
        check_dimension(queries, "qv", self.config.dim)
        return search.brute_force(queries, self.vectors(), k, self.config.dim)

    # ---- descriptions

    def centroids(self) -> DataFrame:
        return self.cells.frame(self.spark)

    def cluster_stats(self) -> DataFrame:
        """cluster_id, live_size, physical_size, centroid, last_split_round (-1: training)."""
        sizes = self.spark.createDataFrame([(int(c), n, n - self.dead.get(c, 0)) for c, n in self.physical.items()], "cluster_id int, physical_size bigint, live_size bigint")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.centroids().join(sizes, "cluster_id", "left").select("cluster_id", zero("live_size"), zero("physical_size"), "centroid", F.col("created_round").alias("last_split_round"))

    def stats(self) -> dict:
        live = self.live_sizes().values()
        n = len(self.cells.ids) if self.cells is not None else self.config.n_clusters
        out = {
            "n_vectors": self.n_issued, "n_physical_slots": sum(self.physical.values()), "n_clusters": n, "dim": self.config.dim, "quant": self.config.quant, "soft_k": self.config.soft_k,
            "deleted_count": self.n_dead, "max_cluster_size": max(live, default=0), "mean_cluster_size": sum(live) / n, "purged_count": self.n_purged,
        }
        out["n_live"] = self.n_issued - out["deleted_count"] - out["purged_count"]
        if self.config.quant == "tq":
            bits, d = self.config.tq_bits, self.config.dim
            out |= {"tq_bits": bits, "tq_fastscan": bits <= 4 and self.config.lut_bits == 8, "compression_ratio": 4 * d / (-(-bits * d // 8) + 8)}
        return out

    def locations(self) -> DataFrame:
        """vec_id and its cells in order of nearness."""
        return self.postings.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("assign_rank", "cluster_id"))), lambda s: s["cluster_id"]).alias("clusters"))

    def __repr__(self) -> str:
        c = self.config
        return f"VectorIndex(dim={c.dim}, n_clusters={len(self.cells.ids) if self.cells is not None else c.n_clusters}, n_vectors={self.n_issued}, generation={self.generation})"


def rerank_exact(found: DataFrame, postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates' exact distances from their float vectors, and the k best."""
    ids = found.select("query_id", "vec_id")
    vectors = postings.join(ids.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min_by("embedding", "assign_rank").alias("embedding"))
    pairs = ids.join(vectors, "vec_id").join(queries, "query_id")
    return top_k(pairs.select("query_id", "vec_id", l2_distance(F.col("qv"), F.col("embedding")).alias("dist")), k).select("query_id", "rank", "vec_id", "dist")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

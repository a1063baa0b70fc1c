"""A flat index of block-quantised vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectaria.functions.state import Scratch, durable
from vectaria.functions.vectors import check_dimension
from vectaria.operators import block_quant, search
from vectaria.plans.index import MOST_PIECES, Pieces


class FlatVQIndex:
    """train, add, remove, search, bytes_per_vector, n_live."""

    def __init__(self, spark: SparkSession, dim: int, block: int = 2, words: int = 256):
        self.spark, self.dim, self.block, self.words = spark, dim, block, words
        self.quantiser: block_quant.BlockQuantiser | None = None
        self.tables = Scratch(spark, "flat")
        self.pieces = {"codes": Pieces(spark, block_quant.CODES, ("vec_id",)), "tombstones": Pieces(spark, "vec_id bigint", ("vec_id",))}
        self.next_id = self.n_dead = self.n_issued = 0

    @property
    def codes(self) -> DataFrame:
        return self.pieces["codes"].rows

    @property
    def tombstones(self) -> DataFrame:
        return self.pieces["tombstones"].rows

    def _put(self, name: str, df: DataFrame) -> None:
        piece = self.pieces[name]
        piece.add(self.tables, name, df)
        if len(piece.paths) > MOST_PIECES:
            piece.replace(self.tables, name, piece.rows)

    def train(self, vectors: DataFrame, *, rounds: int = block_quant.ROUNDS, seed: int | None = block_quant.ROTATION_SEED) -> None:
        check_dimension(vectors, "embedding", self.dim)
        self.quantiser = block_quant.fit(vectors, self.dim, self.block, self.words, rounds=rounds, seed=seed)

    def add(self, vectors: DataFrame) -> tuple[int, int]:
        """Adds (vec_id, embedding) rows, which alone are written; returns the half-open range of ids. Ids must be new."""
        if self.quantiser is None:
            raise ValueError("train first")
        check_dimension(vectors, "embedding", self.dim)
        rows = durable(block_quant.encode(vectors, self.quantiser))
        low, high, n, distinct = rows.agg(F.min("vec_id"), F.max("vec_id"), F.count(F.lit(1)), F.count_distinct("vec_id")).first()
        if low is None:
            return self.next_id, self.next_id
        if n != distinct or (low < self.next_id and not rows.join(self.codes.where(F.col("vec_id").between(low, high)).select("vec_id"), "vec_id", "left_semi").isEmpty()):
            raise ValueError("ids must be new")
        self._put("codes", rows)
        self.n_issued += n
        self.next_id = max(self.next_id, high + 1)
        return low, high + 1

    def remove(self, ids: DataFrame | Iterable[int]) -> None:
        """Hides vectors; unknown ids are ignored."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "vec_id bigint")
        new = durable(ids.select("vec_id").distinct().join(self.codes.select("vec_id"), "vec_id", "left_semi").join(self.tombstones, "vec_id", "left_anti"))
        if n := new.count():
            self._put("tombstones", new)
            self.n_dead += n

    def live(self) -> DataFrame:
        return search.live(self.codes, self.tombstones, self.n_dead)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        check_dimension(queries, "qv", self.dim)
        return block_quant.search(queries, self.live(), self.quantiser, k)

    def search_padded(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, ids): k ids for each query, padded with -1."""
        found = self.search(queries, k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("ids"))
        ids = F.coalesce("ids", F.array().cast("array<bigint>"))
        return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.slice(F.concat(ids, F.array_repeat(F.lit(-1).cast("long"), k)), 1, k).alias("ids"))

    def bytes_per_vector(self) -> int:
        return self.quantiser.bytes_per_vector()

    def n_live(self) -> int:
        return self.n_issued - self.n_dead

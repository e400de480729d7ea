"""A kept index for approximate nearest vectors by cosine: cells around centroids, on Parquet, with exact scores within the cells probed.

Vectors lie in a folder for each cell, so a search reads the cells that its
queries probe and no others.  Adding vectors writes to their cells; the centroids
stay until the index is built anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import vectors as V
from quernstone.operators import search

#: Most cells of an index, so that its centroids can be sent to every task.
MOST_CELLS = 4096


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Directions of up to ``cells`` groups of a sample of unit vectors, by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=len(c)) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = V.unit(sums)
    return c


class Probes(search.Pairing):
    """Rows of the cells around a query's nearest centroids."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(V.unit(vectors) @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    def of_rows(self, vectors: np.ndarray, cell: np.ndarray | None) -> np.ndarray | None:
        return cell

    def reads(self, asked: np.ndarray) -> Column:
        return F.col("cell").isin(np.unique(asked).tolist())

    def groups(self, asked: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
        mine = search.by_value(asked.ravel())
        for cell, at in search.by_value(rows).items():
            if cell in mine:
                yield mine[cell] // asked.shape[1], at, None


class VectorIndex:
    """An index in a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, folder: str):
        """Opens what :meth:`build` has kept."""
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.centroids = np.array([r["centroid"] for r in rows], np.float64)

    @staticmethod
    def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, sample: int = 20_000) -> VectorIndex:
        """Chooses centroids from a sample of bounded size and puts every vector into its cell.

        By default there are as many cells as the square root of the vectors,
        ``MOST_CELLS`` at most.  Null vectors are left out.
        """
        spark = vectors.sparkSession
        rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
        n = rows.count()
        cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        top = 1 << 30
        drawn = rows.where(F.pmod(F.xxhash64(id_col), F.lit(top)) < int(top * min(1.0, sample / max(1, n)))).select(F.col(vec_col).cast("array<double>").alias("v")).limit(2 * sample).collect()
        found = centroids(V.unit(np.array([r["v"] for r in drawn], np.float64)), cells) if drawn else np.zeros((1, 1))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/centroids")
        index = VectorIndex(spark, folder)
        index._write(rows, id_col, vec_col, "overwrite")
        return index

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        self._write(vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)), id_col, vec_col, "append")

    def _write(self, rows: DataFrame, id_col: str, vec_col: str, mode: str) -> None:
        sent = self.spark.sparkContext.broadcast(self.centroids)

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x = V.unit(V.matrix(b.column(1), sent.value.shape[1]))
                yield pa.record_batch([*b.columns, pa.array((x @ sent.value.T).argmax(axis=1).astype(np.int32))], names=["id", "vec", "cell"])

        slim = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        dealt = slim.mapInArrow(assign, f"id {slim.schema['id'].dataType.simpleString()}, vec array<double>, cell int")
        # few files for a cell, and several tasks for a large one
        dealt.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.folder}/cells")

    def top_k(self, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", query_vec: str = "query_vec", id_col: str = "vec_id", digits: int | None = None, block: int = 2048, page: int | None = None) -> DataFrame:
        """(query_id, rank, id, score): the ``k`` best of the vectors in each query's ``probes`` nearest cells.

        Few queries read the cells that they probe; many are held against pages of all
        cells, each query against its own: see :func:`search.block_search`.
        """
        rows = self.spark.read.parquet(f"{self.folder}/cells").select("id", "vec", "cell")
        asked = queries.select(F.col(query_id).alias("q"), F.col(query_vec).alias("vec")).where("vec is not null")
        found = search.block_search(rows, asked, k, digits, block, page, Probes(self.centroids, probes), self.centroids.shape[1])
        return search.ranked(found, rows, asked, k, query_id, id_col)

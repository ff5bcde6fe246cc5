"""A stored index for vector search: vectors by cell, and queries that read few cells.

Cells are the regions around centroids of a spherical k-means, fitted on a sample of bounded
size. Every vector is stored in the cell of its nearest centroid, one folder for each cell, so a
search prunes folders. A query reads the `probes` cells whose centroids are nearest to it; the
number is chosen from exact neighbours of sampled queries. Vectors of another length have
centroids of their own. Vectors that no search can use are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import vectors as V
from corpusatlas.session import materialise

#: The sample that centroids are fitted on has at most about SAMPLE_PER_CELL rows for each cell.
SAMPLE_PER_CELL, MOST_CELLS = 64, 4_096
FIT_ROUNDS = 12
#: Queries whose exact neighbours decide how many cells are read, and the share to be found.
TUNING_QUERIES, TUNING_RECALL = 256, 0.97
_HALF = 1 << 62


def n_cells_for(n_vectors: int) -> int:
    """About the square root, so that a query compares as many centroids as vectors of a cell."""
    return int(min(MOST_CELLS, max(1, round(n_vectors**0.5))))


def hashed_sample(rows: DataFrame, id_column: str, n_rows: int, wanted: int) -> DataFrame:
    """About `wanted` rows, always the same ones: those whose hashed id is below a threshold."""
    if n_rows <= wanted:
        return rows
    share = wanted / n_rows
    # Hashes are spread over 64 bits; the top 62 bits are compared.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(41), id_column), 2)
    return rows.where(place < F.lit(int(share * _HALF)))


def spherical_means(rows: np.ndarray, n_cells: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; a cell that gets empty restarts at the row that fits worst."""
    draw = np.random.default_rng(seed)
    n_cells = min(n_cells, len(rows))
    centres = rows[np.sort(draw.choice(len(rows), n_cells, replace=False))].copy()
    for _ in range(rounds):
        nearest, score = nearest_centres(rows, centres, 1)
        nearest, score = nearest[:, 0], score[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            worst = np.argsort(score, kind="stable")[: len(empty)]
            sums[empty[: len(worst)]] = rows[worst]
            size = np.linalg.norm(sums, axis=1)
        centres = sums / np.where(size == 0, 1, size)[:, None]
    return centres


def nearest_centres(rows: np.ndarray, centres: np.ndarray, n: int, block: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """The `n` nearest centroids of every row, nearest first, and their cosines."""
    n = min(n, len(centres))
    found, scores = [], []
    for at in range(0, max(len(rows), 1), block):
        cosines = rows[at : at + block] @ centres.T
        best = np.argsort(-cosines, axis=1, kind="stable")[:, :n] if n > 1 else cosines.argmax(axis=1)[:, None]
        found.append(best)
        scores.append(np.take_along_axis(cosines, best, axis=1))
    return np.concatenate(found), np.concatenate(scores)


def fit(vectors: DataFrame, n_cells: int | None = None, seed: int = 7) -> dict[int, np.ndarray]:
    """Centroids by vector length, from a sample of at most about `SAMPLE_PER_CELL` rows a cell."""
    usable = V.usable(vectors, "vec_id")
    sizes = usable.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = {}
    for size, n in sorted((r.dim, r.n) for r in sizes):
        cells = n_cells_for(n) if n_cells is None else n_cells
        own = usable.where(F.size("embedding") == size)
        sample = hashed_sample(own, "vec_id", n, cells * SAMPLE_PER_CELL).toArrow()
        if not sample.num_rows:
            sample = own.limit(cells).toArrow()
        rows = V.matrices(sample["vec_id"], sample["embedding"])[size][1]
        found[size] = spherical_means(rows, cells, seed=seed)
    return found


def _to_cells(rows: DataFrame, id_column: str, centres: dict[int, np.ndarray], n: int) -> DataFrame:
    """`(id, embedding, dim, cells)`: the `n` nearest cells of every row; none if no centroid has its length."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
            for size in np.unique(sizes):
                if int(size) not in shared.value:
                    continue
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                unit = V.matrices(part.column(0), part.column(1))[int(size)][1]
                cells, _ = nearest_centres(unit, shared.value[int(size)], n)
                offsets = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(np.full(len(part), size, np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.reshape(-1).astype(np.int32))),
                    ],
                    names=[id_column, "embedding", "dim", "cells"],
                )

    wanted = V.usable(rows, id_column)
    kind = {f.name: f.dataType.simpleString() for f in wanted.schema}
    return wanted.mapInArrow(place, f"{id_column} {kind[id_column]}, embedding {kind['embedding']}, dim int, cells array<int>")


@dataclass
class CellIndex:
    """A stored index; `stored` has `(vec_id, embedding, dim, cell)` with a folder for each dim and cell."""

    folder: str
    stored: DataFrame
    centres: dict[int, np.ndarray]
    probes: int

    @classmethod
    def write(
        cls, vectors: DataFrame, folder: str, k: int, n_cells: int | None = None, probes: int | None = None,
        recall: float = TUNING_RECALL,
    ) -> CellIndex:
        """Fit, store and tune an index for the `k` nearest."""
        spark, folder = vectors.sparkSession, folder.rstrip("/")
        centres = fit(vectors, n_cells)
        placed = _to_cells(vectors, "vec_id", centres, 1).select("vec_id", "embedding", "dim", F.col("cells")[0].alias("cell"))
        # A cell that is too large for one task is split, small ones stay one file.
        placed.hint("rebalance", "dim", "cell").write.partitionBy("dim", "cell").parquet(f"{folder}/vectors")
        rows = [(size, cell, row.tolist()) for size, c in centres.items() for cell, row in enumerate(c)]
        spark.createDataFrame(rows, "dim int, cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        index = cls(folder, cls._stored(spark, folder), centres, probes or 1)
        if probes is None:
            index.probes = index.tuned(k, recall)
        spark.createDataFrame([(index.probes,)], "probes int").coalesce(1).write.parquet(f"{folder}/settings")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CellIndex:
        folder, centres = folder.rstrip("/"), {}
        for row in spark.read.parquet(f"{folder}/centres").orderBy("dim", "cell").collect():
            centres.setdefault(row.dim, []).append(row.centre)
        probes = spark.read.parquet(f"{folder}/settings").first().probes
        return cls(folder, cls._stored(spark, folder), {d: np.array(c) for d, c in centres.items()}, probes)

    @staticmethod
    def _stored(spark: SparkSession, folder: str) -> DataFrame:
        kinds = "vec_id bigint, embedding array<float>, dim int, cell int"
        found = spark.read.schema(kinds).option("basePath", f"{folder}/vectors")
        return found.parquet(f"{folder}/vectors")

    def tuned(self, k: int, recall: float = TUNING_RECALL) -> int:
        """The least number of cells that hold this share of the exact neighbours of sampled queries."""
        n = self.stored.count()
        named = self.stored.select(F.col("vec_id").alias("query_id"), "embedding")
        asked = materialise(hashed_sample(named, "query_id", n, TUNING_QUERIES).limit(2 * TUNING_QUERIES), "tuning")
        near = V.top_k(self.stored.select("vec_id", "embedding"), asked, k).select("query_id", "vec_id")
        most = max((len(c) for c in self.centres.values()), default=1)
        order = _to_cells(asked, "query_id", self.centres, most).select("query_id", "cells")
        # At most k times TUNING_QUERIES pairs.
        at = (
            self.stored.select("vec_id", "cell").join(F.broadcast(near), "vec_id")
            .join(F.broadcast(order), "query_id").select(F.array_position("cells", F.col("cell")).alias("rank"))
        )
        ranks = np.sort([r.rank for r in at.collect()])
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) if len(ranks) else 1

    def cells_read(self, asked: DataFrame) -> DataFrame:
        """The stored vectors of the cells that these queries probe, by pruning folders."""
        # One row for each cell at most.
        wanted: dict[int, list[int]] = {}
        for row in asked.select("dim", "cell").distinct().collect():
            wanted.setdefault(row.dim, []).append(row.cell)
        if not wanted:
            return self.stored.limit(0)
        tests = [(F.col("dim") == d) & F.col("cell").isin(sorted(c)) for d, c in sorted(wanted.items())]
        return self.stored.where(reduce(lambda a, b: a | b, tests))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """`(query_id, rank, vec_id, similarity)`: the k best of the vectors in the cells each query probes."""
        placed = _to_cells(queries, "query_id", self.centres, probes or self.probes)
        asked = materialise(placed.select("query_id", "embedding", "dim", F.explode("cells").alias("cell")), "probes")
        return V.merged(V.block_hits(self.cells_read(asked), asked, ["dim", "cell"], k), k)

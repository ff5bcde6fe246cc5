"""Nearest neighbours by cosine over chunk vectors.

Input vectors `(vec_id, embedding)`, queries `(query_id, embedding)`. Every batch of
vectors keeps its k best per query before anything is shuffled.

A vector or query is usable if it has an id and elements and none of them is null or no
number; others are left out on both sides, however many there are (`unusable` lists them).
A query meets vectors of its own length only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.operators.skew import salted_join
from corpusatlas.session import materialise

MAX_QUERIES = 1_024
#: Rows of a block when more queries meet the vectors, and rows that are scored at a time.
BLOCK_VECTORS, BLOCK_QUERIES = 65_536, 16_384
SCORED_VECTORS, SCORED_QUERIES = 8_192, 1_024
#: Numbers that a task holds of planes, of products with them and of codes, however many bands there are.
HELD_NUMBERS = 1 << 21
ROWS_PER_CODE = 64
DIGITS = 6
#: Expected recall that the number of bands is chosen for, and the queries it is estimated on.
RECALL, SAMPLE_QUERIES = 0.95, 256
_HITS = "query_id long, vec_id long, similarity double"
_NO_HITS = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})


def _bad(id_column: str) -> Column:
    """True for rows that no search can use."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return F.col(id_column).isNull() | F.coalesce(
        (F.size("embedding") <= 0) | broken, F.lit(True)
    )


def unusable(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """The rows that searches leave out."""
    return vectors.where(_bad(id_column))


def usable(vectors: DataFrame, id_column: str) -> DataFrame:
    """The rows that searches take."""
    return vectors.where(~_bad(id_column)).select(id_column, "embedding")


def matrices(ids: pa.Array, column: pa.ChunkedArray | pa.Array) -> dict[int, tuple]:
    """Ids and unit vectors by length; a zero vector stays zero."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = array.value_lengths().to_numpy(zero_copy_only=False)
    numbers = np.asarray(ids.to_numpy(zero_copy_only=False))
    found = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = array.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype(np.float64).reshape(len(rows), int(size))
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        found[int(size)] = (numbers[rows], matrix / np.where(length == 0, 1, length))
    return found


def _best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> pa.RecordBatch:
    """The k best vectors of one block for each query; equal scores by lower id."""
    scores = np.round(queries @ vectors.T, DIGITS)
    found_queries, found_ids, found_scores = [], [], []
    for query_id, row in zip(query_ids, scores):
        if len(row) > k:
            # Keep all ties with the k-th best, so that the id decides between them.
            near = np.flatnonzero(row >= np.partition(row, -k)[-k])
        else:
            near = np.arange(len(row))
        near = near[np.lexsort((ids[near], -row[near]))][:k]
        found_queries.append(np.full(len(near), query_id, dtype=np.int64))
        found_ids.append(ids[near])
        found_scores.append(row[near])
    columns = [np.concatenate(c) for c in (found_queries, found_ids, found_scores)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], names=["query_id", "vec_id", "similarity"]
    )


def merged(hits: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "similarity")
    )


def _top_k_of(vectors: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    asked = matrices(queries["query_id"], queries["embedding"]) if queries.num_rows else {}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = matrices(batch.column(0), batch.column(1)) if batch.num_rows else {}
            for size, (ids, rows) in stored.items():
                if size in asked:
                    yield _best(*asked[size], ids, rows, k)

    return usable(vectors, "vec_id").mapInArrow(search, _HITS)


def block_hits(
    stored: DataFrame, asked: DataFrame, group: Sequence[str], k: int,
    vectors_per_block: int = BLOCK_VECTORS, queries_per_block: int = BLOCK_QUERIES,
) -> DataFrame:
    """Hits `(query_id, vec_id, similarity)` of queries and vectors of the same group, block by block.

    A group is cut into blocks of vectors and of queries by hashed ids; every pair of blocks
    is one task's work and keeps its k best for each query. Groups are few (the cells of
    an index, or one), so their sizes may travel to all rows.
    """
    keys = list(group)

    def cut(rows: DataFrame, name: str, most: int) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))

    sizes = F.broadcast(cut(stored, "_v", vectors_per_block).join(cut(asked, "_q", queries_per_block), keys))

    def dealt(rows: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
        # New names, because both sides may come from one table.
        sized = rows.select(*(F.col(c).alias(c) for c in (*keys, id_column, "embedding"))).join(sizes, keys)
        place = F.pmod(F.xxhash64(id_column, "embedding"), F.col(own)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return sized.select(*keys, id_column, "embedding", place, every)

    left, right = dealt(stored, "vec_id", "_v", "_q"), dealt(asked, "query_id", "_q", "_v")

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _NO_HITS
        held = matrices(queries["query_id"], queries["embedding"])
        found = []
        for at in range(0, vectors.num_rows, SCORED_VECTORS):
            part = vectors.slice(at, SCORED_VECTORS)
            for size, (ids, rows) in matrices(part["vec_id"], part["embedding"]).items():
                if size not in held:
                    continue
                asked_ids, asked_rows = held[size]
                for n in range(0, len(asked_ids), SCORED_QUERIES):
                    some = slice(n, n + SCORED_QUERIES)
                    found.append(_best(asked_ids[some], asked_rows[some], ids, rows, k))
        if not found:
            return _NO_HITS
        hits = pa.Table.from_batches(found)
        # The best of all slices.
        order = np.lexsort([hits["vec_id"].to_numpy(), -hits["similarity"].to_numpy(), hits["query_id"].to_numpy()])
        asked_by = hits["query_id"].to_numpy()[order]
        first = np.flatnonzero(np.append(True, asked_by[1:] != asked_by[:-1]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return hits.take(pa.array(order[rank < k]))

    both = [*keys, "_v", "_q"]
    left, right = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (left, right))
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(search, _HITS)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = MAX_QUERIES
) -> DataFrame:
    """Exact k nearest vectors of every query.

    Up to `max_queries` queries travel to the vectors, which are not shuffled then. More
    queries meet the vectors in pairs of blocks.
    """
    wanted = usable(queries, "query_id")
    if wanted.limit(max_queries + 1).count() <= max_queries:
        return merged(_top_k_of(vectors, wanted.toArrow(), k), k)
    whole = F.lit(0).alias("_all")
    hits = block_hits(
        usable(vectors, "vec_id").select(whole, "vec_id", "embedding"),
        wanted.select(whole, "query_id", "embedding"), ["_all"], k,
        queries_per_block=min(max_queries * 16, BLOCK_QUERIES),
    )
    return merged(hits, k)


def _codes(rows: np.ndarray, bands: int, bits: int, seed: int) -> np.ndarray:
    """The codes of unit vectors of one length, one column for each band; some bands at a time."""
    size = rows.shape[1]
    draw = np.random.default_rng([seed, size])
    codes = np.empty((len(rows), bands), dtype=np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    step = max(1, HELD_NUMBERS // (bits * max(len(rows), size)))
    for first in range(0, bands, step):
        some = min(step, bands - first)
        # Drawn in one order, so that the planes do not depend on the step.
        planes = draw.standard_normal((some * bits, size))
        sides = (rows @ planes.T >= 0).reshape(len(rows), some, bits)
        codes[:, first : first + some] = sides @ weights
    return codes


def band_codes(
    vectors: DataFrame, id_column: str, bands: int, bits: int, seed: int = 7
) -> DataFrame:
    """One row per vector and band with the side of `bits` random hyperplanes as a code.

    Rows hold no vector. Vectors of another length have planes and codes of their own.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = matrices(batch.column(0), batch.column(1)) if batch.num_rows else {}
            for size, (ids, rows) in stored.items():
                at_a_time = max(1, HELD_NUMBERS // max(bands, bits))
                for first in range(0, len(rows), at_a_time):
                    some = slice(first, first + at_a_time)
                    codes = _codes(rows[some], bands, bits, seed)
                    offsets = np.arange(0, codes.size + 1, bands, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[some].astype(np.int64)), pa.array(np.full(len(codes), size, np.int32)),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1))),
                        ],
                        names=[id_column, "dim", "codes"],
                    )

    coded = usable(vectors, id_column).mapInArrow(
        encode, f"{id_column} long, dim int, codes array<long>"
    )
    return coded.select(id_column, "dim", F.posexplode("codes").alias("band", "code"))


def cosine(a: str, b: str):
    """Cosine of two array columns inside the JVM."""
    def dot(x: str, y: str):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def code_bits(n_vectors: int) -> int:
    """Bits of a code, so that about `ROWS_PER_CODE` of evenly spread vectors share one."""
    return max(6, (max(1, n_vectors) // ROWS_PER_CODE).bit_length())


def bands_for(similarities: np.ndarray, bits: int, recall: float = RECALL) -> int:
    """The least number of bands in which neighbours as near as these are met with `recall`."""
    alike = (1 - np.arccos(np.clip(similarities, -1, 1)) / np.pi) ** bits

    def met(bands: int) -> float:
        return float(np.mean(1 - (1 - alike) ** bands))

    high = 1
    while met(high) < recall and high < 1 << 40:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if met(middle) >= recall else (middle, high)
    return high


def top_k_lsh(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    bands: int | None = None,
    bits: int | None = None,
    seed: int = 7,
    exact_if_cheaper: bool = True,
) -> DataFrame:
    """Approximate search: vectors sharing a band code with a query, ranked exactly.

    The banded ids stand for the stored index; codes get longer with the number of
    vectors. A code held by very many vectors is dealt out to several tasks. Vectors are
    fetched for the distinct pairs that have met.

    Without `bands`, exact neighbours of a sample of queries tell how many bands are needed
    for `RECALL`. If so many bands would meet as many vectors as there are, the search is exact,
    unless `exact_if_cheaper` is false.
    """
    n_vectors = vectors.count() if bits is None or bands is None else 0
    bits = code_bits(n_vectors) if bits is None else bits
    if bands is None:
        sample = usable(queries, "query_id").orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES)
        near = top_k(vectors, sample, k).select("similarity").toArrow()["similarity"].to_numpy()
        bands = bands_for(near, bits) if len(near) else 1
        if exact_if_cheaper and bands * ROWS_PER_CODE >= n_vectors:
            return top_k(vectors, queries, k)
    stored = materialise(band_codes(vectors, "vec_id", bands, bits, seed), "bands")
    asked = band_codes(queries, "query_id", bands, bits, seed)
    met = salted_join(stored, asked, ["dim", "band", "code"], "inner", spread_by=["vec_id"])
    pairs = met.select("query_id", "vec_id").distinct()
    near = pairs.join(usable(vectors, "vec_id"), "vec_id").join(
        usable(queries, "query_id").withColumnRenamed("embedding", "asked"), "query_id"
    )
    scored = near.select(
        "query_id", "vec_id", F.round(cosine("embedding", "asked"), DIGITS).alias("similarity")
    )
    return merged(scored, k)

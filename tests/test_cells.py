"""The stored cell index against exact search."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusatlas.operators import cells, vectors
from corpusatlas.plans.queries import QUERIES

SF = "/root/testdata/sf0.1"


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def recall(got, expected):
    return sum(len(got.get(q, set()) & e) for q, e in expected.items()) / sum(map(len, expected.values()))


def grouped(spark, n_groups, each, dim, seed):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((n_groups, dim))
    rows = np.repeat(centres, each, axis=0) + 0.3 * draw.standard_normal((n_groups * each, dim))
    table = [(i, r.tolist()) for i, r in enumerate(rows.astype(np.float32))]
    return spark.createDataFrame(table, "vec_id bigint, embedding array<float>").repartition(4)


def test_recall_of_the_registered_query(spark):
    expected = found(QUERIES["vector_topk"](spark, SF))
    assert len(expected) == 20
    assert recall(found(QUERIES["vector_topk_cells"](spark, SF)), expected) >= 0.9


def test_few_cells_are_read(spark, tmp_path):
    stored = grouped(spark, 400, 10, 32, 3).persist()
    asked = stored.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    index = cells.CellIndex.write(stored, str(tmp_path / "index"), k=10)
    n_cells = len(index.centres[32])
    assert n_cells == 63 and index.probes < n_cells / 4
    got, expected = index.search(asked, 10), vectors.top_k(stored, asked, 10)
    assert recall(found(got), found(expected)) >= 0.9
    # One query reads the folders of its own cells only.
    one = index.search(asked.where("query_id = 300"), 10)
    said = io.StringIO()
    placed = cells._to_cells(asked.where("query_id = 300"), "query_id", index.centres, index.probes)
    near = index.cells_read(placed.selectExpr("query_id", "dim", "explode(cells) AS cell"))
    with redirect_stdout(said):
        near.explain("formatted")
    assert "PartitionFilters: [isnotnull(dim" in said.getvalue() or "PartitionFilters: [(dim" in said.getvalue()
    folders = near.select(F.regexp_extract(F.input_file_name(), "cell=([0-9]+)", 1)).distinct().count()
    assert folders == index.probes < len(index.stored.inputFiles())
    assert found(one)[300] == found(got)[300]


def test_reopened_index_and_every_cell(spark, tmp_path):
    stored = grouped(spark, 30, 10, 8, 5).persist()
    asked = stored.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    cells.CellIndex.write(stored, str(tmp_path / "index"), k=5, n_cells=9, probes=9)
    index = cells.CellIndex.open(spark, str(tmp_path / "index"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    # All cells together are the whole table.
    assert rows(index.search(asked, 5)) == rows(vectors.top_k(stored, asked, 5))


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (None, [1.0, 0.0]), (7, [0.0, 0.0])]
    stored = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = cells.CellIndex.write(stored, str(tmp_path / "a"), k=3)
    asked = stored.withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in index.search(asked, 3, probes=9).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    exact = {}
    for r in vectors.top_k(stored, asked, 3).collect():
        exact.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in exact.items()}
    nothing = cells.CellIndex.write(stored.limit(0), str(tmp_path / "b"), k=3)
    assert nothing.search(asked, 3).count() == 0
    assert index.search(asked.limit(0), 3).count() == 0


def test_sample_is_bounded_and_the_same(spark):
    rows = spark.range(20_000).selectExpr("id AS vec_id")
    a, b = (cells.hashed_sample(rows, "vec_id", 20_000, 500).collect() for _ in range(2))
    assert a == b and 350 < len(a) < 650


@pytest.mark.parametrize("n", [1, 3, 50])
def test_spherical_means_are_units(n):
    rows = np.random.default_rng(1).standard_normal((40, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres = cells.spherical_means(rows, n)
    assert len(centres) == min(n, 40) and np.allclose(np.linalg.norm(centres, axis=1), 1)

"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import check_oracles
from __spark_entry__ import entry, oracle_sql, queries
from corpusatlas.plans.oracles import ORACLES
from corpusatlas.plans.queries import QUERIES

#: Approximate searches; `test_vectors.py` and `test_cells.py` measure their recall.
WITHOUT_SQL = {"vector_topk_lsh", "vector_topk_cells"}


@pytest.fixture(scope="module")
def connection(sf):
    made = duckdb.connect()
    for name in check_oracles.TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return made


def test_entry(spark):
    assert entry(spark).count() > 0


def test_keys():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITHOUT_SQL])
def test_equals_sql(spark, sf, connection, name):
    result = QUERIES[name](spark, sf)
    answer = connection.execute(ORACLES[name])
    assert set(result.columns) == {d[0] for d in answer.description}
    assert check_oracles._plain(result.toPandas()) == check_oracles._plain(answer.df())

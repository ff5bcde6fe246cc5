"""Merges into a stored table."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusatlas.operators import enrich
from corpusatlas.operators.merging import MergedTable

SCHEMA = StructType().add("repo", "string").add("path", "string").add("summary", "string").add("batch_id", "integer")


def files_of(table):
    return {b: place for b, (_, place) in table.in_force().items()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = MergedTable.create(spark, str(tmp_path / "t"), SCHEMA, ["repo", "path"], buckets=16)
    assert table.read().count() == 0 and table.merge(spark.createDataFrame([], SCHEMA)) == []
    first = spark.createDataFrame([("r", f"f{i}", "old", 0) for i in range(200)], SCHEMA)
    assert len(table.merge(first)) == 16
    before = files_of(table)
    names = {p: sorted(x.name for x in tmp_path.glob(f"t/data/**/{p.rsplit('/', 1)[1]}/*.parquet")) for p in before.values()}
    new = spark.createDataFrame([("r", "f3", "new", 1), ("r", "added", "new", 1), ("r", "f3", "stale", 0)], SCHEMA)
    touched = table.merge(new)
    after = files_of(table)
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == set(touched)
    kept = [p for b, p in after.items() if b not in touched]
    assert all(names[p] for p in kept)
    assert rows_of(table.read()) == rows_of(enrich.upsert(first, new, ["repo", "path"]).select(*SCHEMA.names))
    # Again, and from a fresh handle: the same rows.
    again = MergedTable.open(spark, str(tmp_path / "t"))
    again.merge(new)
    assert again == table and rows_of(again.read()) == rows_of(enrich.upsert(first, new, ["repo", "path"]).select(*SCHEMA.names))


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = MergedTable.create(spark, str(tmp_path / "t"), SCHEMA, ["repo", "path"], buckets=4)
    table.merge(spark.createDataFrame([("r", "a", "1", 0)], SCHEMA))
    before = rows_of(table.read())
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("killed")))
        new = table.read().withColumns({"summary": F.lit("2"), "batch_id": F.lit(1)})
        with pytest.raises(RuntimeError):
            table.merge(new)
    assert rows_of(table.read()) == before


def test_null_keys_and_older_versions(spark, tmp_path):
    table = MergedTable.create(spark, str(tmp_path / "t"), SCHEMA, ["repo", "path"], buckets=4)
    table.merge(spark.createDataFrame([(None, "a", "1", 5), ("r", None, "1", 5)], SCHEMA))
    table.merge(spark.createDataFrame([(None, "a", "2", 4), ("r", None, "2", 6)], SCHEMA))
    assert rows_of(table.read()) == sorted([(None, "a", "1", 5), ("r", None, "2", 6)], key=str)

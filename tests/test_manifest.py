"""Exclusion by a table of names against exclusion by a list."""

import random

import pytest

from corpusatlas.operators import manifest


@pytest.mark.parametrize("names", [
    ["a"], ["/"], ["src/"], ["x" * 17, "lib/core/deep"], ["é😀", "none"], ["ab", "abc", "abcd", "abcdefgh"], [], ["zz", None], [""], ["%", "_", "a.c"],
])
def test_table_equals_list(spark, names):
    draw = random.Random(7)
    paths = ["/".join("".join(draw.choices("abcxz.é😀%_", k=draw.randrange(1, 9))) for _ in range(draw.randrange(1, 5))) for _ in range(200)]
    paths += ["lib/core/deep/a.ts", "src/" + "x" * 20, "abcdefgh", "", "/"]
    listed = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    expected = manifest.exclude(listed, [n for n in names if n is not None])
    assert rows(manifest.exclude_names(listed, table)) == rows(expected)


def test_a_hundred_thousand_names(spark):
    listed = spark.range(3_000).selectExpr("'r' AS repo", "concat('src/mod', id, '.ts') AS path")
    names = spark.range(0, 300_000, 3).selectExpr("concat('mod', id, '.') AS name")
    kept = manifest.exclude_names(listed, names)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and len(plan) < 20_000
    assert kept.count() == 2_000

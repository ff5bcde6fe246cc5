"""The split paths give what plain windows and joins give, however skewed the keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusatlas.operators.ordered import numbered, running
from corpusatlas.operators.skew import salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [
        ("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", i, rng.choice([None, *range(9)]))
        for i in range(3000)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o int, v int").repartition(5).cache()


def as_set(df):
    return sorted(map(str, df.collect()))


def test_running_split_equals_window(skewed):
    values = {
        "s": ("sum", F.col("v")), "a": ("max", F.col("v")), "b": ("min", F.col("v")),
        "n": ("sum", F.lit(1).cast("bigint")),
    }
    split = running(
        skewed, ["g"], ["o"], values, totals=["s", "n"], at_most=3000, rows_per_task=300
    )
    packed = running(skewed, ["g"], ["o"], values, totals=["s", "n"])
    plain = running(skewed, ["g"], ["o"], values, totals=["s", "n"], at_most=3000)
    w = Window.partitionBy("g").orderBy("o")
    by_hand = skewed.select(
        "g", "o", "v", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("a"),
        F.min("v").over(w).alias("b"), F.row_number().over(w).cast("bigint").alias("n"),
        F.sum("v").over(Window.partitionBy("g")).alias("s_total"),
        F.count("*").over(Window.partitionBy("g")).alias("n_total"),
    )
    assert split.columns == by_hand.columns
    assert as_set(split) == as_set(packed) == as_set(plain) == as_set(by_hand)


def test_hot_group_is_spread(skewed):
    rows = numbered(skewed, ["g"], ["o"], "n", at_most=3000, rows_per_task=300)
    # The hot group alone spans several slices, each stored apart.
    assert len(rows.inputFiles()) == 10
    hot = rows.where("g = 'hot'").agg(F.max("n"), F.countDistinct("n")).first()
    assert hot[0] == hot[1] == skewed.where("g = 'hot'").count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("g1", 3), ("zz", 4)], "g string, r int")
    plain = skewed.join(right, ["g"], how)
    salted = salted_join(skewed, right, ["g"], how, spread_by=["o"], rows_per_split=100)
    assert salted.columns == plain.columns
    assert as_set(salted) == as_set(plain)


def test_salted_join_beyond_the_named_keys(spark, skewed):
    right = skewed.select("g").distinct().withColumn("r", F.length("g"))
    salted = salted_join(
        skewed, right, ["g"], "inner", spread_by=["o"], rows_per_split=10, broadcast_keys=2
    )
    assert as_set(salted) == as_set(skewed.join(right, ["g"]))


def test_salt_splits_the_hot_key(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "g string, r int")
    salted = salted_join(skewed, right, ["g"], "inner", spread_by=["o"], rows_per_split=100)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_split" in plan and "xxhash64" in plan


def test_unknown_join_kind(skewed):
    with pytest.raises(ValueError):
        salted_join(skewed, skewed, ["g"], "full_outer", spread_by=["o"])


def test_running_takes_a_null_group_for_a_group(spark):
    rows = [(None if i % 2 else "g", i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for rows_per_task in (5, 1_000):
        got = running(
            df, ["g"], ["o"], {"r": ("sum", F.col("v"))}, totals=["r"], at_most=40, rows_per_task=rows_per_task
        ).collect()
        assert len(got) == 40
        assert all(r.r == r.o // 2 + 1 and r.r_total == 20 for r in got)


def test_every_hot_key_is_dealt_out_and_null_keys_too(spark):
    rows = [(None if k == 0 else k, i) for k in range(60) for i in range(12)]
    left = spark.createDataFrame(rows, "k int, o int")
    right = spark.range(60).selectExpr("cast(id as int) k", "id * 2 as r")
    for how in ("left", "inner"):
        salted = salted_join(left, right, ["k"], how, spread_by=["o"], rows_per_split=3, broadcast_keys=5)
        assert as_set(salted) == as_set(left.join(right, ["k"], how))

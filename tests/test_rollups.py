"""Roll-ups in parts against the roll-up of everything."""

from pyspark.sql import functions as F

from corpusatlas.operators import rollups

LISTED = "repo string, path string, ext string"
EDGES = "repo string, path string, target string, resolved boolean, is_external boolean"


def table(spark, n):
    listed = spark.range(n).select(
        F.concat(F.lit("/r"), (F.col("id") % 3).cast("string")).alias("repo"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") % 2 == 0, ".ts").otherwise(".html").alias("ext"),
    )
    number = F.substring("path", 2, 20).cast("bigint")
    edges = listed.select("repo", "path", F.explode(F.array(number, number + 3, F.lit(7))).alias("t")).select(
        "repo", "path", F.concat("repo", F.lit("/x"), F.col("t").cast("string")).alias("target"),
        (F.col("t") % 5 != 0).alias("resolved"), (F.col("t") % 5 == 0).alias("is_external"),
    )
    return listed, edges


def test_merged_parts_equal_the_whole_and_keep_the_error(spark, tmp_path):
    listed, edges = table(spark, 60_000)
    batch = F.pmod(F.xxhash64("path"), F.lit(4))
    for n in range(4):
        part = rollups.partial(listed.where(batch == n), edges.where(batch == n))
        assert rollups.store(part, str(tmp_path), n)
    # A batch that comes again changes nothing.
    assert not rollups.store(rollups.partial(listed, edges), str(tmp_path), 2)
    found = {r.repo: r for r in rollups.totals(spark, str(tmp_path)).collect()}
    whole = {r.repo: r for r in rollups.estimated(rollups.partial(listed, edges)).collect()}
    exact = {r.repo: r.n for r in edges.where("resolved").groupBy("repo").agg(F.count_distinct("target").alias("n")).collect()}
    assert set(found) == set(whole) == {"/r0", "/r1", "/r2"}
    for repo, row in found.items():
        assert [row[c] for c in rollups.COUNTS] == [whole[repo][c] for c in rollups.COUNTS]
        assert exact[repo] > 10_000 and abs(row.n_targets - exact[repo]) <= rollups.ERROR * exact[repo]


def test_small_numbers_are_exact_and_nothing_is_nothing(spark, tmp_path):
    listed, edges = table(spark, 90)
    rows = {r.repo: r.n_targets for r in rollups.estimated(rollups.merged(rollups.partial(listed, edges))).collect()}
    exact = edges.where("resolved").groupBy("repo").agg(F.count_distinct("target").alias("n")).collect()
    assert rows == {r.repo: r.n for r in exact}
    alone = rollups.estimated(rollups.partial(listed, edges.limit(0))).collect()
    assert {r.n_targets for r in alone} == {0} and {r.n_references for r in alone} == {0}
    assert rollups.totals(spark, str(tmp_path / "none")).count() == 0

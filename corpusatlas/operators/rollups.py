"""Roll-ups by repository that are stored and merged, batch by batch.

A batch of files becomes one row for each repository: counts that add up, and a sketch of the
distinct targets its references lead to. Rows of any batches merge into the row of all their
files, so totals never read old files again. Sketches have a fixed size; their estimate is within
`ERROR` of the true number, and exact for small numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators.graph import internal
from corpusatlas.sources.published import Published

#: The sketch has 2 ** LOG_CELLS cells: a standard error of about 0.8 %, held to three times that.
LOG_CELLS, ERROR = 14, 0.025
COUNTS = ["n_files", "n_code", "n_references", "n_resolved", "n_external"]
SCHEMA = "repo string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", targets binary"


def partial(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each repository of a batch: its files and the references of these files."""
    listed = manifest.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("ext") == ".ts").alias("n_code")
    )
    linked = edges.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_references"), F.count_if("resolved").alias("n_resolved"),
        F.count_if("is_external").alias("n_external"),
    )
    # Reduced to a sketch before it is shuffled.
    targets = internal(edges).where("resolved").groupBy("repo").agg(F.hll_sketch_agg("target", F.lit(LOG_CELLS)).alias("targets"))
    return listed.join(linked, "repo", "left").join(targets, "repo", "left").fillna(0, subset=COUNTS)


def merged(*parts: DataFrame) -> DataFrame:
    """The row of all files together, for each repository."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("repo").agg(
        *(F.sum(c).alias(c) for c in COUNTS), F.hll_union_agg("targets", F.lit(False)).alias("targets")
    )


def estimated(rows: DataFrame) -> DataFrame:
    """Counts with `n_targets`, the estimated number of distinct targets."""
    return rows.select("repo", *COUNTS, F.coalesce(F.hll_sketch_estimate("targets"), F.lit(0)).alias("n_targets"))


def store(part: DataFrame, root: str, batch: int) -> bool:
    """Publish the rows of a batch; a batch that comes again is published once."""
    return Published(part.sparkSession, root).publish({"rollup": part}, batch)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Counts and estimates over all published batches: as many rows are read as batches have repositories."""
    return estimated(merged(Published(spark, root).read("rollup", SCHEMA).drop("version")))

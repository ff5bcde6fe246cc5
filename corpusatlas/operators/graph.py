"""The dependency graph between files and between projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.functions import paths
from corpusatlas.operators.manifest import contains_any
from corpusatlas.operators.skew import salted_join

# Style files that belong to a template's context.
STYLE_EXTENSIONS = [".css", ".scss"]


def internal(edges: DataFrame) -> DataFrame:
    """Edges whose target lies below the repository's own folder."""
    return edges.where(F.col("target").startswith(F.concat("repo", F.lit("/"))))


def template_importers(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """`(template, repo, importer)`: code files that name a template, once each.

    Flat rows: a template shared by very many files is never gathered.
    """
    templates = manifest.where(F.col("ext") == ".html").select(F.col("abs_path").alias("target"))
    named = edges.where(paths.extension(F.col("target")) == ".html")
    return (
        salted_join(named, templates, ["target"], "left_semi", spread_by=["abs_path", "pos"])
        .select(F.col("target").alias("template"), "repo", F.col("abs_path").alias("importer"))
        .distinct()
    )


def code_pieces(edges: DataFrame) -> DataFrame:
    """Files a code file depends on, in reference order: `(owner, source, place, piece)`."""
    return internal(edges).select(
        F.col("abs_path").alias("owner"),
        F.col("abs_path").alias("source"),
        F.col("pos").alias("place"),
        F.col("target").alias("piece"),
    )


def template_pieces(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files around a template: each importer, followed by that importer's styles."""
    importers = template_importers(edges, manifest)
    styles = internal(edges).where(
        paths.extension(F.col("target")).isin(*STYLE_EXTENSIONS)
    ).select(F.col("abs_path").alias("importer"), "pos", "target")
    own = importers.select(
        F.col("template").alias("owner"),
        F.col("importer").alias("source"),
        F.lit(-1).alias("place"),
        F.col("importer").alias("piece"),
    )
    second = importers.join(styles, "importer").select(
        F.col("template").alias("owner"),
        F.col("importer").alias("source"),
        F.col("pos").alias("place"),
        F.col("target").alias("piece"),
    )
    return own.unionByName(second)


def project_nodes(manifest: DataFrame, depth: int) -> DataFrame:
    """Projects: the first `depth` folders below a repository, with file counts."""
    return _with_project(manifest, "path", depth).groupBy("repo", "project").agg(
        F.count(F.lit(1)).alias("n_files")
    )


def project_edges(edges: DataFrame, depth: int) -> DataFrame:
    """Weighted edges between different projects of a repository."""
    inside = internal(edges).where("resolved").withColumn(
        "_target_path", F.expr("substring(target, length(repo) + 2)")
    )
    both = _with_project(inside, "path", depth).withColumnRenamed("project", "src")
    both = _with_project(both, "_target_path", depth).withColumnRenamed("project", "dst")
    return (
        both.where(F.col("src") != F.col("dst"))
        .groupBy("repo", "src", "dst")
        .agg(F.count(F.lit(1)).alias("n_imports"))
    )


def _with_project(df: DataFrame, column: str, depth: int) -> DataFrame:
    return df.withColumn("project", F.substring_index(F.col(column), "/", depth))


def filter_nodes(nodes: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return nodes.where(~contains_any(F.col("project"), excluded))


def filter_edges(
    edges: DataFrame, excluded: Sequence[str], targets_too: bool = False
) -> DataFrame:
    """Drop edges whose source holds an excluded name; targets only on request."""
    kept = edges.where(~contains_any(F.col("src"), excluded))
    return kept.where(~contains_any(F.col("dst"), excluded)) if targets_too else kept

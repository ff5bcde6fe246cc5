"""Manifests: listing, exclusion, eligibility, content and context kind."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.functions import paths

# Extensions that are enriched, by the context each one takes.
CONTEXT_KINDS = {
    "data": [".json", ".yaml", ".yml"],
    "template": [".html"],
    "code": [".ts"],
}
ENRICHED = [ext for group in CONTEXT_KINDS.values() for ext in group]


def scan(listing: DataFrame) -> DataFrame:
    """Manifest of `(repo, path)` rows: blank lines dropped, places worked out.

    Reads no content, so resolution never touches it.
    """
    repo = F.trim("repo")
    return listing.where(F.length("path") > 0).select(
        repo.alias("repo"),
        "path",
        paths.resolve(repo, F.col("path")).alias("abs_path"),
        paths.extension(F.col("path")).alias("ext"),
        paths.base_name(F.col("path")).alias("basename"),
    )


def union(*manifests: DataFrame) -> DataFrame:
    """One manifest of several repositories; `repo` tells them apart."""
    return reduce(lambda a, b: a.unionByName(b), manifests)


def contains_any(text: Column, names: Sequence[str]) -> Column:
    """Whether any of the names occurs anywhere in the text. Names come from settings."""
    if not names:
        return F.lit(False)
    if len(names) <= 32:
        return reduce(lambda a, b: a | b, (text.contains(name) for name in names))
    return F.exists(F.lit(list(names)), lambda name: text.contains(name))


def exclude(manifest: DataFrame, names: Sequence[str], column: str = "path") -> DataFrame:
    return manifest.where(~contains_any(F.col(column), names))


#: Lengths of the piece of a name that paths are looked up by; the longest that fits is taken.
ANCHORS = (16, 8, 4, 2, 1)


def _pieces(column: Column, n: int) -> Column:
    """All pieces of `n` characters, each once; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(column) - (n - 1))
    pieces = F.transform(starts, lambda i: F.substring(column, i, F.lit(n)))
    return F.when(F.length(column) >= n, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def exclude_names(manifest: DataFrame, names: DataFrame, column: str = "path") -> DataFrame:
    """The same as `exclude` for a table `(name)` of any size.

    Every name has one anchor, its piece with the least hash. A path is looked up by its own
    pieces of the anchors' lengths, and what it meets is tried whole, so a path meets few names and
    no expression grows with them. An empty name occurs in every path.
    """
    known = names.select("name").where("name is not null").distinct()
    if not known.where("name = ''").isEmpty():
        return manifest.limit(0)
    length = F.coalesce(*(F.when(F.length("name") >= n, n) for n in ANCHORS))
    anchored = known.withColumn("_n", length).withColumn(
        "_pieces", F.coalesce(*(F.when(F.col("_n") == n, _pieces(F.col("name"), n)) for n in ANCHORS))
    )
    ranked = F.transform("_pieces", lambda p: F.struct(F.xxhash64(p).alias("rank"), p.alias("piece")))
    anchors = anchored.select("name", F.array_min(ranked)["piece"].alias("_piece"))
    # Five numbers at most.
    in_use = [r["_n"] for r in anchored.select("_n").distinct().collect()]
    texts = manifest.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    pieces = F.concat(F.array().cast("array<string>"), *(_pieces(F.col("_text"), n) for n in sorted(in_use)))
    asked = texts.select("_text", F.explode(pieces).alias("_piece"))
    bad = asked.join(anchors, "_piece").where(F.col("_text").contains(F.col("name"))).select("_text").distinct()
    return manifest.join(bad, manifest[column] == F.col("_text"), "left_anti")


def eligible(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("ext").isin(*ENRICHED))


def pending(manifest: DataFrame, summaries: DataFrame) -> DataFrame:
    """Eligible files with no summary yet."""
    return eligible(manifest).join(summaries.select("abs_path"), "abs_path", "left_anti")


def context_kind(ext: Column) -> Column:
    """data, template or code; null for anything else."""
    column = F.lit(None).cast("string")
    for kind, extensions in CONTEXT_KINDS.items():
        column = F.when(ext.isin(*extensions), kind).otherwise(column)
    return column


def with_content(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Left join to `(abs_path, content)`; a failed read is empty and flagged."""
    found = contents.select("abs_path", F.col("content").alias("_read"))
    return manifest.join(found, "abs_path", "left").select(
        *manifest.columns,
        F.coalesce("_read", F.lit("")).alias("content"),
        F.col("_read").isNotNull().alias("read_ok"),
    )


def repositories_with(repositories: DataFrame, manifest: DataFrame, marker: str) -> DataFrame:
    """Repositories whose root holds the marker file."""
    holders = manifest.where(F.col("path") == marker).select("repo")
    return repositories.join(holders, "repo", "left_semi")

"""Files as tables of paths and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path listings, one file per repository named after it and one path per line."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("_name"))
    repo = F.regexp_replace(F.col("_name"), r"\.[^.]*$", "")
    return lines.where(F.length("value") > 0).select(repo.alias("repo"), F.col("value").alias("path"))


def tolerant_text(content: Column) -> tuple[Column, Column]:
    """The text of a file's bytes and whether it could be read; bad bytes give an empty text."""
    value = content.cast("string")
    valid = F.coalesce(F.is_valid_utf8(value), F.lit(False))
    return F.when(valid, value).otherwise(""), valid


def read_repository(spark: SparkSession, folder: str, repo: str | None = None) -> DataFrame:
    """`(repo, path, content, read_ok)` of every file below a folder, in UTF-8.

    A file that is no UTF-8 text has an empty content and `read_ok` false; others go on.
    """
    root = (repo or folder).rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    )
    place = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    start = F.length(F.lit(folder.rstrip("/"))) + 2
    content, read_ok = tolerant_text(F.col("content"))
    return files.select(
        F.lit(root).alias("repo"),
        F.substring(place, start, F.length(place)).alias("path"),
        content.alias("content"),
        read_ok.alias("read_ok"),
    )

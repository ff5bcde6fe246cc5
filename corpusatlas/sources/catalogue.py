"""Reading and writing catalogues, document stores and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import postings
from corpusatlas.sources.published import Published, publish_once

# What to do when the target exists: leave it, replace it, or stop.
MODES = {"skip": "ignore", "rebuild": "overwrite", "stop": "errorifexists"}


def _mode(if_exists: str) -> str:
    if if_exists not in MODES:
        raise ValueError(f"if_exists must be one of {sorted(MODES)}")
    return MODES[if_exists]


def read_catalogues(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Catalogue files `ast-*.json`, one object each, with the schema given."""
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", "ast-*.json")
        .option("multiLine", True)
        .json(folder)
    )


def write_catalogue(
    records: DataFrame, folder: str, if_exists: str = "stop", form: str = "parquet"
) -> None:
    """One partition per repository id. Rebalancing splits a repository that is too
    large for one task and keeps small ones in one file."""
    spread = records.hint("rebalance", "repository")
    spread.write.mode(_mode(if_exists)).partitionBy("repository").format(form).save(folder)


def write_document_store(
    chunks: DataFrame, folder: str, store: str, if_exists: str = "stop"
) -> None:
    """Chunks with `(chunk_id, text, metadata, embedding)` below a folder per store."""
    chunks.write.mode(_mode(if_exists)).parquet(f"{folder.rstrip('/')}/{store}")


def write_log(lines: DataFrame, folder: str, column: str = "line") -> None:
    """Log lines as text; a line end inside a message would split it and is escaped."""
    lines.select(F.regexp_replace(F.col(column), r"\r?\n", r"\\n").alias("value")).write.mode(
        "append"
    ).text(folder)


def publish_catalogue(records: DataFrame, root: str, if_exists: str = "stop") -> int:
    """Publish records and their postings as one version; the version in force.

    Records lie by repository. Postings lie by kind and in the order of names, so that a look-up
    reads the row groups that may hold its names.
    """
    spread = records.hint("rebalance", "repository")
    stored = {"records": spread, "postings": postings.in_order(postings.of_records(records))}
    store = Published(records.sparkSession, root)
    if if_exists == "skip" and store.latest() is not None:
        return store.latest()
    return publish_once(stored, root, if_exists, {"records": ["repository"], "postings": ["kind"]})


def read_published_catalogue(spark: SparkSession, root: str) -> DataFrame:
    return Published(spark, root).current("records")


def lookup_published(spark: SparkSession, root: str, example: postings.Example) -> DataFrame:
    """`(repository, fileName)` of the records that match, from the postings alone."""
    return postings.matching(Published(spark, root).current("postings"), example)


def publish_document_store(chunks: DataFrame, root: str, if_exists: str = "stop") -> int:
    """Publish chunks with `(chunk_id, text, metadata, embedding)`; the version in force."""
    return publish_once({"chunks": chunks}, root, if_exists)


def read_published_documents(spark: SparkSession, root: str) -> DataFrame:
    return Published(spark, root).current("chunks")

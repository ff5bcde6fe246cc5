"""From raw documents to pieces: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
`documents`; the last one returns the pieces of every text that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.llm import decontaminate, language, near_dedup, pieces, site_lines
from corpusatlas.llm.queries import model_file
from corpusatlas.session import scratch_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from the rows it is given."""
    model = language.fit(docs.where(~language.held_out()))
    return language.identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that most pages of their source share; n_chars follows."""
    cleaned = site_lines.without_boilerplate(docs)
    _, dropped = site_lines.count_names(docs.columns)
    n_chars = F.when(F.col(dropped) > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that repeat an id are judged each by its own text.
    """
    row_key = F.xxhash64("text")
    found = near_dedup.near_duplicates(docs, row_key=row_key)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_dropped_id"), F.col("row_key").alias("_dropped_key")).distinct()
    same = (docs["doc_id"] == F.col("_dropped_id")) & (row_key == F.col("_dropped_key"))
    return docs.join(dropped, same, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.decontaminated(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text that is left."""
    vocabulary = pieces.Vocabulary.load(model_file())
    return pieces.encoded(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids"
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encode),
]

#: The language model and the lattice are not expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Documents from files and records, cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.functions import paths, text


def chunked(
    docs: DataFrame, size: int = text.CHUNK_TOKENS, overlap: int = 0, column: str = "text"
) -> DataFrame:
    """One row per chunk; every other column is repeated. Narrow: no shuffle."""
    others = [c for c in docs.columns if c != column]
    return docs.select(
        *others,
        F.posexplode(text.chunks(F.col(column), size, overlap)).alias("chunk_no", column),
    )


def _metadata(**entries: Column) -> Column:
    pairs = [part for name, value in entries.items() for part in (F.lit(name), value)]
    return F.create_map(*pairs)


def from_files(files: DataFrame, size: int = text.CHUNK_TOKENS) -> DataFrame:
    """Chunks of file texts under a path header: `(metadata, chunk_no, text)`."""
    body = F.concat(
        F.lit("file-path: "), F.col("path"), F.lit("\n\n    "), F.col("content"), F.lit("\n    ")
    )
    metadata = _metadata(
        repository=paths.base_name(F.col("repo")),
        repositoryUrl=F.col("repo"),
        source=F.col("path"),
    )
    return chunked(files.select(metadata.alias("metadata"), body.alias("text")), size)


def from_records(records: DataFrame, size: int = text.CHUNK_TOKENS) -> DataFrame:
    """Chunks of file records written as JSON; null fields are left out."""
    metadata = _metadata(
        source=F.col("fileName"), repository=paths.base_name(F.col("repository"))
    )
    body = F.to_json(F.struct(*records.columns))
    return chunked(records.select(metadata.alias("metadata"), body.alias("text")), size)


def chunk_key(repository: Column, source: Column, chunk_no: Column) -> Column:
    """The text whose digest names a chunk."""
    return F.concat_ws("\n", repository, source, chunk_no.cast("string"))


def with_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks of a store: `(chunk_id, text, metadata, embedding)`.

    The id is a digest of source and chunk number, so it is the same in every run;
    vectors `(chunk_id, embedding)` come from outside and may be missing.
    """
    key = chunk_key(F.col("metadata")["repository"], F.col("metadata")["source"], F.col("chunk_no"))
    identified = chunks.withColumn("chunk_id", F.sha2(key, 256))
    return identified.join(embeddings, "chunk_id", "left").select(
        "chunk_id", "text", "metadata", "embedding"
    )


# Operation modes, the model each selects, and whether its context is large.
MODES = [
    ("openai-std", "gpt-4", False),
    ("azure-std", "gpt-4-32k", True),
    ("gpt4turbo", "gpt-4-1106-preview", True),
]
DEFAULT_MODEL = "gpt-4-1106-preview"


def with_tier(rows: DataFrame, mode: str = "mode") -> DataFrame:
    """Add the model and context size of a mode; an unknown mode takes the default.

    Three rows need no join: the table is a constant map inside the projection.
    """
    models = F.create_map(*(F.lit(v) for m, model, _ in MODES for v in (m, model)))
    large = F.create_map(*(F.lit(v) for m, _, is_large in MODES for v in (m, is_large)))
    return rows.withColumns(
        {
            "model": F.coalesce(F.try_element_at(models, F.col(mode)), F.lit(DEFAULT_MODEL)),
            "large_context": F.coalesce(F.try_element_at(large, F.col(mode)), F.lit(False)),
        }
    )

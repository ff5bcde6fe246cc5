"""Enrichment in committed batches that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusatlas.operators.enrich import BATCH_FILES
from corpusatlas.sources.files import tolerant_text


def enrich_new_files(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    enrich: Callable[[DataFrame], DataFrame],
    files_per_batch: int = BATCH_FILES,
    bytes_per_batch: int | None = None,
) -> StreamingQuery:
    """Read files not seen before, a batch at a time, and stop when all are done.

    `enrich` gets `(path, content, read_ok)`; a file that is no UTF-8 text has an empty
    content. With `bytes_per_batch` a batch is sized by bytes, which large stores need. Each batch is written to its own `batch_id=N` folder. A batch that is replayed
    after a failure replaces that folder, so no summary appears twice.
    """
    content, read_ok = tolerant_text(F.col("content"))
    limit = (
        ("maxFilesPerTrigger", files_per_batch)
        if bytes_per_batch is None
        else ("maxBytesPerTrigger", bytes_per_batch)
    )
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option(*limit)
        .load(folder)
        .select("path", content.alias("content"), read_ok.alias("read_ok"))
    )

    def commit(batch: DataFrame, batch_id: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

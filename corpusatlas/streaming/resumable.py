"""The enrichment job as a stream of numbered batches that stops and resumes anywhere.

Pending files are dealt into batches of a fixed number of files, one queue file each; a caller may
bound the queue files, which then hold several whole batches. A stream
takes some queue files at a time; inside `foreachBatch` they meet the catalogue's edges and texts,
which are static. What comes out is published under the number of the micro-batch: it counts
when the manifest names it, and a batch that runs again is published once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusatlas.operators import enrich, manifest
from corpusatlas.plans import jobs
from corpusatlas.session import materialise
from corpusatlas.sources.published import Published

SUMMARIES = "repo string, path string, abs_path string, batch_no bigint, summary string, outcome string, n_tokens bigint"
QUARANTINE = "repo string, path string, abs_path string, batch_no bigint, reason string, n_tokens bigint"
_QUEUED = "repo string, path string, abs_path string, batch_no bigint"


def queue(
    pending: DataFrame, folder: str, files_per_batch: int = enrich.BATCH_FILES, most_files: int | None = None
) -> int:
    """Write `(repo, path, abs_path)` as one file for each batch of a repository; the number of queue files.

    More batches than `most_files` share so many files, each batch whole in one of them, because
    folders and listings of single batches cost more than their rows. Further calls add to the
    queue; a stream takes each file once.
    """
    # Wanted twice.
    numbered = materialise(enrich.assign_batches(pending.select("repo", "path", "abs_path"), files_per_batch), "queued")
    batches = numbered.select("repo", "batch_no").distinct()
    n_files = batches.count()
    batch = F.concat_ws("-", F.sha2("repo", 256), F.col("batch_no").cast("string"))
    if most_files is not None and n_files > most_files:
        batch = F.pmod(F.xxhash64("repo", "batch_no"), F.lit(most_files)).cast("string")
        n_files = batches.select(batch).distinct().count()
    # One task for each queue file, as far as there are tasks.
    numbered.withColumn("batch", batch).repartition("batch").write.mode("append").partitionBy("batch").parquet(folder)
    return n_files


@dataclass
class ResumableJob:
    """Enrichment of queued files; see the module's text."""

    spark: SparkSession
    catalogue: jobs.Catalogue
    queue_folder: str
    root: str
    passes: int = enrich.PASSES
    model: enrich.Model | None = None

    @property
    def store(self) -> Published:
        return Published(self.spark, f"{self.root.rstrip('/')}/published")

    def summaries(self) -> DataFrame:
        """Accepted summaries of all published batches."""
        return self.store.read("summaries", SUMMARIES)

    def quarantine(self) -> DataFrame:
        return self.store.read("quarantine", QUARANTINE)

    def enrich_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: leave out what is done, enrich the rest, publish it."""
        store = self.store
        if store.has(batch_id):
            # Published before the stream could note it down.
            return
        files = batch.dropDuplicates(["abs_path"])
        todo = files.join(self.summaries().select("abs_path"), "abs_path", "left_anti")
        outcomes = jobs.enrich_files(self.catalogue, todo, self.passes, self.model)
        named = outcomes.join(files.select("abs_path", "batch_no"), "abs_path")
        # Two tables come from one enrichment, so it is stored first, without the texts.
        accepted, refused = enrich.split_outcome(
            jobs.stored_outcomes(named, ["repo", "path", "abs_path", "batch_no", "outcome", "summary", "reason", "n_tokens"])
        )
        columns = [f.split()[0] for f in SUMMARIES.split(", ")]
        store.publish(
            {
                "summaries": accepted.select(*columns),
                "quarantine": refused.select("repo", "path", "abs_path", "batch_no", "reason", "n_tokens"),
            },
            batch_id,
        )

    def start(self, batches_per_commit: int = 1) -> StreamingQuery:
        """Work through the queue and stop when it is empty; call it again after a failure or for new files.

        A commit takes `batches_per_commit` queue files, which are batches unless the queue was bounded.
        """
        queued = (
            self.spark.readStream.schema(_QUEUED).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", batches_per_commit).parquet(self.queue_folder)
        )
        return (
            queued.writeStream.foreachBatch(self.enrich_batch)
            .option("checkpointLocation", f"{self.root.rstrip('/')}/progress")
            .trigger(availableNow=True).start()
        )

    def run(self, batches_per_commit: int = 1) -> None:
        started = self.start(batches_per_commit)
        started.awaitTermination()
        if started.exception() is not None:
            raise started.exception()


def pending_files(catalogue: jobs.Catalogue, summaries: DataFrame) -> DataFrame:
    """What a queue should hold: eligible files without a summary."""
    return manifest.pending(catalogue.manifest, summaries).select("repo", "path", "abs_path")

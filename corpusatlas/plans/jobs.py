"""The two jobs as a whole: index repositories, then enrich what is pending."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import context, enrich, imports, manifest, records
from corpusatlas.operators.imports import AliasRule
from corpusatlas.session import materialise
from corpusatlas.sources.code_files import located


@dataclass(frozen=True)
class Catalogue:
    """Tables of all repositories together, told apart by `repo`."""

    files: DataFrame
    manifest: DataFrame
    edges: DataFrame
    # Texts of excluded files too: they may still be somebody's context.
    contents: DataFrame

    def records(self) -> DataFrame:
        return records.file_records(self.files, self.edges)


def index(
    listing: DataFrame,
    aliases: Sequence[AliasRule] | DataFrame = (),
    excluded: Sequence[str] = (),
    base_url: str = ".",
) -> Catalogue:
    """Catalogue of `(repo, path, content)` rows.

    Imports resolve against every listed file, because an excluded file still exists;
    excluded files get no record, no edges and no summary of their own.
    """
    every = manifest.scan(listing.select("repo", "path"))
    found = located(listing)
    files = manifest.exclude(found, excluded)
    edges = imports.resolve(imports.references(files), every, aliases, base_url)
    return Catalogue(
        files,
        manifest.exclude(every, excluded),
        materialise(edges, "edges"),
        found.select("abs_path", "content"),
    )


def enrich_pending(
    catalogue: Catalogue,
    summaries: DataFrame,
    passes: int = enrich.PASSES,
    model: enrich.Model | None = None,
) -> DataFrame:
    """Prompt, refine and check every eligible file without a summary.

    A `model` finds the prompt beside the content. Failed files come out as
    quarantine and stay pending.
    """
    return enrich_files(catalogue, manifest.pending(catalogue.manifest, summaries), passes, model)


def enrich_files(
    catalogue: Catalogue,
    wanted: DataFrame,
    passes: int = enrich.PASSES,
    model: enrich.Model | None = None,
) -> DataFrame:
    """The same for the files that `wanted` names by `abs_path`."""
    # Paths only, and wanted three times.
    named = materialise(wanted.select("abs_path"), "pending")
    prompts = context.prompts(
        catalogue.files,
        catalogue.edges,
        catalogue.manifest,
        wanted=named,
        contents=catalogue.contents,
    )
    if model is not None:
        # Contexts are gathered once, however many passes follow.
        prompts = materialise(prompts, "prompts")
    return enrich.outcome(enrich.refine(prompts, passes, model))


def stored_outcomes(outcomes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of outcomes as a table, so that enrichment runs once for all its readers."""
    return materialise(outcomes.select(*columns), "outcomes")


def commit(outcomes: DataFrame, folder: str, batch_id: int) -> None:
    """Write one batch of outcomes; writing it again replaces it."""
    kept = stored_outcomes(outcomes, ["repo", "path", "abs_path", "outcome", "summary", "reason"])
    accepted, refused = enrich.split_outcome(kept)
    root = folder.rstrip("/")
    accepted.select("repo", "path", "abs_path", "summary").write.mode("overwrite").parquet(
        f"{root}/summaries/batch_id={batch_id}"
    )
    refused.select("repo", "path", "abs_path", "reason").write.mode("overwrite").parquet(
        f"{root}/quarantine/batch_id={batch_id}"
    )


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """Latest summary per file over all batches."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/summaries")
    latest = F.max_by(F.struct("summary", "batch_id"), F.col("batch_id"))
    return (
        rows.groupBy("repo", "path", "abs_path")
        .agg(latest.alias("_latest"))
        .select("repo", "path", "abs_path", "_latest.*")
    )

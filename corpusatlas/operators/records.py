"""Nested file records, look-up by example and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.functions import answers, markup, source
from corpusatlas.operators.enrich import tag_by_rule
from corpusatlas.operators.graph import internal


def file_records(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row per code, HTML or JSON file.

    Everything but the import targets comes from the file's own text in one
    projection. Targets of a file are gathered again after resolution; they came
    from one text, so the group is no larger than that text was.
    """
    targets = edges.groupBy("abs_path").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda e: e["target"]
        ).alias("imports")
    )
    ext, content = F.col("ext"), F.col("content")
    code = ext == ".ts"
    return (
        files.where(ext.isin(".ts", ".html", ".json"))
        .join(targets, "abs_path", "left")
        .select(
            F.col("repo").alias("repository"),
            F.col("abs_path").alias("fileName"),
            F.when(
                code, F.coalesce("imports", F.array().cast("array<string>"))
            ).alias("imports"),
            F.when(code, source.functions(content)).alias("functions"),
            F.when(code, source.classes(content)).alias("classes"),
            F.when(code, source.interfaces(content)).alias("interfaces"),
            F.when(ext == ".html", markup.tags(content)).alias("tags"),
            F.when(ext == ".json", answers.tolerant(content)).alias("json"),
            F.when(code, content).alias("sourceCode"),
        )
    )


def lookup(
    records: DataFrame,
    files: Sequence[str] = (),
    repository: str | None = None,
    file_name: str | None = None,
    imports: Sequence[str] = (),
    functions: Sequence[str] = (),
    classes: Sequence[str] = (),
    interfaces: Sequence[str] = (),
    tags: Sequence[str] = (),
) -> DataFrame:
    """Records that match every given part of an example; names match if any occurs."""
    def named(column: str, field: str, wanted: Sequence[str]) -> Column:
        return F.exists(F.col(column), lambda item: item[field].isin(*wanted))

    tests = []
    if files:
        tests.append(F.col("fileName").isin(*files))
    if repository is not None:
        tests.append(F.col("repository") == repository)
    if file_name is not None:
        tests.append(F.col("fileName") == file_name)
    if imports:
        tests.append(F.arrays_overlap("imports", F.lit(list(imports))))
    for column, field, wanted in (
        ("functions", "name", functions),
        ("classes", "name", classes),
        ("interfaces", "name", interfaces),
        ("tags", "tag", tags),
    ):
        if wanted:
            tests.append(named(column, field, wanted))
    return records.where(reduce(lambda a, b: a & b, tests)) if tests else records


def repo_summary(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per repository: files by kind, references by where they lead."""
    def when(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    ext = F.col("ext")
    listed = manifest.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"),
        when(ext == ".ts", "n_code"),
        when(ext == ".html", "n_template"),
        when(ext.isin(".json", ".yaml", ".yml"), "n_data"),
        when(ext.isin(".css", ".scss"), "n_style"),
    )
    linked = edges.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_references"),
        when(F.col("resolved"), "n_resolved"),
        when(F.col("is_external"), "n_external"),
    )
    # In-degree is reduced per target first, so a popular target is one row afterwards.
    degrees = (
        internal(edges).where("resolved").groupBy("repo", "target").agg(F.count(F.lit(1)).alias("_d"))
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("n_targets"), F.max("_d").alias("max_in_degree"))
    )
    numbers = [
        "n_references", "n_resolved", "n_external", "n_targets", "max_in_degree",
    ]
    return (
        listed.join(linked, "repo", "left").join(degrees, "repo", "left").fillna(0, subset=numbers)
    )


def tag_rollup(manifest: DataFrame) -> DataFrame:
    """Files per repository and tag, with subtotals; null stands for all."""
    return (
        manifest.withColumn("tag", tag_by_rule(F.col("path")))
        .rollup("repo", "tag")
        .agg(F.count(F.lit(1)).alias("n_files"), F.grouping_id().cast("int").alias("level"))
    )

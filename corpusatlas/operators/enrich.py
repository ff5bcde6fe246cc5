"""Incremental enrichment: batches, refinement passes, checks and upsert."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusatlas.functions import answers, paths, text
from corpusatlas.operators.ordered import numbered
from corpusatlas.session import materialise

# Files per committed batch, and refinement passes.
BATCH_FILES = 50
PASSES = 3

# A caller's function: (rows, step, pass number) -> one text per row, None for a failure.
Model = Callable[[pd.DataFrame, str, int], Sequence]

_STATE = ["answer", "questions", "answers"]


def assign_batches(files: DataFrame, size: int = BATCH_FILES, **bounds) -> DataFrame:
    """Add `batch_no`: runs of `size` files per repository in path order."""
    rows = numbered(files, ["repo"], ["path"], "_n", **bounds)
    return rows.withColumn(
        "batch_no", F.floor((F.col("_n") - 1) / F.lit(size)).cast("bigint")
    ).drop("_n")


def upsert(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], version: str = "batch_id"
) -> DataFrame:
    """Latest row per key. Versions of a key are reduced before they are shuffled."""
    rows = existing.unionByName(new)
    others = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*others), F.col(version))
    return rows.groupBy(*keys).agg(latest.alias("_latest")).select(*keys, "_latest.*")


def tag_by_rule(path: Column) -> Column:
    """Stand-in for a model's tag, from extension and name."""
    ext = paths.extension(path)
    return (
        F.when(ext.isin(".html", ".css", ".scss"), "ui")
        .when(ext.isin(".json", ".yaml", ".yml"), "dataAccess")
        .when(paths.base_name(path).startswith("index."), "utility")
        .otherwise("feature")
    )


def _sentences(content: Column) -> Column:
    """All sentences of a text, those with the most tokens first, then in the text's order."""
    found = F.regexp_extract_all(content, F.lit(r"[^.!?\n]*[^.!? \n\t\r][^.!?\n]*[.!?]?"), F.lit(0))
    ranked = F.array_sort(
        F.transform(
            found, lambda s, i: F.struct((-text.token_count(s)).alias("rank"), i.alias("at"), F.trim(s).alias("said"))
        )
    )
    return F.transform(ranked, lambda s: s["said"])


def _summary(n: int) -> Column:
    """Pass `n` keeps what the last answer said and adds the densest sentence that is left."""
    before = F.get_json_object(F.col("answer"), "$.fileDescription")
    sentences = F.col("_sentences")
    detail = F.struct(
        F.col("_tokens").alias("tokens"),
        F.size(sentences).cast("bigint").alias("sentences"),
        F.col("answers").alias("verification"),
        # Of everything that was read: a change in a related file changes it too.
        F.sha2(F.col("_read"), 256).alias("digest"),
    )
    return F.to_json(
        F.struct(
            F.concat_ws(" ", before, F.get(sentences, F.lit(n))).alias("fileDescription"),
            tag_by_rule(F.col("path")).alias("tag"),
            detail.alias("elementsDetail"),
        )
    )


def _questions() -> Column:
    said = F.get_json_object(F.col("answer"), "$.fileDescription")
    return F.concat(F.lit("Does the file say: "), said)


def _answers() -> Column:
    said = F.get_json_object(F.col("answer"), "$.fileDescription")
    verdict = F.when(F.col("_read").contains(said), "yes").otherwise("no")
    return F.concat(verdict, F.lit(", in "), F.length("_read").cast("string"), F.lit(" characters"))


def _guarded(model: Model, rows: pd.DataFrame, step: str, n: int) -> Sequence:
    """A failing batch is tried row by row, so only the failing rows are lost."""
    try:
        said = list(model(rows, step, n))
        if len(said) != len(rows):
            raise ValueError("a model gives one answer for each row")
        return said
    except Exception:
        if len(rows) == 1:
            return [None]
        return [_guarded(model, rows.iloc[[i]], step, n)[0] for i in range(len(rows))]


def _ask(state: DataFrame, model: Model, column: str, step: str, n: int) -> DataFrame:
    def answer(batches):
        for rows in batches:
            yield rows.assign(**{column: _guarded(model, rows, step, n)})

    # Kept as a table, so that a lost executor never repeats a model's work.
    return materialise(state.mapInPandas(answer, state.schema), f"{step}-{n}")


def refine(files: DataFrame, passes: int = PASSES, model: Model | None = None) -> DataFrame:
    """Answer per file after `passes` passes, each fed the answer before it.

    Input `(repo, path, content, …)`, with `prompt` if one was made. After the first pass, questions are drawn from
    its answer and answered from the file; later passes see both. Without a `model`
    the steps are built-in expressions over all of the prompt (without one, of the text), and
    nothing leaves the JVM.
    """
    state = files.select("*", *(F.lit(None).cast(T.StringType()).alias(c) for c in _STATE))
    if model is None:
        # Facts of the whole guarded prompt, or of the text without one, worked out once for all passes.
        read = F.col("prompt") if "prompt" in files.columns else F.col("content")
        state = state.withColumns(
            {"_sentences": _sentences(read), "_tokens": text.token_count(read), "_read": read}
        )
    for n in range(passes):
        if model is None:
            state = state.withColumn("answer", _summary(n))
            if n == 0:
                state = state.withColumn("questions", _questions())
                state = state.withColumn("answers", _answers())
            continue
        state = _ask(state, model, "answer", "summary", n)
        if n == 0:
            state = _ask(state, model, "questions", "questions", n)
            state = _ask(state, model, "answers", "answers", n)
    return state.drop("_sentences", "_tokens", "_read")


def validated(rows: DataFrame, column: str = "answer") -> DataFrame:
    """Add `errors`: the rules the answer breaks."""
    return rows.withColumn("errors", answers.errors(F.col(column)))


def outcome(rows: DataFrame, column: str = "answer") -> DataFrame:
    """Check, repair what fails once, and check again.

    Adds `outcome` (valid, repaired, quarantine), the accepted `summary` and `reason`.
    """
    first = answers.errors(F.col(column))
    checked = rows.withColumn("_first", F.array_join(first, ","))
    # Repair is looked at for failures only.
    fixed = F.when(F.col("_first") != "", answers.repaired(F.col(column)))
    tried = checked.withColumn("_fixed", fixed).withColumn(
        "_second",
        F.when(
            F.col("_first") != "",
            F.when(F.col("_fixed").isNull(), F.col("_first")).otherwise(
                F.array_join(answers.errors(F.col("_fixed")), ",")
            ),
        ),
    )
    kind = (
        F.when(F.col("_first") == "", "valid")
        .when(F.col("_second") == "", "repaired")
        .otherwise("quarantine")
    )
    return tried.select(
        *rows.columns,
        kind.alias("outcome"),
        F.when(kind == "valid", F.col(column))
        .when(kind == "repaired", F.col("_fixed"))
        .alias("summary"),
        F.when(kind == "quarantine", F.col("_second")).alias("reason"),
    )


def split_outcome(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted summaries and the quarantine of an `outcome` table."""
    accepted = rows.where(F.col("outcome") != "quarantine").drop("reason")
    refused = rows.where(F.col("outcome") == "quarantine").drop("summary")
    return accepted, refused

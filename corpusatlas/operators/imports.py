"""Import references and their resolution against the manifest.

Each distinct (folder, specifier) pair is resolved once. Its candidate places are
ranked, looked up in the manifest by an equi-join, and the best rank that exists wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.functions import paths, source
from corpusatlas.operators.skew import ROWS_PER_SPLIT, salted_join
from corpusatlas.session import materialise_counted

RELATIVE, BARE, ASSET = "relative", "bare", "asset"
_LOOKUP = ["repo", "kind", "base", "specifier"]
_ALIASES = (
    "array<struct<prefix:string,suffix:string,wild:boolean,"
    "target_prefix:string,target_suffix:string,target_wild:boolean>>"
)
# Base places are tried after all alias places; a rank has the rule, then its target.
_BASE_RANK = 1 << 62
_TARGET_BITS = 20


@dataclass(frozen=True)
class AliasRule:
    """A module pattern with at most one `*`, and its targets in order."""

    pattern: str
    targets: tuple[str, ...]


def alias_column(rules: Sequence[AliasRule]) -> Column:
    """Rules as an array in order of pattern, then target."""
    flat = []
    for rule in rules:
        prefix, star, suffix = rule.pattern.partition("*")
        for target in rule.targets:
            before, target_star, after = target.partition("*")
            values = (prefix, suffix, bool(star), before, after, bool(target_star))
            flat.append(F.struct(*(F.lit(v) for v in values)))
    return F.array(*flat).cast(_ALIASES)


def rule_rows(spark: SparkSession, rules: Sequence[AliasRule] | DataFrame) -> DataFrame:
    """Rules as rows `(repo, prefix, suffix, wild, target_prefix, target_suffix, target_wild, rank)`.

    `rules` hold for all repositories (a null repo), or are a table: `(repo, aliases)` made with
    `alias_column`, or `(repo, pattern, target, rule_no, target_no)` with any number of rows.
    """
    named = "prefix string, suffix string, wild boolean, target_prefix string, target_suffix string, target_wild boolean"
    if not isinstance(rules, DataFrame):
        flat = []
        for n, rule in enumerate(rules):
            prefix, star, suffix = rule.pattern.partition("*")
            for m, target in enumerate(rule.targets):
                before, target_star, after = target.partition("*")
                flat.append((None, prefix, suffix, bool(star), before, after, bool(target_star), n << _TARGET_BITS | m))
        return spark.createDataFrame(flat, f"repo string, {named}, rank bigint")
    if "aliases" in rules.columns:
        placed = rules.select("repo", F.posexplode("aliases").alias("_n", "_r"))
        return placed.select("repo", "_r.*", (F.col("_n").cast("bigint") * (1 << _TARGET_BITS)).alias("rank"))

    def cut(column: str, prefix: str, suffix: str, wild: str) -> list[Column]:
        star = F.instr(column, "*")
        return [
            F.when(star > 0, F.substring(F.col(column), F.lit(1), star - 1)).otherwise(F.col(column)).alias(prefix),
            F.when(star > 0, F.substring(F.col(column), star + 1, F.length(column))).otherwise("").alias(suffix),
            (star > 0).alias(wild),
        ]

    rank = F.col("rule_no").cast("bigint") * (1 << _TARGET_BITS) + F.col("target_no")
    return rules.select(
        "repo", *cut("pattern", "prefix", "suffix", "wild"), *cut("target", "target_prefix", "target_suffix", "target_wild"),
        rank.alias("rank"),
    )


def references(contents: DataFrame, assets: bool = True) -> DataFrame:
    """One row per import of a code file, then per asset its decorators name.

    Input `(repo, path, abs_path, ext, content)`; one scan, no shuffle.
    """
    found = F.transform(
        source.import_specifiers(F.col("content")),
        lambda s: F.struct(
            F.when(s.startswith("./") | s.startswith("../"), RELATIVE).otherwise(BARE).alias("kind"),
            s.alias("specifier"),
        ),
    )
    if assets:
        named = source.decorator_assets(F.col("content"))
        found = F.concat(
            found,
            F.transform(
                named, lambda s: F.struct(F.lit(ASSET).alias("kind"), s.alias("specifier"))
            ),
        )
    rows = contents.where(F.col("ext") == ".ts").select(
        "repo", "path", "abs_path", F.posexplode(found).alias("pos", "_found")
    )
    return rows.select(
        "repo", "path", "abs_path", "pos", F.col("_found.kind"), F.col("_found.specifier")
    )


def existing_places(manifest: DataFrame) -> DataFrame:
    """What a name can stand for: `(stem, target, probe, is_file)`.

    A file answers to its own path (probe 0); an index file also to its folder (1); a
    code file also to its path without `.ts` (2). Folders answer to their own path. The
    endings are taken off the few files here and not tried on the many imports there.
    """
    path = F.col("abs_path")

    def answers_to(stem: Column, probe: int) -> Column:
        return F.struct(stem.alias("stem"), F.lit(probe).alias("probe"))

    stems = F.array_compact(
        F.array(
            answers_to(path, 0),
            F.when(
                path.endswith("/index.ts"),
                answers_to(F.substring(path, F.lit(1), F.length(path) - len("/index.ts")), 1),
            ),
            F.when(
                path.endswith(".ts"),
                answers_to(F.substring(path, F.lit(1), F.length(path) - len(".ts")), 2),
            ),
        )
    )
    files = manifest.select(path.alias("target"), F.inline(stems)).select(
        "stem", "target", "probe", F.lit(True).alias("is_file")
    )
    folders = manifest.select(paths.dir_name(path).alias("folder")).distinct()
    above = folders.select(
        F.explode(F.concat(F.array("folder"), paths.ancestors(F.col("folder")))).alias("stem")
    ).distinct()
    return files.unionByName(
        above.select(
            "stem", F.col("stem").alias("target"), F.lit(0).alias("probe"), F.lit(False).alias("is_file")
        )
    )


def _alias_places(bare: DataFrame, rules: DataFrame, at_most: int, rows_per_split: int) -> DataFrame:
    """`(_id, rank, stem, form)`: what the fitting rules make of module names.

    A name is looked up by its own prefixes, of the lengths that rules have, so it meets
    the rules with these prefixes and no others.
    """
    # One row for each length of a prefix, at most the longest pattern.
    lengths = sorted(r.n for r in rules.select(F.length("prefix").alias("n")).distinct().collect())
    everywhere = rules.where("repo is null").drop("repo")
    own = rules.where("repo is not null")
    spec = F.col("specifier")
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(spec))
    asked = bare.select(
        "_id", "repo", "specifier", "_root", F.explode(F.transform(fitting, lambda n: F.substring(spec, F.lit(1), n))).alias("prefix")
    )
    bound = at_most * max(1, len(lengths))

    def met(table: DataFrame, keys: list[str]) -> DataFrame:
        joined = salted_join(asked, table, keys, "inner", spread_by=["_id"], at_most=bound, rows_per_split=rows_per_split)
        fits = (
            spec.endswith(F.col("suffix")) & (F.length(spec) >= F.length("prefix") + F.length("suffix"))
        )
        found = joined.where(F.when(F.col("wild"), fits).otherwise(spec == F.col("prefix")))
        kept = F.length(spec) - F.length("prefix") - F.length("suffix")
        captured = F.substring(spec, F.length("prefix") + 1, kept)
        middle = F.when(F.col("target_wild"), captured).otherwise(F.lit(""))
        place = paths.resolve(F.col("_root"), F.concat("target_prefix", middle, "target_suffix"))
        return found.select("_id", "rank", place.alias("stem"), F.lit("module").alias("form"))

    return met(everywhere, ["prefix"]).unionByName(met(own, ["repo", "prefix"]))


def _places(lookups: DataFrame, use_base: bool) -> DataFrame:
    """Ranked places of lookups without alias rules, with the way each may be answered.

    `module` takes a file, an index or a code file; `base` a file, a folder or a code
    file; `asset` only what has this very path.
    """
    kind = F.col("kind")
    form = F.when(kind == RELATIVE, "module").when(kind == ASSET, "asset").otherwise("base")
    rank = F.when(kind == BARE, F.lit(_BASE_RANK)).otherwise(0).cast("bigint")
    known = lookups if use_base else lookups.where(kind != BARE)
    return known.select("_id", rank.alias("rank"), F.col("_place").alias("stem"), form.alias("form"))


def _answers_form() -> Column:
    """Whether an existing place may answer a name of this form."""
    form, probe = F.col("form"), F.col("probe")
    return (
        F.when(form == "module", F.col("is_file"))
        .when(form == "base", probe != 1)
        .otherwise(probe == 0)
    )


def resolve(
    refs: DataFrame,
    manifest: DataFrame,
    aliases: Sequence[AliasRule] | DataFrame = (),
    base_url: str = ".",
    use_base: bool = True,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Add `target`, `resolved` and `is_external` to references.

    `aliases` are rules for all repositories, or a table of rules (see `rule_rows`). An unresolved relative import keeps its joined path; an
    unresolved asset or module keeps its own text, and such a module is external.
    """
    base = F.when(F.col("kind") == BARE, F.lit("")).otherwise(paths.dir_name(F.col("abs_path")))
    edges, n_edges = materialise_counted(refs.withColumn("base", base), "references")
    # However often a module is imported, it is looked up once per folder or repository.
    # Stored, so that the numbers given here stay the same wherever they are read.
    root = paths.resolve(F.col("repo"), F.lit(base_url))
    start = F.when(F.col("kind") == BARE, root).otherwise(F.col("base"))
    lookups, n_lookups = materialise_counted(
        edges.select(*_LOOKUP)
        .distinct()
        .withColumns(
            {
                "_id": F.monotonically_increasing_id(),
                "_place": paths.from_folder(start, F.col("specifier")),
            }
        ),
        "lookups",
    )
    bare = lookups.where(F.col("kind") == BARE).withColumn("_root", root)
    rules = rule_rows(refs.sparkSession, aliases)
    places = _places(lookups, use_base).unionByName(_alias_places(bare, rules, n_lookups, rows_per_split))
    # A place is hot only if very many folders look it up; adaptive execution splits it.
    best = (
        places.join(existing_places(manifest), "stem")
        .where(_answers_form())
        .groupBy("_id")
        .agg(F.min_by("target", F.struct("rank", "probe")).alias("_best"))
    )
    # What stays unresolved keeps its joined path, or its own text.
    fallback = F.when(F.col("kind") == RELATIVE, F.col("_place")).otherwise(F.col("specifier"))
    answered = lookups.join(best, "_id", "left").select(
        *_LOOKUP,
        F.coalesce("_best", fallback).alias("target"),
        F.col("_best").isNotNull().alias("resolved"),
    )
    return salted_join(
        edges,
        answered,
        _LOOKUP,
        "left",
        spread_by=["abs_path", "pos"],
        at_most=n_edges,
        rows_per_split=rows_per_split,
    ).select(
        "repo",
        "path",
        "abs_path",
        "pos",
        "kind",
        "specifier",
        "target",
        "resolved",
        (~F.col("resolved") & (F.col("kind") == BARE)).alias("is_external"),
    )

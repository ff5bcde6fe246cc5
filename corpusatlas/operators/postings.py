"""An inverted index of file records: (kind, name) to files, and look-ups by intersection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.functions import markup, source

#: The parts of a record that postings name, with the field that holds a name.
KINDS = {"import": ("imports", None), "function": ("functions", "name"), "class": ("classes", "name"),
         "interface": ("interfaces", "name"), "tag": ("tags", "tag")}
#: Every record has one posting of this kind, so that files without names are found too.
FILE = "file"


@dataclass(frozen=True)
class Example:
    """What a record must have: any of the names of every part that is given."""

    repository: str | None = None
    file_name: str | None = None
    files: Sequence[str] = ()
    imports: Sequence[str] = ()
    functions: Sequence[str] = ()
    classes: Sequence[str] = ()
    interfaces: Sequence[str] = ()
    tags: Sequence[str] = ()

    def wanted(self) -> dict[str, Sequence[str]]:
        """Names by kind; a file is asked for by the names that every given part allows."""
        found = {kind: getattr(self, column) for kind, (column, _) in KINDS.items() if getattr(self, column)}
        files = set(self.files)
        if self.file_name is not None:
            files = {self.file_name} & files if self.files else {self.file_name}
        if self.files or self.file_name is not None:
            found[FILE] = sorted(files)
        return found


def _names(column: Column, field: str | None) -> Column:
    names = column if field is None else F.transform(column, lambda item: item[field])
    return F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull()))


def _posted(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def of_records(records: DataFrame) -> DataFrame:
    """`(kind, name, repository, fileName)`, each once for a record; one scan, no shuffle."""
    parts = [_posted(kind, _names(F.col(column), field)) for kind, (column, field) in KINDS.items()]
    every = F.concat(_posted(FILE, F.array("fileName")), *parts)
    return records.select("repository", "fileName", F.inline(every)).select("kind", "name", "repository", "fileName")


def in_order(rows: DataFrame) -> DataFrame:
    """Postings by range of kind and name. A very frequent name is many rows of several ranges."""
    return rows.repartitionByRange("kind", "name", "repository", "fileName").sortWithinPartitions("kind", "name", "repository")


def matching(rows: DataFrame, example: Example) -> DataFrame:
    """`(repository, fileName)` that have a posting of every kind asked for.

    Kinds, names and the repository reach the scan. A file counts a kind once, however many of
    the names it has; files are counted before they are shuffled.
    """
    wanted = example.wanted()
    if example.repository is not None:
        rows = rows.where(F.col("repository") == example.repository)
    if not wanted:
        return rows.where(F.col("kind") == FILE).select("repository", "fileName")
    hit = reduce(
        lambda a, b: a | b, ((F.col("kind") == kind) & F.col("name").isin(*names) for kind, names in sorted(wanted.items()))
    )
    met = rows.where(F.col("kind").isin(*sorted(wanted)) & hit)
    # A bit for each kind, so that kinds are counted without a set.
    bit = F.element_at(F.create_map(*(F.lit(v) for n, kind in enumerate(sorted(wanted)) for v in (kind, 1 << n))), F.col("kind"))
    counted = met.groupBy("repository", "fileName").agg(F.bit_or(bit).alias("kinds"))
    return counted.where(F.col("kinds") == (1 << len(wanted)) - 1).select("repository", "fileName")


#: How each kind but imports comes out of a text, and the extension it is read from.
_FROM_TEXT = {
    "function": (".ts", source.functions, "name"), "class": (".ts", source.classes, "name"),
    "interface": (".ts", source.interfaces, "name"), "tag": (".html", markup.tags, "tag"),
}


def of_files(files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Postings of these kinds from `(repo, abs_path, ext, content)`; only what is asked for is extracted.

    Imports are resolved names and come from edges (`of_edges`).
    """
    parts = []
    if FILE in kinds:
        parts.append(F.array(F.struct(F.lit(FILE).alias("kind"), F.col("abs_path").alias("name"))))
    for kind in kinds:
        if kind in _FROM_TEXT:
            ext, extract, field = _FROM_TEXT[kind]
            names = _names(F.when(F.col("ext") == ext, extract(F.col("content"))), field)
            parts.append(_posted(kind, names))
    if not parts:
        return files.limit(0).select(F.lit("").alias("kind"), F.lit("").alias("name"), F.col("repo").alias("repository"), F.col("abs_path").alias("fileName"))
    listed = files.where(F.col("ext").isin(".ts", ".html", ".json"))
    return listed.select(F.col("repo").alias("repository"), F.col("abs_path").alias("fileName"), F.inline(F.concat(*parts))).select(
        "kind", "name", "repository", "fileName"
    )


def of_edges(edges: DataFrame) -> DataFrame:
    """Postings of imports from resolved references."""
    return edges.select(
        F.lit("import").alias("kind"), F.col("target").alias("name"), F.col("repo").alias("repository"),
        F.col("abs_path").alias("fileName"),
    )

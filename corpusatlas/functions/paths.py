"""Path arithmetic on columns. Paths use `/`; nothing touches a disk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusatlas.functions.binding import bind

# An empty, `.` or `..` segment.
_NEEDS_FOLD = r"/(?:/|$|\.\.?(?:/|$))"


def base_name(path: Column) -> Column:
    """Last segment, trailing slashes ignored."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last segment; `.` for a bare name, `/` at the root."""
    trimmed = F.rtrim(path, F.lit("/"))
    kept = F.length(trimmed) - F.length(base_name(path))
    head = F.rtrim(F.substring(trimmed, F.lit(1), kept), F.lit("/"))
    root = F.when(path.startswith("/"), "/").otherwise(".")
    return F.when(head == "", root).otherwise(head)


def extension(path: Column) -> Column:
    """From the last dot of the last segment; empty for dotfiles; case kept."""
    name = base_name(path)
    tail = F.substring_index(name, ".", -1)
    # The place of the last dot, 0 without one.
    dot = F.length(name) - F.length(tail)
    return F.when((dot > 1) & (name != ".."), F.concat(F.lit("."), tail)).otherwise("")


def _folded(path: Column) -> Column:
    """Walk the segments: `.` and empty ones go, `..` takes the one before along."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def normalize(path: Column) -> Column:
    """Absolute path with `.`, `..` and empty segments folded away.

    Most paths need no fold, so the segment walk runs only for those that do.
    """
    return F.when(path.rlike(_NEEDS_FOLD), _folded(path)).otherwise(path)


def resolve(base: Column, path: Column) -> Column:
    """`path` against the folder `base`; an absolute `path` wins."""
    return normalize(
        F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    )


def from_folder(folder: Column, path: Column) -> Column:
    """As `resolve`, for a folder that is already normal.

    Leading `./` and `../` are settled with plain string functions, which is what
    nearly all imports need; the segment walk is left for what remains.
    """
    plain = F.when(path.startswith("./"), F.substring(path, F.lit(3), F.length(path))).otherwise(path)
    climbs = F.regexp_extract(plain, r"^(?:\.\./)+", 0)
    levels = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))
    left = F.greatest(levels + 1 - (F.length(climbs) / 3).cast("int"), F.lit(1))
    kept = F.call_function("substring_index", folder, F.lit("/"), left)
    below = F.substring(plain, F.length(climbs) + 1, F.length(plain))
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(kept, F.lit("/"), below))
    return bind(joined, normalize)


def ancestors(path: Column) -> Column:
    """Every folder above an absolute path, as an array (root excluded)."""
    return bind(
        F.split(path, "/"),
        lambda parts: F.when(
            F.size(parts) > 2,
            F.transform(
                F.sequence(F.lit(2), F.size(parts) - 1),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )

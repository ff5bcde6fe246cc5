"""Equi-joins that split measured hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.session import materialise_counted

ROWS_PER_SPLIT = 1_000_000
#: Hot keys up to this number travel to both sides by broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_024


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: str) -> Column:
    """Equality of all keys in which null equals null; `right` holds them with a prefix."""
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"{renamed}{k}"]) for k in keys]
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    at_most: int | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Join in which a key with many left rows is spread over several tasks.

    Every key with more than `rows_per_split` left rows gets one split per so many rows.
    Its left rows are dealt out by a hash of `spread_by`; the matching right rows are
    repeated once per split. All other keys join as usual, so the result is that of a
    plain join. Null keys match nothing, but in a left join their rows are dealt out too.
    The table of hot keys is counted: up to `broadcast_keys` it is broadcast, beyond that
    it is joined by shuffle. `left` is counted and then read twice, so it should be a
    table; `at_most` is a known bound on its rows. If all of it fits one split, no key can
    be hot and the plain join is used. `how` is inner, left or left_semi.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how must be inner, left or left_semi")
    rows = left.count() if at_most is None else at_most
    if rows <= rows_per_split:
        return left.join(right, list(keys), how)
    # At most rows / rows_per_split keys.
    hot, n_hot = materialise_counted(
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_split)
        .select(
            *(F.col(k).alias(f"_hot_{k}") for k in keys),
            F.ceil(F.col("_rows") / F.lit(rows_per_split)).cast("int").alias("_splits"),
        ),
        "hot-keys",
    )
    table = F.broadcast(hot) if n_hot <= broadcast_keys else hot
    named = [f"_hot_{k}" for k in keys]
    dealt = (
        left.join(table, null_safe(left, table, keys, "_hot_"), "left")
        .withColumn(
            "_split",
            F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_splits")), F.lit(0)).cast("int"),
        )
        .drop("_splits", *named)
    )
    repeated = (
        right.join(table, null_safe(right, table, keys, "_hot_"), "left")
        .withColumn(
            "_split", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))
        )
        .drop("_splits", *named)
    )
    return dealt.join(repeated, [*keys, "_split"], how).drop("_split")

"""Running values over ordered groups of any size.

A plain window puts a whole group into one task. Here rows are split by range over
(group, order), every slice is reduced to one row per group, and what the earlier
slices hold is carried into the later ones. No task sees more than one slice, even
when a single group holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.operators.skew import null_safe
from corpusatlas.session import materialise

_SLICE = "_slice"
ROWS_PER_TASK = 1_000_000
_REDUCE = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(
            carried.isNotNull() | own.isNotNull(),
            F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0)),
        )
    return F.greatest(carried, own) if kind == "max" else F.least(carried, own)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    totals: Sequence[str] = (),
    at_most: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add inclusive running values per group.

    `values` maps a new column to ("sum" | "max" | "min", input). For names in
    `totals` the value of the whole group is added as `<name>_total`. `order` must
    make rows unique within a group, or equal rows may fall into any order. `at_most`
    is a known bound on the rows of `df`: if they fit one task, a plain window does.
    """
    if at_most is not None and at_most <= rows_per_task:
        whole = Window.partitionBy(*group)
        here = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            *df.columns,
            *(_REDUCE[kind](column).over(here).alias(n) for n, (kind, column) in values.items()),
            *(
                _REDUCE[values[n][0]](values[n][1]).over(whole).alias(f"{n}_total")
                for n in totals
            ),
        )
    inputs = {name: f"_in_{name}" for name in values}
    # With a known size every slice holds about one task's rows, else as many as AQE packs.
    n_slices = [] if at_most is None else [-(-at_most // rows_per_task)]
    sliced = materialise(
        df.withColumns({inputs[name]: column for name, (_, column) in values.items()})
        .repartitionByRange(*n_slices, *group, *order)
        .withColumn(_SLICE, F.spark_partition_id()),
        "ordered",
    )
    # One row per group and slice: bounded by groups + slices, and by slices per group.
    per_slice = sliced.groupBy(*group, _SLICE).agg(
        *(_REDUCE[kind](inputs[name]).alias(f"_own_{name}") for name, (kind, _) in values.items())
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *group,
        _SLICE,
        *(
            _REDUCE[kind](f"_own_{name}").over(earlier).alias(f"_carried_{name}")
            for name, (kind, _) in values.items()
        ),
        *(
            _REDUCE[values[name][0]](f"_own_{name}").over(whole).alias(f"{name}_total")
            for name in totals
        ),
    )
    here = (
        Window.partitionBy(*group, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Null groups are groups too, so the join takes null for equal to null.
    named = carried.withColumnsRenamed({k: f"_of_{k}" for k in (*group, _SLICE)})
    joined = sliced.join(named, null_safe(sliced, named, [*group, _SLICE], "_of_"), "left")
    return joined.select(
        *(sliced[c] for c in df.columns),
        *(
            _combine(
                kind, F.col(f"_carried_{name}"), _REDUCE[kind](inputs[name]).over(here)
            ).alias(name)
            for name, (kind, _) in values.items()
        ),
        *(f"{name}_total" for name in totals),
    )


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, **bounds
) -> DataFrame:
    """Add a 1-based row number per group."""
    return running(df, group, order, {name: ("sum", F.lit(1).cast("bigint"))}, **bounds)

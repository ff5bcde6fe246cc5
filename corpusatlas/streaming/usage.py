"""Running usage telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.operators import telemetry


def usage_stream(events: DataFrame, delay: str, width: str = "1 day") -> DataFrame:
    """Token sums per run and window; a window closes `delay` after its end.

    State is one row of sums per open window and run. Events later than `delay` are not
    counted, so the caller has to say how late they may be; `running_totals` drops none.
    """
    return telemetry.usage_by_window(events.withWatermark("ts", delay), width)


def running_totals(events: DataFrame) -> DataFrame:
    """Token sums per run over everything seen so far, for output mode `update` or `complete`.

    There is no watermark: an event counts however late it comes. State is one row of sums
    per run.
    """
    ends = events.where(F.col("kind") == telemetry.MODEL_END)
    return ends.groupBy("run").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in telemetry.TOKENS),
        F.count(F.lit(1)).alias("n_ends"),
    )

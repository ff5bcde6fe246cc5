"""Usage telemetry: token totals, durations and log lines.

Input events are `(run, event_id, ts, kind, …)` with the kinds below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.operators.ordered import running

CHAIN_START, CHAIN_END = "chain_start", "chain_end"
MODEL_START, MODEL_END = "model_start", "model_end"
RETRIEVER_START, RETRIEVER_END = "retriever_start", "retriever_end"
TOKENS = ["completion_tokens", "prompt_tokens", "total_tokens"]


def log_line(ts: Column, level: Column, message: Column) -> Column:
    """`<timestamp> <level>: <message>` with milliseconds in UTC."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(stamp, F.lit(" "), level, F.lit(": "), message)


def parse_log_line(line: Column) -> dict[str, Column]:
    pattern = r"(?s)^(\S+) (\S+): (.*)$"
    names = ["timestamp", "level", "message"]
    return {name: F.regexp_extract(line, pattern, n) for n, name in enumerate(names, 1)}


def usage_totals(events: DataFrame) -> DataFrame:
    """Token sums per run over model ends; ends without usage count as nothing."""
    ended = F.col("kind") == MODEL_END
    return events.groupBy("run").agg(
        *(F.coalesce(F.sum(F.when(ended, F.col(c))), F.lit(0)).alias(c) for c in TOKENS)
    )


def _seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000)


def chain_durations(events: DataFrame, **bounds) -> DataFrame:
    """Seconds since the start in force, at every chain or model end.

    A chain start always sets the start; a model start only if there is none yet.
    So the start in force is the last chain start, else the first model start.
    """
    kind, ts = F.col("kind"), F.col("ts")
    # A run is in time order, so its last start so far is its latest.
    placed = running(
        events.where(kind.isin(CHAIN_START, MODEL_START, CHAIN_END, MODEL_END)).select(
            "run", "event_id", "ts", "kind"
        ),
        ["run"],
        ["ts", "event_id"],
        {
            "_chain": ("max", F.when(kind == CHAIN_START, ts)),
            "_model": ("min", F.when(kind == MODEL_START, ts)),
        },
        **bounds,
    )
    return placed.where(kind.isin(CHAIN_END, MODEL_END)).select(
        "run",
        "event_id",
        _seconds(F.coalesce("_chain", "_model"), ts).alias("duration_sec"),
    )


def retriever_durations(events: DataFrame, **bounds) -> DataFrame:
    """Seconds since the last retriever start, at every retriever end."""
    kind, ts = F.col("kind"), F.col("ts")
    placed = running(
        events.where(kind.isin(RETRIEVER_START, RETRIEVER_END)).select(
            "run", "event_id", "ts", "kind"
        ),
        ["run"],
        ["ts", "event_id"],
        {"_start": ("max", F.when(kind == RETRIEVER_START, ts))},
        **bounds,
    )
    return placed.where(kind == RETRIEVER_END).select(
        "run", "event_id", _seconds(F.col("_start"), ts).alias("duration_sec")
    )


def usage_by_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Token sums per run and window; the same plan for a table and for a stream."""
    return (
        events.where(F.col("kind") == MODEL_END)
        .groupBy(F.window("ts", width).alias("_w"), "run")
        .agg(
            *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS),
            F.count(F.lit(1)).alias("n_ends"),
        )
        .select(F.col("_w.start").alias("window_start"), "run", *TOKENS, "n_ends")
    )

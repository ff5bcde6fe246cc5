"""Session defaults and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "corpusatlas", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Call sites per column expression cost more than building the plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in `spark.checkpoint.dir`. Only a local session may fall
    back to a temporary folder, because executors elsewhere cannot read one.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusatlas-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it may go when the application ends."""
    return f"{scratch_root(spark)}/corpusatlas/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but is columnar: readers prune
    columns, and the planner sees the real size when it picks a join.
    """
    return materialise_counted(df, label)[0]


def materialise_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As `materialise`, with the rows written; retried tasks may be counted twice,
    so take the number as an upper bound."""
    return materialise_observed(df, label)[:2]


def materialise_observed(df: DataFrame, label: str, *more: Column) -> tuple[DataFrame, int, dict]:
    """As `materialise_counted`, with further named aggregates of the rows written."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows"), *more).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), written.get["rows"], written.get

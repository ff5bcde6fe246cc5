"""Upsert into a stored table that rewrites only what new rows touch.

Rows lie in buckets by a hash of their keys, one folder for each bucket. New rows are reduced to
the latest of each key, meet the stored rows of their own buckets only, and these buckets are
written again; the files of all others stay as they are. The buckets in force are named by the
manifest of a two-step publication, so a merge that dies changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusatlas.operators.enrich import upsert
from corpusatlas.session import materialise

#: Buckets of a new table; a bucket should fit a few tasks.
BUCKETS = 64
#: No column of a table may have this name.
_BUCKET = "merge_bucket"
_ENTRY = "step bigint, bucket int, place string"


@dataclass(frozen=True)
class MergedTable:
    """A table by key below a folder. The number of buckets is fixed when it is made."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    schema: StructType
    version: str = "batch_id"
    buckets: int = BUCKETS

    @classmethod
    def create(
        cls, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], version: str = "batch_id",
        buckets: int = BUCKETS,
    ) -> MergedTable:
        made = cls(spark, root.rstrip("/"), tuple(keys), schema, version, buckets)
        row = (schema.json(), json.dumps(list(keys)), version, buckets)
        spark.createDataFrame([row], "schema string, keys string, version string, buckets int").coalesce(1).write.json(
            f"{made.root}/settings"
        )
        return made

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> MergedTable:
        found = spark.read.json(f"{root.rstrip('/')}/settings").first()
        schema = StructType.fromJson(json.loads(found.schema))
        return cls(spark, root.rstrip("/"), tuple(json.loads(found["keys"])), schema, found.version, int(found.buckets))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def in_force(self) -> dict[int, tuple[int, str]]:
        """(step, folder) of every bucket that has rows: one row for each bucket at most.

        A step counts with the one entry file it wrote, so it counts whole or not at all.
        """
        log = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/steps")
        if not log.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(log):
            return {}
        entries = self.spark.read.schema(_ENTRY).json(f"{self.root}/steps")
        latest = entries.groupBy("bucket").agg(F.max(F.struct("step", "place")).alias("e"))
        return {r.bucket: (r.e.step, r.e.place) for r in latest.collect()}

    def _read(self, places: Sequence[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*places)

    def read(self) -> DataFrame:
        return self._read([place for _, place in self.in_force().values()])

    def merge(self, new: DataFrame) -> list[int]:
        """Take new rows in; the buckets that were rewritten. Running it again changes nothing."""
        force = self.in_force()
        # Versions of a key are reduced before they are shuffled; the table is read three times.
        latest = upsert(new.limit(0), new, self.keys, self.version).select(*self.schema.names)
        latest = materialise(latest.withColumn(_BUCKET, self._bucket()), "merge")
        touched = sorted(r[_BUCKET] for r in latest.select(_BUCKET).distinct().collect())
        if not touched:
            return []
        old = self._read([force[b][1] for b in touched if b in force])
        rows = upsert(old, latest.drop(_BUCKET), self.keys, self.version).select(*self.schema.names)
        step = 1 + max((s for s, _ in force.values()), default=-1)
        folder = f"{self.root}/data/step={step}-{uuid.uuid4().hex}"
        placed = rows.withColumn(_BUCKET, self._bucket())
        # Grouping by the keys leaves a bucket in all tasks; rebalancing brings it together and splits a large one.
        placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        entries = [(step, b, f"{folder}/{_BUCKET}={b}") for b in touched]
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(f"{self.root}/steps")
        return touched

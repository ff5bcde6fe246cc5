"""Tables that are published in two steps: their data, then a manifest row that names it.

Every attempt writes to a folder of its own, and readers take only the attempts that the
manifest names. A write that dies leaves files that nobody reads; a write that is repeated is
published once. A version stays what it was when a later one is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ENTRY = "version bigint, attempt string, schemas map<string,string>"


@dataclass(frozen=True)
class Published:
    """Versions of one or more tables below a folder."""

    spark: SparkSession
    root: str

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def manifest(self) -> DataFrame:
        """One row for each published version. Of two attempts that raced, the first by name counts."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._at("manifest"))
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], _ENTRY)
        rows = self.spark.read.schema(_ENTRY).json(self._at("manifest"))
        return rows.groupBy("version").agg(
            F.min("attempt").alias("attempt"), F.min_by("schemas", "attempt").alias("schemas")
        )

    def has(self, version: int) -> bool:
        return not self.manifest().where(F.col("version") == version).isEmpty()

    def latest(self) -> int | None:
        return self.manifest().select(F.max("version")).first()[0]

    def publish(
        self, tables: Mapping[str, DataFrame], version: int,
        partition_by: Mapping[str, Sequence[str]] | None = None,
    ) -> bool:
        """Write the tables, each with folders by its own columns, as this version; false if it was published before."""
        if self.has(version):
            return False
        attempt = uuid.uuid4().hex
        for name, table in tables.items():
            place = self._at(name, f"version={version}", f"attempt={attempt}")
            table.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(place)
        self._name(version, attempt, {name: table.schema.json() for name, table in tables.items()})
        return True

    def _name(self, version: int, attempt: str, schemas: Mapping[str, str]) -> None:
        """The second step: from here on readers see the version."""
        row = self.spark.createDataFrame([(version, attempt, dict(schemas))], _ENTRY)
        row.coalesce(1).write.mode("append").json(self._at("manifest"))

    def read(self, name: str, schema: str) -> DataFrame:
        """All published versions of a table, with `version`; folders of other attempts are pruned."""
        named = self.manifest().select("version", "attempt")
        if named.isEmpty():
            return self.spark.createDataFrame([], f"{schema}, version bigint")
        rows = self.spark.read.schema(f"{schema}, version bigint, attempt string").parquet(self._at(name))
        return rows.join(named, ["version", "attempt"], "left_semi").drop("attempt")

    def current(self, name: str) -> DataFrame:
        """The latest version of a table, read from its own folder."""
        found = self.manifest().orderBy(F.desc("version")).first()
        if found is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        place = self._at(name, f"version={found.version}", f"attempt={found.attempt}")
        return self.spark.read.schema(StructType.fromJson(json.loads(found.schemas[name]))).parquet(place)


def publish_once(
    tables: Mapping[str, DataFrame], root: str, if_exists: str, partition_by: Mapping[str, Sequence[str]] | None = None
) -> int:
    """Publish the next version, unless one exists and `if_exists` says skip or stop; the version in force.

    A rebuild that dies leaves the version before it in force.
    """
    store = Published(next(iter(tables.values())).sparkSession, root)
    before = store.latest()
    if before is not None and if_exists == "stop":
        raise FileExistsError(f"{root} has a published version")
    if before is not None and if_exists == "skip":
        return before
    if if_exists not in ("stop", "skip", "rebuild"):
        raise ValueError("if_exists must be stop, skip or rebuild")
    version = 0 if before is None else before + 1
    store.publish(tables, version, partition_by)
    return version

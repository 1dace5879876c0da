"""Tables whose rows get gapless keys as they are inserted, with updates by key, for several writers at once.

An insert writes its rows once, numbered from 1: partitions count their rows, and each row's number is its place in the
partition behind the rows of those before, so no task sees them all.  The version file gives the insert its base; a row's key is base and
number together.  A writer that loses a version to another only claims the next one, with the base that the other left, and
writes no row again.  Updates are rows (key, changed columns) of their own; the last version that names a key and column counts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import Conflict, Versions


@dataclass
class KeyedTable:
    """The table of a folder; schema: of its rows, without the key."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "id"

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self.versions = Versions(self.spark, f"{self.path}/versions")

    def _publish(self, part: dict, tries: int) -> dict:
        """The part as published: with the base that its version gives it."""
        for left in range(tries - 1, -1, -1):
            last = self.versions.last() or {"number": 0, "rows": 0, "parts": []}
            placed = part | {"base": last["rows"], "number": last["number"] + 1}
            rows = last["rows"] + (part["count"] if part["kind"] == "insert" else 0)
            try:
                self.versions.claim(placed["number"], json.dumps({"number": placed["number"], "rows": rows, "parts": [*last["parts"], placed]}))
                return placed
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def _of(self, part: dict) -> DataFrame:
        if part["kind"] == "update":
            return self.spark.read.parquet(f"{self.path}/parts/{part['name']}").withColumn("_version", F.lit(part["number"]))
        rows = self.spark.read.schema(f"_nth long, {self.schema}").parquet(f"{self.path}/parts/{part['name']}")
        return rows.select((F.col("_nth") + part["base"]).alias(self.key), *rows.columns[1:])

    def insert(self, rows: DataFrame, tries: int = 20) -> DataFrame:
        """Inserts rows and returns them with their keys, which follow those there are without a gap."""
        name = uuid.uuid4().hex
        staged = f"{self.path}/staged/{name}"
        rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
        before = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        count = before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        nth = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
        numbered = held.withColumn("_in", nth).join(before.select("_part", "before"), "_part")
        columns = self.spark.createDataFrame([], self.schema).columns
        numbered.select((F.col("_in") + F.col("before")).cast("long").alias("_nth"), *[F.col(f"`{c}`") for c in columns]).write.parquet(f"{self.path}/parts/{name}")
        self.versions.fs().delete(self.versions._jvm.org.apache.hadoop.fs.Path(staged), True)
        return self._of(self._publish({"kind": "insert", "name": name, "count": count}, tries))

    def update(self, changes: DataFrame, tries: int = 20) -> int:
        """Sets the columns of changes (key and some columns; one row per key) in the rows of these keys; returns the version.  A null sets null."""
        name = uuid.uuid4().hex
        changes.write.parquet(f"{self.path}/parts/{name}")
        return self._publish({"kind": "update", "name": name, "count": 0, "columns": [c for c in changes.columns if c != self.key]}, tries)["number"]

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last by default, with what updates set."""
        version = self.versions.read(number) if number else self.versions.last()
        parts = version["parts"] if version else []
        inserts = [self._of(p) for p in parts if p["kind"] == "insert"]
        rows = reduce(DataFrame.unionByName, inserts) if inserts else self.spark.createDataFrame([], f"{self.key} long, {self.schema}")
        updates = [p for p in parts if p["kind"] == "update"]
        for c in dict.fromkeys(c for p in updates for c in p["columns"]):
            said = reduce(DataFrame.unionByName, [self._of(p).select(self.key, F.struct(c).alias("_said"), "_version") for p in updates if c in p["columns"]])
            last = said.groupBy(self.key).agg(F.max_by("_said", "_version").alias("_said"))
            rows = rows.join(last, self.key, "left").withColumn(c, F.when(F.col("_said").isNull(), F.col(c)).otherwise(F.col(f"_said.{c}"))).drop("_said")
        return rows

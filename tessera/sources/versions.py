"""Versions of a table: small JSON files, each of which one writer only can put in its place."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Versions:
    """Numbered JSON files in a folder of a file system that all writers and readers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def hadoop_path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def fs(self):
        return self.hadoop_path("").getFileSystem(self._conf)

    def names(self, folder: str = "") -> list[str]:
        fs, where = self.fs(), self.hadoop_path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def numbers(self) -> list[int]:
        return [int(n[1:-5]) for n in self.names() if n.startswith("v") and n.endswith(".json")]

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/v{number:08d}.json", wholetext=True).first()[0])

    def last(self) -> dict | None:
        found = self.numbers()
        return self.read(found[-1]) if found else None

    def claim(self, number: int, content: str) -> None:
        """Publishes a version, or raises Conflict if its number is taken: a draft is renamed to a name that mustn't exist."""
        fs, target = self.fs(), self.hadoop_path(f"v{number:08d}.json")
        fs.mkdirs(self.hadoop_path(""))
        draft = self.hadoop_path(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(content.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, never)
        except Exception as e:
            fs.delete(draft, False)
            if "exist" in str(e).lower():
                raise Conflict(f"version {number} is taken") from e
            raise

    def drop(self, number: int) -> None:
        self.fs().delete(self.hadoop_path(f"v{number:08d}.json"), False)

"""Tables whose content is named by a manifest: a write is seen whole or not at all.

A table is a folder with data folders and numbered manifests. A manifest says which data folders each part of the table has;
a write puts its rows into a new data folder and then the next manifest into its place, by a rename that fails if another
writer was quicker. Readers take the last manifest. A write that dies leaves the version before; what it had written belongs
to no version, and vacuum() deletes it. A folder without manifests is an empty table, an unreadable manifest an error.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class CorruptTable(ValueError):
    """A manifest that can't be read."""


class WriteConflict(RuntimeError):
    """Another writer has put its version into the place of this one's."""


class Folder:
    """Names and small texts in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._hadoop = self._jvm.org.apache.hadoop.fs
        at = self._path("")
        self._fs = at.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(at.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """The names in a folder; none if it doesn't exist."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Puts a text into its place at once; False if there is one already."""
        aside = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            self._context.rename(self._path(aside), self._path(name), self._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Py4JJavaError as e:
            self.delete(aside)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Version(NamedTuple):
    number: int
    parts: dict[str, list[str]]
    notes: dict


class Versions:
    """The versions of one table under a folder."""

    KEEP = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def current(self) -> Version:
        numbers = self._numbers()
        return self.version(max(numbers)) if numbers else Version(0, {}, {})

    def version(self, number: int) -> Version:
        name = f"_versions/{number:012d}.json"
        try:
            held = json.loads(self.folder.text(name))
            return Version(number, {str(k): [str(x) for x in v] for k, v in held["parts"].items()}, dict(held["notes"]))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CorruptTable(f"{self.folder.root}/{name}") from e

    def read(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        paths = [f"{self.folder.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, *parts: str) -> str:
        """Writes rows into a new data folder, partitioned if asked to, and returns its name; no version has it yet."""
        name = f"data/{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*parts) if parts else rows.write
        writer.parquet(f"{self.folder.root}/{name}")
        return name

    def commit(self, base: Version, parts: dict[str, list[str]], notes: dict | None = None) -> Version:
        """Makes `parts` the version after base."""
        new = Version(base.number + 1, {k: v for k, v in parts.items() if v}, base.notes if notes is None else notes)
        if not self.folder.create(f"_versions/{new.number:012d}.json", json.dumps({"parts": new.parts, "notes": new.notes})):
            raise WriteConflict(f"{self.folder.root}: version {new.number} is another writer's")
        return new

    def vacuum(self, keep: int = KEEP) -> None:
        """Deletes all but the last `keep` versions, and data that none of these has. No write may be under way."""
        numbers = sorted(self._numbers())
        used = {f.split("/")[1] for n in numbers[-keep:] for folders in self.version(n).parts.values() for f in folders}
        for n in numbers[:-keep]:
            self.folder.delete(f"_versions/{n:012d}.json")
        for name in self.folder.names("data"):
            if name not in used:
                self.folder.delete(f"data/{name}")

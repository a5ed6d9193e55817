"""A small commit log on any file system that Spark writes to: one JSON text per version, written once.

A version is data folders plus state. Folders are written first, the version last; readers only see what the newest
version names. So a crash at any step leaves the version before, and running a batch again is harmless.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> dict[str, Any]:
        """The state of a version, of the newest by default; an empty dict before the first."""
        known = self.versions()
        if not known:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/_versions/{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, state: dict[str, Any]) -> int:
        """Writes the next version under another name and renames it; fails if another writer was first."""
        version = (self.versions() or [0])[-1] + 1
        target, draft = self._path(f"{self.path}/_versions/{version:012d}.json"), self._path(f"{self.path}/_versions/.{version:012d}.tmp")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {version} of {self.path} exists already")
        return version

    def delete(self, relative: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{relative}"), True)

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{relative}"))

    def size(self, relative: str) -> int:
        """Bytes below a folder."""
        return self._fs.getContentSummary(self._path(f"{self.path}/{relative}")).getLength()

    def folders(self, relative: str) -> list[str]:
        folder = self._path(f"{self.path}/{relative}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

"""Small files through Hadoop's file systems, and versions that are published exclusively."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer took the name first."""


class Folder:
    """A folder of any file system that Spark can open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, name: str) -> list[str]:
        """Names of the entries of a subfolder; none if it doesn't exist."""
        path = self._path(self.at(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def ages(self, name: str) -> dict[str, float]:
        """When each entry of a subfolder was changed, in seconds."""
        path = self._path(self.at(name))
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(path)} if self._fs.exists(path) else {}

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def publish(self, name: str, value: dict) -> None:
        """Write a JSON file whole or not at all; CommitConflict if the name is taken.

        The file is written under another name, then renamed, which HDFS refuses if the name
        exists; a local file is linked. An object store whose rename is not exclusive needs a
        commit service of its own.
        """
        temp, final = self._path(self.at(f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.tmp")), self._path(self.at(name))
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(temp.toUri().getPath(), final.toUri().getPath())
                    taken = False
                except FileExistsError:
                    taken = True
            else:
                taken = self._fs.exists(final) or not self._fs.rename(temp, final)
        finally:
            self._fs.delete(temp, False)
        if taken:
            raise CommitConflict(f"{name} exists")


def new_run() -> str:
    return f"run-{uuid.uuid4().hex[:12]}"

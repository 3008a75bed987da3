"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

Arrivals become small runs that are never changed. Runs of similar size form a tier;
when a tier has ``fanout`` runs they are merged into files of about the target size.
Every change is one new manifest version, published under its final name by one step that
fails if another writer was first: a hard link on local disks, a rename on stores whose
rename is atomic and refuses an existing target (HDFS). Object stores without such a
rename need a commit service of their own. Old versions stay readable until ``vacuum``,
which only runs when called. Only DataFrame reads and writes touch the data.

Rows are stored as they come: nulls, empty texts, ties and repeated rows all stay, in any
columns, as long as every arrival has the same ones.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch


class CommitConflict(RuntimeError):
    """Another writer committed this version."""


class ShardStore:
    """A table of immutable runs under ``root``."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.smallest = target_bytes, fanout, smallest
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifest

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "runs": []}
        version = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, runs: list[dict], schema: str) -> dict:
        new = {"version": base["version"] + 1, "schema": schema, "runs": runs}
        temp = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        try:
            published = self._publish(temp, self._path(f"{self.root}/manifest/v{new['version']:08d}.json"))
        finally:
            self._fs.delete(temp, False)
        if not published:
            raise CommitConflict(f"version {new['version']} exists")
        return new

    def _publish(self, temp, final) -> bool:
        """Give the written manifest its final name; False if the name is taken."""
        if self._fs.getScheme() == "file":
            try:
                os.link(temp.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not self._fs.exists(final) and self._fs.rename(temp, final)

    # runs

    def _run(self, folder: str) -> dict | None:
        path = self._path(folder)
        files = [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        files = [(f, n) for f, n in files if f.endswith(".parquet")]
        if not files:
            return None
        return {"run": folder.removeprefix(self.root + "/"), "files": [f for f, _ in files], "bytes": sum(n for _, n in files)}

    def tier(self, run: dict) -> int:
        """Runs whose sizes differ by less than the fanout share a tier; the smallest share tier 0."""
        return max(0, math.floor(math.log(max(run["bytes"], 1) / self.smallest, self.fanout)))

    def append(self, df: DataFrame) -> dict:
        """Write one arrival as a run and commit it; an arrival without rows is a version with no new run."""
        folder = f"{self.root}/data/run-{uuid.uuid4().hex[:12]}"
        self._writer(df).parquet(folder)
        return self._register(folder, df.schema.json())

    def _writer(self, df: DataFrame):
        """Row groups no larger than a target file, so that a later merge can cut a file into such."""
        return df.write.option("parquet.block.size", min(self.target_bytes, 128 << 20))

    def _register(self, folder: str, schema: str) -> dict:
        base, run = self.manifest(), self._run(folder)
        if base["schema"] not in (None, schema):
            raise ValueError("the arrival has other columns than the table")
        return self._commit(base, base["runs"] + ([run] if run else []), schema)

    def append_arrivals(self, df: DataFrame, arrival: str, compact: bool = True, keep_versions: int | None = None) -> dict:
        """Write many arrivals in one job, then commit them one after another in their order.

        ``arrival`` is a SQL expression; null is an arrival of its own. ``keep_versions``:
        delete what older versions alone name after each compaction.
        """
        folder = f"{self.root}/data/arrivals-{uuid.uuid4().hex[:12]}"
        name = "arrival"
        while name.lower() in (c.lower() for c in df.columns):
            name += "_"
        self._writer(df.withColumn(name, F.expr(arrival))).partitionBy(name).parquet(folder)
        found = [s.getPath().toString() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        for one in sorted(found, key=lambda f: (len(f), f)):
            self._register(one, df.schema.json())
            if compact and self.compact() and keep_versions:
                self.vacuum(keep_versions)
        return self.manifest()

    def compact(self) -> int:
        """Merge tiers that are full, smallest first, until none is; the number of merges."""
        for merges in itertools.count():
            base = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in base["runs"]:
                tiers.setdefault(self.tier(run), []).append(run)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not full:
                return merges
            merged = tiers[full[0]][: self.fanout]
            old = {r["run"] for r in merged}
            folder = f"{self.root}/data/run-{uuid.uuid4().hex[:12]}"
            files = max(1, round(sum(r["bytes"] for r in merged) / self.target_bytes))
            with self._splits_of(self.target_bytes):
                self._writer(self._frame(base["schema"], merged).coalesce(files)).parquet(folder)
            self._commit(base, [r for r in base["runs"] if r["run"] not in old] + [self._run(folder)], base["schema"])

    @contextmanager
    def _splits_of(self, size: int):
        """Read files in splits of at most ``size`` bytes: a merge can join splits, but not cut them."""
        name = "spark.sql.files.maxPartitionBytes"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(size))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def vacuum(self, keep_versions: int = 1, orphans_after_s: float = 86_400) -> None:
        """Delete runs and versions before the last ``keep_versions`` that those do not name.

        Folders that no version names, left by writers that failed, go once they are
        ``orphans_after_s`` old.
        """
        known = self.versions()
        kept = known[-keep_versions:]
        live = {r["run"] for v in kept for r in self.manifest(v)["runs"]}
        pending = {r["run"] for v in known[:-keep_versions] for r in self.manifest(v)["runs"]} - live
        for run in pending:
            self._fs.delete(self._path(f"{self.root}/{run}"), True)
        named = {r["run"] for v in known for r in self.manifest(v)["runs"]}
        for status in self._fs.listStatus(self._path(f"{self.root}/data")) if self._fs.exists(self._path(f"{self.root}/data")) else []:
            inside = f"data/{status.getPath().getName()}"
            if time.time() - status.getModificationTime() / 1000 > orphans_after_s and not any(n == inside or n.startswith(inside + "/") for n in named):
                self._fs.delete(status.getPath(), True)
        for v in known[:-keep_versions]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)

    def _frame(self, schema: str, runs: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        files = [f for r in runs for f in r["files"]]
        return self.spark.read.schema(kind).parquet(*files) if files else self.spark.sql("SELECT 1 WHERE false").selectExpr(*[f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in kind])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        base = self.manifest(version)
        if base["schema"] is None:
            raise ValueError("the table has no version yet")
        return self._frame(base["schema"], base["runs"])


ARRIVALS = 24


def op6_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append ``documents`` as 24 arrivals, compact, and read the table back through its manifest."""
    store = ShardStore(spark, Scratch(spark, "shards").path, target_bytes=32 << 20)
    store.append_arrivals(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"pmod(xxhash64(doc_id), {ARRIVALS})", keep_versions=1)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


OP6_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"

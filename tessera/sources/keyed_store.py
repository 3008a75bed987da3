"""A stored table with one row a key: upserts, deletes, point reads, versions and replays.

Keys fall into hash buckets. A batch is written as a run with files in the buckets it touches,
then a new version is published whose manifest names, for each bucket, the runs that make
it up, oldest first. Reading merges the runs of a bucket by key; buckets of one run are
read as they are. Compaction rewrites the buckets that have gathered many runs, and no
other. The manifest's size follows buckets and writers, not rows: between compactions a
bucket has at most ``most_runs`` runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.files import CommitConflict, Folder, new_run

BUCKETS = 64
MOST_RUNS = 4
TRIES = 20

_BUCKET, _VERSION, _GONE = "__bucket", "__version", "__gone"


class KeyedStore:
    """Rows of ``schema`` (DDL or a type) under ``root``, one for each value of ``keys``.

    ``bucket_by``: the keys that choose the bucket, all by default; a point read needs these.
    ``fill``: a null of a later row leaves the stored value as it is; otherwise a row
    replaces the stored one. Null keys are keys like others. Rows of a batch that share a key
    are merged in the order of the columns named ``order``, which needn't be stored.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, keys: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS, fill: bool = False, most_runs: int = MOST_RUNS):
        self.spark, self.keys, self.bucket_by, self.buckets, self.fill, self.most_runs = spark, keys, bucket_by or keys, buckets, fill, most_runs
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        taken = {_BUCKET, _VERSION, _GONE} & {f.name for f in self.schema}
        if taken:
            raise ValueError(f"columns with names of the store's own: {', '.join(sorted(taken))}")
        if not set(self.bucket_by) <= set(keys):
            raise ValueError("bucket_by must be among the keys")
        self.rest = [f.name for f in self.schema if f.name not in keys]
        self.files = Folder(spark, root)

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names("versions") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version, by default the last, is made of."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "layout": [self.bucket_by, self.buckets], "runs": {}, "writers": {}}
        found = self.files.read(f"versions/v{version:010d}.json")
        if found["layout"] != [self.bucket_by, self.buckets]:
            raise ValueError(f"the table is laid out by {found['layout']}")
        return found

    def _commit(self, base: dict, runs: dict[str, list[str]], writers: dict[str, int]) -> dict:
        new = {"version": base["version"] + 1, "layout": base["layout"], "runs": {b: r for b, r in runs.items() if r}, "writers": writers}
        self.files.publish(f"versions/v{new['version']:010d}.json", new)
        return new

    # writes

    def upsert(self, rows: DataFrame, order: list[str], writer: str = "", batch: int | None = None, gone: str | None = None) -> dict:
        """Merge a batch; the version that holds it.

        ``batch``: a number that rises with each batch of ``writer``; one that the table has
        seen is left out, so a batch that is replayed after a failure changes nothing.
        ``gone`` names a column that is true for rows that delete their key (not with ``fill``).
        """
        if gone and self.fill:
            raise ValueError("a table that fills takes deletes by delete()")
        flag = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
        return self._apply(self._merged_batch(rows.withColumn(_GONE, flag), order), writer, batch)

    def delete(self, keys: DataFrame, writer: str = "", batch: int | None = None) -> dict:
        """Remove the rows of these keys; unknown keys do no harm."""
        gone = keys.select(*self.keys).distinct().select(*self.keys, *[F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.rest])
        return self._apply(gone.withColumn(_GONE, F.lit(True)), writer, batch)

    def sink(self, order: list[str], writer: str, gone: str | None = None) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: each micro-batch is merged exactly once."""

        def write(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, order, writer, batch, gone)

        return write

    def _merged_batch(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row a key, by partial aggregates."""
        at = F.struct(*order)
        if not self.fill:
            last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(_GONE, *self.rest), at).alias("__last"))
            return last.select(*self.keys, *[F.col(f"__last.{c}").alias(c) for c in (*self.rest, _GONE)])
        filled = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in self.rest]
        return rows.groupBy(*self.keys).agg(*filled, F.lit(False).alias(_GONE))

    def _apply(self, rows: DataFrame, writer: str, batch: int | None) -> dict:
        bucket = F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], _GONE).withColumn(_BUCKET, bucket)
        for _ in range(TRIES):
            base = self.manifest()
            if batch is not None and base["writers"].get(writer, -1) >= batch:
                return base
            run = self._write(rows, base["version"] + 1)
            runs = {b: list(r) for b, r in base["runs"].items()}
            for b in self._buckets_of(run):
                runs.setdefault(b, []).append(run)
            try:
                new = self._commit(base, runs, base["writers"] | ({writer: batch} if batch is not None else {}))
            except CommitConflict:  # the rows' version is another one now
                self.files.delete(f"data/{run}")
                continue
            self.compact()
            return new
        raise CommitConflict(f"{TRIES} other writers were faster")

    def _write(self, rows: DataFrame, version: int) -> str:
        """One file a bucket, sorted by key, unless a bucket is so large that adaptive execution splits it."""
        run = new_run()
        dealt = rows.withColumn(_VERSION, F.lit(version).cast("long")).hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, *self.keys)
        dealt.write.partitionBy(_BUCKET).parquet(self.files.at(f"data/{run}"))
        return run

    def _buckets_of(self, run: str) -> list[str]:
        return [n.partition("=")[2] for n in self.files.names(f"data/{run}") if n.startswith(f"{_BUCKET}=")]

    def compact(self, more_than: int | None = None) -> list[int]:
        """Rewrite the buckets of more than ``more_than`` runs (``most_runs`` by default); which they were."""
        limit = self.most_runs if more_than is None else more_than
        base = self.manifest()
        full = {b: r for b, r in base["runs"].items() if len(r) > limit}
        if not full:
            return []
        rows = self._rows({b: full[b] for b in full}).withColumn(_BUCKET, F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int"))
        run = self._write(rows.withColumn(_GONE, F.lit(False)), base["version"])
        made = set(self._buckets_of(run))
        for _ in range(TRIES):
            now = self.manifest()
            if any(now["runs"].get(b, [])[: len(r)] != r for b, r in full.items()):  # compacted by another writer
                break
            runs = now["runs"] | {b: ([run] if b in made else []) + now["runs"][b][len(r) :] for b, r in full.items()}
            try:
                self._commit(now, runs, now["writers"])
                return sorted(map(int, full))
            except CommitConflict:
                continue
        self.files.delete(f"data/{run}")
        return []

    def vacuum(self, keep_versions: int = 1, orphans_after_s: float = 86_400) -> None:
        """Delete older versions and the runs that only they name; runs of failed writers go when they are old."""
        known = self.versions()
        live = {r for v in known[-keep_versions:] for runs in self.manifest(v)["runs"].values() for r in runs}
        named = {r for v in known for runs in self.manifest(v)["runs"].values() for r in runs}
        for run, changed in self.files.ages("data").items():
            if run not in live and (run in named or time.time() - changed > orphans_after_s):
                self.files.delete(f"data/{run}")
        for v in known[:-keep_versions]:
            self.files.delete(f"versions/v{v:010d}.json")

    # reads

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the last."""
        return self._rows(self.manifest(version)["runs"])

    def get(self, **values) -> DataFrame:
        """Rows whose bucket keys have these values; only their bucket's files are opened, by key range."""
        if set(values) != set(self.bucket_by):
            raise ValueError(f"a point read needs {', '.join(self.bucket_by)}")
        literal = {c: F.lit(values[c]).cast(self.schema[c].dataType) for c in self.bucket_by}
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*literal.values()), F.lit(self.buckets))).first()[0]
        runs = self.manifest()["runs"].get(str(bucket), [])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in literal.items()])
        return self._rows({str(bucket): runs} if runs else {}, same)

    def _rows(self, runs: dict[str, list[str]], where=None) -> DataFrame:
        columns = [f.name for f in self.schema]
        kind = StructType(list(self.schema.fields)).add(_GONE, "boolean").add(_VERSION, "long")

        def scan(of: list[tuple[str, str]]) -> DataFrame:
            if not of:
                return self.spark.createDataFrame([], kind)
            found = self.spark.read.schema(kind).parquet(*[self.files.at(f"data/{r}/{_BUCKET}={b}") for b, r in of])
            return found if where is None else found.where(where)

        single = scan([(b, r[0]) for b, r in runs.items() if len(r) == 1]).where(~F.col(_GONE)).select(*columns)
        many = [(b, x) for b, r in runs.items() if len(r) > 1 for x in r]
        return single.unionByName(self._merged(scan(many)).select(*columns)) if many else single

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The last state of each key; a delete ends what was there before it."""
        if not self.fill:
            last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(_GONE, *self.rest), _VERSION).alias("__last")).where("NOT __last.__gone")
            return last.select(*self.keys, *[F.col(f"__last.{c}").alias(c) for c in self.rest])
        at, gone = F.col(_VERSION), F.col(_GONE)
        value = [F.max_by(F.struct(at.alias("v"), F.col(c).alias("x")), F.when(F.col(c).isNotNull(), at)).alias(f"__{i}") for i, c in enumerate(self.rest)]
        merged = rows.groupBy(*self.keys).agg(F.coalesce(F.max(F.when(gone, at)), F.lit(-1)).alias("__ended"), F.max(F.when(~gone, at)).alias("__written"), *value).where("__written > __ended")
        return merged.select(*self.keys, *[F.when(F.col(f"__{i}.v") > F.col("__ended"), F.col(f"__{i}.x")).alias(c) for i, c in enumerate(self.rest)])

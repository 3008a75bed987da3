"""Session factory and the shared scratch area that every job writes through."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_RUN = re.compile(r"[a-z][a-z-]*-[0-9a-f]{12}")


def build_session(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("tessera.scratch", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("tessera.scratch", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each context; their own path may not have it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    home = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix="tessera-zip-"), "tessera_package.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    sc.addPyFile(where)
    sc._tessera_shipped = True


class Scratch:
    """Intermediate tables of one run, written to the shared folder.

    A written table cuts lineage: an executor lost later costs no recomputation
    of the steps before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self._n += 1
        where = f"{self.path}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(where, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._tessera_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in tables:
            remove_path(self.spark, df._tessera_path)


def sweep_scratch(spark: SparkSession, older_than_s: float = 86_400.0) -> list[str]:
    """Delete intermediate tables that earlier runs left in the shared folder; which they were.

    Results are read from these tables, so call it when no result of the last ``older_than_s`` seconds is in use.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and _RUN.fullmatch(s.getPath().getName()) and time.time() - s.getModificationTime() / 1000 > older_than_s]
    return [p.getName() for p in old if fs.delete(p, True)]


def remove_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

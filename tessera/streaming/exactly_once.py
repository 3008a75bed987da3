"""An append-only table that holds each batch of a stream once, and the dropping of redelivered events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.files import CommitConflict, Folder, new_run
from tessera.streaming.events import SINK_ROWS, bulks


def once_each(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """A stream without redelivered events: of equal ``keys`` the first that comes stays.

    State is kept for as long as the watermark, ``late`` behind the latest event time; events
    older than that are dropped, first or not, so ``late`` must cover how late an event may come.
    """
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class AppendLedger:
    """Rows of ``schema`` (DDL) under ``root``; a batch is there once its ledger entry is published.

    Files are written first and named by the entry, which can be published only once for a
    writer and batch number. A batch that fails before leaves files that nothing names; one that
    is replayed after its entry stands writes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.schema, self.files = spark, StructType.fromDDL(schema), Folder(spark, root)

    def _entry(self, writer: str, batch: int) -> str:
        if not writer or "/" in writer:
            raise ValueError("a writer needs a name without '/'")
        return f"ledger/{writer}/{batch:012d}.json"

    def holds(self, writer: str, batch: int) -> bool:
        folder, _, name = self._entry(writer, batch).rpartition("/")
        return name in self.files.names(folder)

    def append(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Add a batch; False if it was there."""
        if self.holds(writer, batch):
            return False
        run = new_run()
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(self.files.at(f"data/{run}"))
        try:
            self.files.publish(self._entry(writer, batch), {"run": run, "writer": writer, "batch": batch})
        except CommitConflict:  # another attempt at this batch was faster
            self.files.delete(f"data/{run}")
            return False
        return True

    def read(self) -> DataFrame:
        """The rows of all batches; their entries are listed and read, one small file a batch."""
        runs = [self.files.read(f"ledger/{w}/{n}")["run"] for w in self.files.names("ledger") for n in self.files.names(f"ledger/{w}") if n.endswith(".json")]
        return self.spark.read.schema(self.schema).parquet(*[self.files.at(f"data/{r}") for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``; no batch is written twice."""

        def write(rows: DataFrame, batch: int) -> None:
            self.append(rows, writer, batch)

        return write

    def bulk_sink(self, writer: str, order: list[str], rows: int = SINK_ROWS) -> Callable[[DataFrame, int], None]:
        """As ``sink``, with the number of each row's bulk of at most ``rows`` rows in the column ``bulk``."""

        def write(batch_rows: DataFrame, batch: int) -> None:
            if not self.holds(writer, batch):
                self.append(bulks(batch_rows, order, rows), writer, batch)

        return write

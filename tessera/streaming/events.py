"""Progress events: folds that agree in batch and as a stream, and the batching sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.session import Scratch

EVENT_SCHEMA = "site_id string, seq long, type string, url string, status string, message string, processed_chunks int, total_chunks int, current_phase string"
#: Workflow node -> status of its URL; a gate that rejects gives 'failed'.
NODE_STATUS = {"searcher": "queued", "scraper": "extracting", "bouncer": "evaluating", "vector_storage": "completed"}
TERMINAL = {"Complete": "complete", "Error": "error", "Cancelled": "cancelled"}


def node_status(node: Column, relevant: Column) -> Column:
    out = F.when((node == "bouncer") & ~F.coalesce(relevant, F.lit(False)), "failed")
    for name, status in NODE_STATUS.items():
        out = out.when(node == name, status)
    return out


def latest_status(events: DataFrame, keys: list[str], status: str = "status", seq: str = "seq") -> DataFrame:
    """The last status of each key by arrival number; works on a stream as well."""
    return events.groupBy(*keys).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq))


def progress(events: DataFrame, key: str) -> DataFrame:
    """Per key: last phase, rounded percentage and state; a complete build is at 100."""
    at = F.col("seq")
    known = F.when(F.col("total_chunks") > 0, at)
    last = events.groupBy(key).agg(
        F.max_by("current_phase", at).alias("phase"),
        F.max_by(F.when(F.col("total_chunks") > 0, F.col("processed_chunks") * 100.0 / F.col("total_chunks")), known).alias("pct"),
        F.count("*").alias("n_events"),
    )
    state = F.lit("running")
    for phase, name in TERMINAL.items():
        state = F.when(F.col("phase") == phase, name).otherwise(state)
    pct = F.when(F.col("phase") == "Complete", 100).otherwise(F.coalesce(F.floor(F.col("pct") + 0.5), F.lit(0))).cast("int")
    return last.select(key, "phase", pct.alias("percent"), state.alias("state"), "n_events")


def fold_queue(events: DataFrame) -> DataFrame:
    """The queue of each site: items of its last 'queue' event, each with its later status updates."""
    start = events.where("type = 'queue'").groupBy("site_id").agg(F.max("seq").alias("from_seq"))
    items = events.where("type = 'queue'").join(start, "site_id").where("seq = from_seq").select("site_id", "url", F.lit("queued").alias("first"))
    updates = events.where("type = 'queue_update'").join(start, "site_id").where("seq > from_seq")
    last = updates.groupBy("site_id", "url").agg(F.max_by("status", "seq").alias("status"))
    return items.join(last, ["site_id", "url"], "left").select("site_id", "url", F.coalesce("status", "first").alias("status"))


def relay(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 5) -> DataStreamWriter:
    """A writer that hands micro-batches to ``sink`` every few seconds, or once over what is there.

    The sink gets each batch with its number; upserts by key keep replays harmless.
    """
    out = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)


def watermarked_counts(events: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by type and window of event time, late ones dropped after the watermark."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, window), "type").agg(F.count("*").alias("n"))


#: The types of events.
EVENT_TYPES = ("log", "queue", "queue_update", "status", "new_chunk", "large_file_pending", "graph_progress")
SINK_ROWS = 500


def site_state(events: DataFrame) -> DataFrame:
    """One row for each site from events of all types (site_id, seq, type, message); works on a stream as well.

    Log lines, new chunks, pending large files and queue events are counted, the last status
    and the number of the last progress event stand; other types are counted as unknown.
    """
    kind = F.col("type")
    n = lambda *names: F.count_if(kind.isin(*names))
    return events.groupBy("site_id").agg(
        n("log").alias("logs"), F.max_by("message", F.when(kind == "status", F.col("seq"))).alias("status"), n("new_chunk").alias("chunks"), n("large_file_pending").alias("pending"),
        F.max(F.when(kind == "graph_progress", F.col("seq"))).alias("progress_seq"), n("queue", "queue_update").alias("queue_events"), F.count_if(~kind.isin(*EVENT_TYPES)).alias("unknown"),
    )


def bulks(batch: DataFrame, order: list[str], rows: int = SINK_ROWS) -> DataFrame:
    """``batch`` with the number of the bulk that each row is written in: ``rows`` rows each, in order.

    Rows are ranked within ranges of the order and ranges are counted, so no task holds the batch.
    """
    ranged = batch.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    ranged = Scratch(batch.sparkSession, "bulks").table(ranged, "rows")
    before = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # one row a task
    before = before.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(before, "__part").withColumn("bulk", F.floor((F.col("before") + F.col("__at")) / rows)).drop("__part", "__at", "before")


def batching_sink(write: Callable[[DataFrame, int], None], order: list[str], rows: int = SINK_ROWS) -> Callable[[DataFrame, int], None]:
    """A sink for ``relay`` that writes each micro-batch in bulks of at most ``rows`` rows.

    ``relay``'s trigger sets the time after which what has come is written, and a stream's end
    writes the rest. ``write`` takes (rows of one bulk, bulk's number in the batch).
    """

    def sink(batch: DataFrame, _: int) -> None:
        cut = Scratch(batch.sparkSession, "sink").table(bulks(batch, order, rows), "bulks")
        for number in range((cut.agg(F.max("bulk")).first()[0] if cut.head(1) else -1) + 1):
            write(cut.where(F.col("bulk") == number).drop("bulk"), number)

    return sink

"""Each site's view of its events as a stream keeps it: an appended log, a queue that is replaced, statuses.

The state lives in Spark's state store, keyed by site, so a stream that stops goes on from
its checkpoint. Nothing depends on the order in which rows arrive: a queue stands if its
number is the largest so far, and a status if its number is larger than those of the queue and
of the item's earlier statuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.keyed_store import KeyedStore

CHANGES = "site_id string, kind string, item string, seq long, value string, gone boolean"
VIEW = "site_id string, kind string, item string, seq long, value string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SiteFold(StatefulProcessor):
    """Folds a site's events (seq, type, url, status, message) and gives what changed.

    'log' appends its message; the rows of type 'queue' with the largest number are the queue;
    'queue_update' sets an item's status; 'status' sets the site's. Other types are passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "seq long, message string")
        self.items = handle.getMapState("items", "url string", "seq long")
        self.statuses = handle.getMapState("statuses", "url string", "seq long, status string")
        self.head = handle.getValueState("head", "queue_seq long, status_seq long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.head.get() if self.head.exists() else None
        queue_seq, status_seq, status = known if known else (-1, -1, None)
        site, touched, moved = key[0], set(), False
        for pdf in rows:
            lines = pdf[pdf["type"] == "log"]
            if len(lines):
                self.log.appendList([(int(s), m) for s, m in zip(lines["seq"], lines["message"])])
                yield pd.DataFrame({"site_id": site, "kind": "log", "item": lines["seq"].astype(str), "seq": lines["seq"], "value": lines["message"], "gone": False})
            said = pdf[pdf["type"] == "status"]
            if len(said) and (last := said.loc[said["seq"].idxmax()])["seq"] > status_seq:
                status_seq, status, moved = int(last["seq"]), last["message"], True
            listed = pdf[pdf["type"] == "queue"]
            if len(listed) and int(listed["seq"].max()) >= queue_seq:
                now = int(listed["seq"].max())
                if now > queue_seq:
                    touched |= {url for (url,), _ in self.items.iterator()}
                    queue_seq = now
                    self.items.clear()
                    for (url,), (seq, _) in list(self.statuses.iterator()):
                        if seq <= now:
                            self.statuses.removeKey((url,))
                for url in listed.loc[listed["seq"] == now, "url"].dropna().unique():
                    self.items.updateValue((url,), (now,))
                    touched.add(url)
            updates = pdf[(pdf["type"] == "queue_update") & (pdf["seq"] > queue_seq) & pdf["url"].notna()]
            for url, some in updates.groupby("url"):
                last = some.loc[some["seq"].idxmax()]
                held = self.statuses.getValue((url,)) if self.statuses.containsKey((url,)) else None
                if held is None or held[0] < last["seq"]:
                    self.statuses.updateValue((url,), (int(last["seq"]), last["status"]))
                    touched.add(url)
        self.head.update((queue_seq, status_seq, status))
        out = []
        for url in sorted(touched):
            inside = self.items.containsKey((url,))
            held = self.statuses.getValue((url,)) if inside and self.statuses.containsKey((url,)) else None
            out.append((site, "queue", url, held[0] if held else queue_seq, held[1] if held else "queued", not inside))
        if moved:
            out.append((site, "status", "", status_seq, status, False))
        if out:
            yield pd.DataFrame(out, columns=["site_id", "kind", "item", "seq", "value", "gone"])

    def close(self) -> None:
        pass


def site_changes(events: DataFrame) -> DataFrame:
    """Changes (CHANGES) of the sites' views from a stream of events (site_id, seq, type, url, status, message)."""
    wanted = events.select("site_id", "seq", "type", "url", "status", "message")
    return wanted.groupBy("site_id").transformWithStateInPandas(statefulProcessor=SiteFold(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def run_site_views(events: DataFrame, store: KeyedStore, checkpoint: str, writer: str = "views") -> None:
    """Fold what a stream of events has by now into ``store`` (VIEW by site_id, kind, item), each batch once.

    Stopped and started again with the same checkpoint and store, it goes on where it was.
    """
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)  # state of several kinds needs it; read when the stream starts
    try:
        sink = store.sink(["seq", "gone"], writer, gone="gone")
        site_changes(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def view_store(spark, root: str, buckets: int = 16) -> KeyedStore:
    """A store for ``run_site_views``; all that a site shows is in one bucket."""
    return KeyedStore(spark, root, VIEW, ["site_id", "kind", "item"], bucket_by=["site_id"], buckets=buckets)


def views_of(events: DataFrame) -> DataFrame:
    """The views (VIEW) of a finished set of events: what the stream must arrive at."""
    start = events.where("type = 'queue'").groupBy("site_id").agg(F.max("seq").alias("from_seq"))
    items = events.where("type = 'queue' AND url IS NOT NULL").join(start, "site_id").where("seq = from_seq").select("site_id", "url", "from_seq").distinct()
    last = events.where("type = 'queue_update'").groupBy("site_id", "url").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("at"))
    newer = F.coalesce(F.col("at") > F.col("from_seq"), F.lit(False))
    queue = items.join(last, ["site_id", "url"], "left").select("site_id", F.lit("queue").alias("kind"), F.col("url").alias("item"), F.when(newer, F.col("at")).otherwise(F.col("from_seq")).alias("seq"), F.when(newer, F.col("status")).otherwise("queued").alias("value"))
    logs = events.where("type = 'log'").select("site_id", F.lit("log"), F.col("seq").cast("string"), "seq", "message")
    status = events.where("type = 'status'").groupBy("site_id").agg(F.max("seq").alias("seq"), F.max_by("message", "seq").alias("value")).select("site_id", F.lit("status"), F.lit(""), "seq", "value")
    return queue.unionAll(logs).unionAll(status)

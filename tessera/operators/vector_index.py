"""Nearest neighbours of many queries through an inverted file of vector lists.

Centroids are fitted on a bounded sample; every row is then filed in the list of its nearest
centroid, with its angle from it. A search reads the nearest lists of each query. With a
number of probes it stops there. Without one it goes on, to the lists that the triangle
inequality doesn't rule out given the k-th angle found so far, and the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import SLACK, angles, block_counts, block_of, every, unit
from tessera.session import Scratch

SAMPLE_ROWS = 50_000
BLOCK_ROWS = 4096
FIRST_PROBES = 4


def fit_centroids(rows: DataFrame, vector: str, lists: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most ``lists`` unit centroids by spherical k-means over at most ``sample_rows`` rows, drawn by a hash.

    The sample decides how well a search prunes, not what the index holds.
    """
    sound = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    drawn = sound.orderBy(F.xxhash64("v")).limit(sample_rows).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, lists), maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(drawn)
    return unit(model.clusterCenters())


class VectorIndex:
    """Rows (key, vector) filed by centroid in a Parquet table partitioned by list."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, key_kind: str):
        self.spark, self.path, self.centroids, self.key_kind = spark, path, centroids, key_kind
        self.rows = spark.read.schema(f"key {key_kind}, v array<double>, angle double, list int").parquet(path)
        self.radius = self.rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))

    @classmethod
    def build(cls, rows: DataFrame, key: str, vector: str, centroids: np.ndarray, path: str) -> VectorIndex:
        """File every row with a vector of the centroids' length that isn't zero; rows of equal keys are filed each."""
        kind, held = rows.schema[key].dataType.simpleString(), rows.sparkSession.sparkContext.broadcast(centroids)
        size = centroids.shape[1]

        def file(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                v = unit(pdf["v"].to_numpy())
                near = angles(v, held.value)
                home = near.argmin(1)
                keep = (v != 0).any(1)
                yield pd.DataFrame({"key": pdf["key"], "v": list(v), "angle": near[np.arange(len(v)), home], "list": home.astype(np.int32)})[keep]

        sound = rows.where(F.col(vector).isNotNull()).where(F.size(vector) == size).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
        filed = sound.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).mapInPandas(file, f"key {kind}, v array<double>, angle double, list int")
        filed.hint("rebalance", "list").write.partitionBy("list").parquet(path)
        return cls(rows.sparkSession, path, centroids, kind)

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query, neighbour, rank, distance): the k nearest rows of each query, itself included, by cosine distance, ties by key.

        ``probes``: read so many nearest lists of each query, for results that may miss some;
        without it the result is exact. Queries without a vector of the index's length, and zero vectors, have no neighbours;
        the key of a query names it, so queries of equal keys are searched once.
        """
        scratch = Scratch(self.spark, "search")
        q_kind, held = queries.schema[key].dataType.simpleString(), self.spark.sparkContext.broadcast(self.centroids)
        size = self.centroids.shape[1]
        sound = queries.where(F.col(vector).isNotNull()).where(F.size(vector) == size).select(F.col(key).alias("query"), F.transform(vector, lambda x: x.cast("double")).alias("qv"))
        sound = sound.where(F.exists("qv", lambda x: x != 0) & ~F.exists("qv", lambda x: x.isNull() | F.isnan(x)))
        sound = scratch.table(sound.dropDuplicates(["query"]), "queries")
        first = min(probes or FIRST_PROBES, len(self.centroids))

        def probe(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                near = angles(unit(pdf["qv"].to_numpy()), held.value)
                order = np.argsort(near, axis=1, kind="stable")
                n = len(self_lists := np.arange(near.shape[1]))
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(self_lists, order.shape), axis=1)
                yield pd.DataFrame({"query": pdf["query"].repeat(n).to_numpy(), "list": np.tile(self_lists, len(pdf)).astype(np.int32), "near": near.ravel(), "turn": rank.ravel().astype(np.int32)})

        # a row for each query and list, but only of the lists that are read or tested against their radius
        ways = sound.select("query", "qv").mapInPandas(probe, f"query {q_kind}, list int, near double, turn int")
        best = self._top(self._met(sound, ways.where(F.col("turn") < first).select("query", "list"), k, scratch), k)
        if probes is None:
            best = scratch.table(best, "first")
            worst = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
            bound = F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), 1 - F.col("far")))).otherwise(F.lit(np.pi))
            rest = ways.where(F.col("turn") >= first).join(worst.select("query", bound.alias("bound")), "query", "left").join(self.radius.select("list", "radius"), "list")
            rest = rest.where(F.col("near") - F.col("radius") <= F.coalesce("bound", F.lit(np.pi)) + SLACK).select("query", "list")
            more = self._met(sound, rest, k, scratch)
            best = self._top(best.select("query", "neighbour", "distance").unionByName(more), k)
        return best

    def _met(self, queries: DataFrame, wanted: DataFrame, k: int, scratch: Scratch) -> DataFrame:
        """(query, neighbour, distance): the k nearest of each query in each block of the lists it is to meet."""
        asked = scratch.table(wanted.join(queries, "query"), "asked")
        counts = block_counts(self.rows, ["list"], "rb", BLOCK_ROWS).join(block_counts(asked, ["list"], "qb", BLOCK_ROWS), "list")
        counts = scratch.table(counts, "blocks")
        rows = self.rows.join(counts, "list").withColumn("i", block_of(F.col("rb"), F.col("key"), F.col("v"))).select("list", "i", every(F.col("qb")).alias("j"), "key", "v")
        asked = asked.join(counts, "list").withColumn("j", block_of(F.col("qb"), F.col("query"))).select("list", every(F.col("rb")).alias("i"), "j", "query", "qv")

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
            left = left.sort_values("key", kind="stable")
            names = left["key"].to_numpy()
            far = 1.0 - unit(right["qv"].to_numpy()) @ np.stack(left["v"].to_numpy()).T
            order = np.argsort(far, axis=1, kind="stable")[:, :k]
            return pd.DataFrame({"query": right["query"].repeat(order.shape[1]).to_numpy(), "neighbour": names[order.ravel()], "distance": np.take_along_axis(far, order, 1).ravel()})

        kind = f"query {dict(asked.dtypes)['query']}, neighbour {self.key_kind}, distance double"
        return rows.groupBy("list", "i", "j").cogroup(asked.groupBy("list", "i", "j")).applyInPandas(nearest, kind)

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        """The k nearest of what each query has met: at most k a block that it was compared with."""
        ranked = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("near"))
        return ranked.select("query", F.posexplode("near").alias("at", "x")).select("query", "x.neighbour", (F.col("at") + 1).alias("rank"), "x.distance")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (query, neighbour) that were found."""
    pairs = truth.select("query", "neighbour").distinct()
    n = pairs.count()
    return pairs.join(found.select("query", "neighbour"), ["query", "neighbour"], "left_semi").count() / n if n else 1.0


def probes_for(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.95, most_queries: int = 200) -> int:
    """The fewest probes, doubling from 1, whose recall on at most ``most_queries`` queries (drawn by a hash) is at least ``least``."""
    some = queries.orderBy(F.xxhash64(key), key).limit(most_queries)
    truth = Scratch(index.spark, "truth").table(index.search(some, key, vector, k), "neighbours")
    probes = 1
    while probes < len(index.centroids) and recall(index.search(some, key, vector, k, probes), truth) < least:
        probes *= 2
    return min(probes, len(index.centroids))

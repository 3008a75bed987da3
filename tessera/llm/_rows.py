"""Names of document rows, to carry a verdict back to the texts.

A row is named by its id and the hash of its text; rows that agree in both are copies,
which every verdict treats alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(2**63)
KEYS = ("__id", "__text")
BROADCAST_ROWS = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the names of its rows."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__text", F.xxhash64("text"))


def row_keys(verdicts: DataFrame, *more: str) -> DataFrame:
    """Names of rows given as (doc_id, text_key), with more columns."""
    return verdicts.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), F.col("text_key").alias("__text"))


def side(keys: DataFrame) -> DataFrame:
    """The keys' side of a join with texts: broadcast up to BROADCAST_ROWS rows, shuffled beyond."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys.hint("merge")

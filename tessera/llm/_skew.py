"""Joins whose hot keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 400
SALTS = 32


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, a written table with one row for each key.

    ``count`` names the column of ``small`` that says how many rows of ``big`` have the key;
    it is dropped. Keys that hold over 1 / SHARE of these rows are at most SHARE, so their rows are
    joined by broadcast, wherever they are; all other rows are shuffled by key.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = small.where(F.col(count) * SHARE > total).drop(count)
    rest = small.where(F.col(count) * SHARE <= total).drop(count)
    found = big.join(F.broadcast(hot), keys)
    return found.unionByName(big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def join_salted(big: DataFrame, small: DataFrame, keys: list[str], row: str, counts: DataFrame) -> DataFrame:
    """Inner join of ``big`` with ``small``, which may have many rows for a key.

    ``counts`` (keys and ``n``, a written table) says how many rows of ``big`` have each key.
    Rows of hot keys are dealt into SALTS lanes by the column ``row``, and those of
    ``small`` are copied to every lane; all other rows are shuffled by key.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * SHARE > total).select(*keys))  # at most SHARE rows
    lanes = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = big.join(hot, keys, "left_semi").withColumn("__lane", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    copied = small.join(hot, keys, "left_semi").withColumn("__lane", lanes)
    rest = big.join(hot, keys, "left_anti").join(small.join(hot, keys, "left_anti"), keys)
    return dealt.join(copied, [*keys, "__lane"]).drop("__lane").unionByName(rest)

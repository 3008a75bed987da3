"""Exact histogram of encoded lengths, and the suffix sums that answer every context limit."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._text import tidy
from tessera.llm._tokens import count_column, vocabulary_path
from tessera.session import Scratch

BLOCK_LENGTHS = 256


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encoded length of every document, end id included; null text has the end id alone."""
    path = tokenizer or vocabulary_path()

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(count_column(batch.column(0), path))], names=["n_tokens"])

    return docs.select("text").mapInArrow(tidy(count, tokens=True), "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each encoded length with suffix sums over longer ones.

    ``docs_ge`` and ``tokens_ge`` cover documents of at least this length;
    ``truncated_total`` is the corpus total when every document is cut at this length.
    Sums run inside blocks of 256 lengths and over block totals, so no task holds more
    than a block or one row a block. Repeated rows and equal lengths are counted each;
    null and empty texts have length 1. An empty input gives no row.
    """
    hist = token_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    hist = Scratch(docs.sparkSession, "lengths").table(hist, "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK_LENGTHS))
    sums = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    total = hist.agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("total"))
    out = hist.join(sums, "block").crossJoin(F.broadcast(total))  # one row
    docs_ge = F.sum("n_docs").over(inside) + F.col("d_after")
    tokens_ge = F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("t_after")
    return out.select("n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"), (F.col("total") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_total"))


def context_report(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents cut, tokens kept and lost, from the suffix sums of the next longer length.

    Suffix sums fall as lengths rise, so those of the next longer length are the largest
    beyond the limit. An empty histogram gives zeros.
    """
    limits = [int(x) for x in limits]
    beyond = lambda name, x: F.coalesce(F.max(F.when(F.col("n_tokens") > x, F.col(name))), F.lit(0).cast("long"))
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"), beyond("docs_ge", x).alias("docs_cut"), beyond("tokens_ge", x).alias("beyond")) for x in limits]
    whole = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(name) for c, name in (("docs_ge", "docs"), ("tokens_ge", "tokens"))]
    found = hist.agg(*whole, F.array(*rows).alias("rows")).select("docs", "tokens", F.explode("rows").alias("r"))
    lost = F.col("r.beyond") - F.col("r.docs_cut") * F.col("r.context_limit")
    return found.select("r.context_limit", "docs", "tokens", "r.docs_cut", lost.alias("tokens_lost"), (F.col("tokens") - lost).alias("tokens_kept"))


def length_quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length such that at least this share of documents is no longer, from the suffix sums."""
    docs = hist.agg(F.max("docs_ge")).first()[0] or 0
    upto = docs - F.col("docs_ge") + F.col("n_docs")
    rows = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(upto >= math.ceil(x * docs), F.col("n_tokens"))).alias("n_tokens")) for x in shares]
    return hist.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.share", "r.n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram with suffix sums over ``documents``."""
    return length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))

"""Stages of the corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``; other columns of ``docs``, whatever their names, are left out.
Rows with a null id or a null text pass through every stage as rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._rows import KEYS, keyed, row_keys, side
from tessera.llm.decontaminate import find_contamination
from tessera.llm.jaccard_join import jaccard_components
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.packing import pack_documents
from tessera.llm.toxicity import ToxicityModel
from tessera.session import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts stay; of repeated rows and equal texts all stay or all go.
    """
    model = ToxicityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return model.apply(docs.select(*COLUMNS)).where("__predicted = 0").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of line runs; one that has no word left goes.

    A text that had no word before stays as it is, null ones too; of equal rows the first
    written keeps its lines. ``n_chars`` follows the text where lines went, and stays else.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    blank = (F.col("n_removed") > 0) & (F.length(F.translate("text", " \t\n\x0b\f\r", "")) == 0)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~F.coalesce(blank, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one of smallest id.

    Null ids come after all others; of rows equal in id and text one stays. Texts without
    words, null ones too, are duplicates of nothing and all stay.
    """
    found = Scratch(spark, "components").table(jaccard_components(docs.select("doc_id", "text")), "components")
    stay = keyed(docs.select(*COLUMNS)).join(side(row_keys(found.where("NOT first")).distinct()), list(KEYS), "left_anti")
    twice = found.where("first AND n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    twice = side(row_keys(twice))
    once = stay.join(twice, list(KEYS), "left_anti")
    copies = stay.join(twice, list(KEYS), "left_semi").dropDuplicates(list(KEYS))
    return once.unionByName(copies).select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts stay; an empty benchmark, or one without words, removes nothing.
    """
    found = find_contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    found = Scratch(spark, "contaminated").table(row_keys(found.where("contaminated")).distinct(), "rows")
    return keyed(docs.select(*COLUMNS)).join(side(found), list(KEYS), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, as ``pack_documents`` gives them; null text is empty."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs

"""Readers and writers: tables, objects by format, and external services behind functions.

Language models, embedding models, search and fetching are functions that the caller
passes in; deterministic stand-ins keep every plan runnable without a network.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package

SITES = "id string, tenant_id string, name string, description string, ontology struct<entities:array<string>,relationships:array<struct<source:string,type:string,target:string>>>, graph_status string, created_at timestamp"
TENANTS = "id string, auth_id string, name string, created_at timestamp"
DATA_SOURCES = "id string, site_id string, source_type string, name string, config map<string,string>, extraction_schema string, cadence_cron string, status string, last_run_at timestamp, created_at timestamp"
CHUNKS = "id string, data_source_id string, title string, raw_text string, embedding array<float>, metadata struct<source_url:string,chunk_index:int,storage_object:string>, processed_at timestamp"
PENDING = "id string, site_id string, url string, estimated_size int, status string, created_at timestamp"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ranges of a numeric key."""
    bounds = {"partitionColumn": key, "lowerBound": lower, "upperBound": upper, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **bounds, **options).load()


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all objects below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


_PARAGRAPH = {"docx": "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "pptx": "{http://schemas.openxmlformats.org/drawingml/2006/main}"}


def office_text(content: bytes, kind: str) -> str:
    """Paragraphs of a docx, or shape texts of a pptx, joined by a space."""
    space = _PARAGRAPH[kind]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if kind == "docx":
            parts = ["word/document.xml"]
        else:
            parts = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        texts = ["".join(t.text or "" for t in p.iter(f"{space}t")) for part in parts for p in ElementTree.fromstring(z.read(part)).iter(f"{space}p")]
    return " ".join(t for t in texts if t)


def sheet_text(content: bytes, kind: str) -> str:
    """A spreadsheet rendered as text; xlsx needs a reader that pandas finds installed."""
    frame = pd.read_csv(io.BytesIO(content)) if kind == "csv" else pd.read_excel(io.BytesIO(content))
    return frame.to_string()


def pdf_text(content: bytes) -> str:
    """Pages joined by a space, by whichever PDF reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF needs pypdf") from missing
    return " ".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def read_text(found: DataFrame) -> DataFrame:
    """(path, kind, text, error) of objects by their extension; a file that can't be read has its error."""
    from tessera.functions.text import html_to_text, url_kind

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                text, error = None, None
                try:
                    if kind in _PARAGRAPH:
                        text = office_text(content, kind)
                    elif kind == "pdf":
                        text = pdf_text(content)
                    elif kind == "spreadsheet":
                        text = sheet_text(content, "csv" if path.lower().endswith(".csv") else "xlsx")
                    else:
                        text = bytes(content).decode("utf-8", "replace")
                except Exception as failed:  # one bad file doesn't stop the others
                    error = f"{type(failed).__name__}: {failed}"
                rows.append((path, kind, text, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])

    out = found.select("path", url_kind(F.col("path")).alias("kind"), "content").mapInPandas(extract, "path string, kind string, text string, error string")
    return out.withColumn("text", F.when(F.col("kind") == "html", html_to_text(F.col("text"))).otherwise(F.col("text")))


def apply_service(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int | None = None) -> DataFrame:
    """Call an external service for each batch of rows; ``workers`` bounds how many calls run at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield call(pdf)

    return (df.repartition(workers) if workers else df).mapInPandas(run, schema)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Deterministic stand-in for an embedding model: signed word counts in ``size`` buckets, unit length."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    spots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("at"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    zero = F.array_repeat(F.lit(0.0), size)
    raw = F.aggregate(spots, zero, lambda acc, s: F.transform(acc, lambda x, i: x + F.when(i == s["at"], s["v"]).otherwise(0.0)))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    scaled = lambda v: F.when(square(v) > 0, F.transform(v, lambda x: (x / F.sqrt(square(v))).cast("float"))).otherwise(v.cast("array<float>"))
    return F.get(F.transform(F.array(raw), scaled), F.lit(0))  # the counts are made once, not for each component


def stub_extractor(text: Column) -> Column:
    """Deterministic stand-in for the extraction model: capitalised words related to the next one, as JSON."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\p{Lu}\p{Ll}+)\b"), 1))
    entities = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("Term").alias("type"), F.lit("").alias("description")))
    pairs = F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.struct(F.get(names, i - 1).alias("source"), F.get(names, i).alias("target"), F.lit("NEAR").alias("type"), F.lit("").alias("exact_quote"))))
    return F.to_json(F.struct(entities.alias("entities"), F.coalesce(pairs, F.array().cast("array<struct<source:string,target:string,type:string,exact_quote:string>>")).alias("relationships")))


def stub_verdict(name: Column, kind: Column) -> Column:
    """Deterministic stand-in for the prune verdict: generic kinds of vertex are condemned."""
    return F.lower(kind).isin("term", "concept", "unknown")


def queued_site(sites: DataFrame) -> DataFrame:
    """One site that waits for its graph, the oldest."""
    return sites.where("graph_status = 'queued'").orderBy("created_at", "id").limit(1)

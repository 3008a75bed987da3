"""Benchmark decontamination by winnowed word fingerprints.

Of every ``W`` neighbouring ``K``-word hashes of a text the smallest is kept, so any
shared span of K + W - 1 = 10 words has a fingerprint in common. Fingerprints of
documents and benchmark items are joined, each hit is extended word by word to both
sides, and spans of at least 10 words count. An item of fewer than 10 words is one
window of its own length and joins on the hash of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._dense import SCHEMA, Bloom, dense_rows, merge_dense
from tessera.llm._skew import join_salted
from tessera.llm._text import ALNUM, Words, as_long, blocks, tidy
from tessera.session import Scratch

WINDOW = 10
K = 6
W = WINDOW - K + 1
SIDE = WINDOW - K

_MARK = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
_MARKS = "array<struct<fp:long,size:int,pos:long,left:array<long>,right:array<long>>>"


def winnow(grams: np.ndarray, bounds: np.ndarray, w: int) -> np.ndarray:
    """Places of the window minima (the rightmost on ties) among the hashes of each row."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams[:n].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : n + j], out=low)
    at = np.zeros(n, np.int64)
    for j in range(w):
        at[grams[j : n + j] == low] = j
    at += np.arange(n)
    inside = np.arange(n) + w <= np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = at[inside]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


class _Marks:
    """Fingerprints of the rows of a block."""

    def __init__(self, words: Words, sizes: list[int]):
        self.words = words
        grams, bounds, first = words.grams(K, short=False)
        at = winnow(grams, bounds, W)
        fps, pos, kinds = [grams[at]], [first[at]], [np.full(len(at), WINDOW, np.int32)]
        for size in sizes:
            grams, _, first = words.grams(size, short=False)
            fps.append(grams)
            pos.append(first)
            kinds.append(np.full(len(grams), size, np.int32))
        self.fp, self.pos, self.kind = np.concatenate(fps), np.concatenate(pos), np.concatenate(kinds)

    def pick(self, keep: np.ndarray) -> dict[int, list[dict]]:
        """The kept fingerprints with the words around them, by row."""
        words, out = self.words, {}
        wh = as_long(words.hash)
        rows = np.searchsorted(words.bounds, self.pos[keep], "right") - 1
        for i, row in zip(keep.tolist(), rows.tolist()):
            pos, lo, hi = int(self.pos[i]), int(words.bounds[row]), int(words.bounds[row + 1])
            mark = {"fp": int(as_long(self.fp[i : i + 1])[0]), "size": int(self.kind[i]), "pos": pos - lo, "left": [], "right": []}
            if mark["size"] == WINDOW:
                mark["left"] = wh[max(lo, pos - SIDE) : pos][::-1].tolist()
                mark["right"] = wh[pos + K : min(hi, pos + K + SIDE)].tolist()
            out.setdefault(row, []).append(mark)
        return out


def _benchmark_marks(benchmark: DataFrame) -> DataFrame:
    def mark(batches):
        for batch in batches:
            names, ids, marks = batch.column(0), [], []
            for lo, data, offs in blocks(batch.column(1)):
                words = Words(data, offs, ALNUM, True)
                one = _Marks(words, list(range(1, WINDOW)))
                row = np.searchsorted(words.bounds, one.pos, "right") - 1
                keep = np.flatnonzero((one.kind == WINDOW) | (words.counts[row] == one.kind))
                for r, found in one.pick(keep).items():
                    ids.append(names[lo + r].as_py())
                    marks.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(marks, pa.list_(_MARK))], names=["item_id", "marks"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(tidy(mark), f"item_id string, marks {_MARKS}")
    return rows.select("item_id", F.explode("marks").alias("m")).select("item_id", "m.*")


def _same_words(a: str, b: str) -> Column:
    """How many leading entries of two word arrays agree."""
    out = F.lit(0)
    for i in reversed(range(SIDE)):
        out = F.when(F.get(F.col(a), F.lit(i)) == F.get(F.col(b), F.lit(i)), out + 1).otherwise(F.lit(0))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, log_bloom_bits: int = 24) -> DataFrame:
    """Words of each document inside occurrences of benchmark windows, and the items they come from.

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key), a row for each
    row of ``docs``. Null and empty texts have no words and no hit; items without words
    never occur; items with equal ids count once; without benchmark rows nothing is hit.
    Other columns are ignored. The Bloom filter of the benchmark's fingerprints has a
    fixed size; a hit of it only lets a fingerprint into the join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.table(_benchmark_marks(benchmark), "items")
    sizes = sorted(r["size"] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())  # at most 9
    log_bits = log_bloom_bits

    def fill(batches):
        own = Bloom.empty(log_bits)
        for pdf in batches:
            own.add(pdf["fp"].to_numpy().view(np.uint64))
        yield dense_rows(own.bits, TaskContext.get().partitionId())

    bits = merge_dense(items.select("fp").mapInPandas(fill, SCHEMA), 1 << (log_bits - 3), "uint8", "or")
    held = spark.sparkContext.broadcast(bits)

    def scan(batches):
        bloom = Bloom(held.value)
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, marks = [], []
            for _, data, offs in blocks(batch.column(1)):
                words = Words(data, offs, ALNUM, True)
                one = _Marks(words, sizes)
                found = one.pick(np.flatnonzero(bloom.has(one.fp)))
                counts.append(words.counts)
                marks.extend(found.get(r) for r in range(len(words)))
            if counts:
                n = len(marks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(np.arange(row_id, row_id + n)), pa.array(np.concatenate(counts)), pa.array(marks, pa.list_(_MARK))],
                    names=["doc_id", "text_key", "row_id", "n_words", "marks"],
                )
                row_id += n

    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(scan), f"doc_id long, text_key long, row_id long, n_words long, marks {_MARKS}")
    seen = scratch.table(seen, "documents")
    marks = seen.where(F.col("marks").isNotNull()).select("row_id", F.explode("marks").alias("m"))
    marks = marks.select("row_id", F.col("m.fp").alias("fp"), F.col("m.size").alias("size"), F.col("m.pos").alias("pos"), F.col("m.left").alias("dl"), F.col("m.right").alias("dr"))
    theirs = items.select("item_id", "fp", "size", F.col("left").alias("bl"), F.col("right").alias("br"))
    counts = scratch.table(marks.groupBy("fp", "size").agg(F.count("*").alias("n")), "counts")
    hits = join_salted(marks, theirs, ["fp", "size"], "row_id", counts)
    whole = F.col("size") < WINDOW
    hits = hits.select(
        "row_id",
        "item_id",
        F.when(whole, F.col("pos")).otherwise(F.col("pos") - _same_words("dl", "bl")).alias("lo"),
        F.when(whole, F.col("pos") + F.col("size")).otherwise(F.col("pos") + K + _same_words("dr", "br")).alias("hi"),
        "size",
    ).where(F.col("hi") - F.col("lo") >= F.col("size"))
    by_row = hits.groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["hi"] - F.greatest(s["lo"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["hi"]).alias("end")),
        lambda acc: acc["n"],
    )
    by_row = by_row.select("row_id", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("names"))
    out = seen.select("doc_id", "text_key", "row_id", "n_words").join(by_row, "row_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_key"
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find words of ``documents`` that lie in passages of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("text_key")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT r, i, k, item_id FROM grams JOIN win USING (k, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

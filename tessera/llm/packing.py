"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are cut into pieces of at most ``capacity`` tokens and ranked by length
over all tasks. A round takes one length, longest first, and sweeps the gaps from the
smallest that holds it upwards (its successors): a run of equal pieces meets a run of
equal gaps at once, ranks settle which piece gets which gap, the gaps shrink, and the
next round follows. Pieces and gaps are kept as runs of equal length with a range of
ranks, so a round works on at most ``capacity`` run lengths whatever the number of
documents; the pieces themselves stay in Spark and find their place by rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._text import tidy
from tessera.llm._tokens import crc_of, encode_column, vocabulary_path
from tessera.session import Scratch

CAPACITY = 4096


def pack_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit of ``counts[length]`` pieces: rows (length, first rank, end rank, first sequence, offset).

    The pieces of a row with ranks first, first + 1, ... go to the sequences first,
    first + 1, ..., all at the same offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of sequences (first, how many)
    sizes: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            each = gap // length
            full = min(many, left // each)
            for layer in range(each if full else 0):
                rows.append((length, rank, rank + full, first, capacity - gap + layer * length))
                rank += full
            left -= full * each
            put(gap - each * length, first, full)
            if full < many:
                some = min(left, each - 1) if left else 0
                for layer in range(some):
                    rows.append((length, rank, rank + 1, first + full, capacity - gap + layer * length))
                    rank += 1
                left -= some
                put(gap - some * length, first + full, 1)
                put(gap, first + full + 1, many - full - 1)
    return rows


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Encode documents and cut those over ``capacity``; (task, place) ranks pieces of one length."""
    path = tokenizer or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("place", pa.int64())])

    def cut(batches):
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = []
            for row, ids in encode_column(batch.column(1), path):
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((names[row], piece, at, len(part), crc_of(part), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        tidy(cut, tokens=True), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Null text is empty (its end id alone is packed); repeated rows are packed each;
    an empty input gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(cut_pieces(docs, capacity, tokenizer), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = scratch.table(before.select("task", "length", "n", F.coalesce("before", F.lit(0)).alias("before")), "ranks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = sorted(pack_runs(counts, capacity))
    table = np.array(rows, np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(table)  # runs, not pieces: bounded by the capacity

    def place(batches):
        runs = held.value
        key = (runs[:, 0] << 44) | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(key, (length << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack ``documents`` into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Importance resampling towards a target distribution, over hashed word runs.

1. Texts of over CHUNK bytes are cut at word boundaries; a chunk carries the next n - 1 words
   of the text, and owns the runs that start in its own part. So no run is lost or counted
   twice, and a very long text is spread over all tasks.
2. Each task counts its runs by bucket (CRC-32 modulo the number of buckets); the counts
   are added up over documents and over the target's texts.
3. A bucket's gain is the scaled logarithm of its share in the target over its share in the
   documents. A second scan sums the gains of each text or chunk; chunks are added up by text.
4. Gumbel noise from a hash of the id is added, and the highest scores are drawn: a
   sample without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._crc import run_crcs
from tessera.llm._rows import KEYS, keyed, row_keys, side
from tessera.llm._text import ALNUM, LOWER, blocks, runs, tidy
from tessera.session import Scratch

ORDER = 3  # longest run of words
BUCKETS = 10_000
PERCENT = 5
SEED = 42
LEAST_WORDS = 20
CHUNK = 1 << 15
SCALE = 1000
_LOOK = 1 << 12


def _next(data: np.ndarray, at: int, member: bool) -> int:
    """First byte from ``at`` on that is part of a word, or that is not; the end if there is none."""
    while at < len(data):
        found = np.flatnonzero(ALNUM[data[at : at + _LOOK]] == member)
        if len(found):
            return at + int(found[0])
        at += _LOOK
    return len(data)


def chunk_bounds(data: np.ndarray, size: int, order: int):
    """Yield (start, end of the own part, end with carried words) of a text's chunks, in bytes."""
    at = 0
    while at < len(data):
        own = _next(data, min(at + size, len(data)), False)
        end = own
        for _ in range(order - 1):
            end = _next(data, _next(data, end, True), False)
        yield at, own, end
        at = own


def _chunks(docs: DataFrame, size: int, order: int, scratch: Scratch) -> DataFrame:
    """(row_id, doc_id, text_key, own, text): chunks of the texts of over ``size`` bytes, dealt over all tasks."""

    def cut(batches):
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                parts = list(chunk_bounds(data, size, order))
                for lo in range(0, len(parts), 64):
                    some = parts[lo : lo + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row_id] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64()), pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                            pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), pa.array([own - at for at, own, _ in some], pa.int64()), pa.array([data[at:end].tobytes() for at, _, end in some], pa.binary()).cast(pa.string()),
                        ],
                        names=["row_id", "chunk", "doc_id", "text_key", "own", "text"],
                    )
                row_id += 1

    long = docs.where(F.octet_length("text") > size).select("doc_id", "text_key", "text")
    cuts = long.mapInArrow(tidy(cut), "row_id long, chunk long, doc_id long, text_key long, own long, text string")
    return scratch.table(cuts.repartition("row_id", "chunk"), "chunks")


def _owned_runs(text, own, order: int, buckets: int):
    """Yield (first row, words of each row, rows, buckets): the runs of a block that its rows own."""
    for lo, data, offs in blocks(text):
        data = LOWER[data]
        starts, ends = runs(ALNUM[data], offs)
        bounds = np.searchsorted(starts, offs)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
        mine = starts < (offs[:-1] + own[lo : lo + len(offs) - 1])[row]
        rows, found = [], []
        for k, crcs in run_crcs(data, starts, ends, order):
            inside = mine[: len(crcs)] & (np.arange(len(crcs)) + k <= bounds[1:][row[: len(crcs)]])
            rows.append(row[: len(crcs)][inside])
            found.append((crcs[inside] % np.uint32(buckets)).astype(np.int64))
        yield lo, np.bincount(row[mine], minlength=len(offs) - 1), np.concatenate(rows), np.concatenate(found)


def _own_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """The own part of each row in bytes; all of the text where it is null."""
    return batch.column("own").fill_null(1 << 62).to_numpy(zero_copy_only=False)


def _counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, n): runs of ``texts`` (text, own) by bucket."""

    def count(batches):
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _owned_runs(batch.column("text"), _own_bytes(batch), order, buckets):
                own += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["bucket", "n"])

    return texts.select("text", "own").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(of_docs: DataFrame, of_target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from counts (bucket, n) of documents and target."""
    both = of_docs.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(of_target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.unionAll(both.sparkSession.range(buckets).selectExpr("id", "0L", "0L")).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = Window.partitionBy()  # a row a bucket
    share = (F.col("t") + 1) * (F.sum("s").over(whole) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(whole) + buckets))
    return every.select("bucket", F.floor(SCALE * F.log(share)).alias("gain"))


def _weights(texts: DataFrame, gains: np.ndarray, order: int) -> DataFrame:
    """(row_id, doc_id, text_key, n_words, n_features, weight) of each text or chunk."""
    held = texts.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def weigh(batches):
        table = held.value
        for batch in batches:
            n = batch.num_rows
            words, many, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, counts, rows, found in _owned_runs(batch.column("text"), _own_bytes(batch), order, len(table)):
                hi = lo + len(counts)
                words[lo:hi], many[lo:hi] = counts, np.bincount(rows, minlength=len(counts))
                sort = np.argsort(rows, kind="stable")
                upto = np.concatenate([[0], np.cumsum(table[found[sort]])])
                ends = np.cumsum(many[lo:hi])
                weight[lo:hi] = upto[ends] - upto[ends - many[lo:hi]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(words), pa.array(many), pa.array(weight)], names=["row_id", "doc_id", "text_key", "n_words", "n_features", "weight"])

    return texts.select("row_id", "doc_id", "text_key", "text", "own").mapInArrow(tidy(weigh), "row_id long, doc_id long, text_key long, n_words long, n_features long, weight long")


def gumbel_noise(doc_id, seed: int = SEED):
    """Scaled Gumbel noise from the first 32 bits of a hash of the id; a null id reads as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(2.0**32))))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, chunk_bytes: int = CHUNK
) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``target`` (text) gives the wanted distribution. Of the N rows with at least
    ``least_words`` words, floor(percent * N / 100) are drawn: those of highest score, ties
    to the smaller doc_id, null ids last; ``rank`` counts them from 1 and is null elsewhere.
    Null and empty texts have no runs and weight 0; null ids share one noise; rows that
    agree in id and score take ranks in any order. An empty ``docs`` gives no row, an
    empty ``target`` a uniform one. Other columns are ignored; ``text_key`` is xxhash64 of the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    chunks = _chunks(docs, chunk_bytes, order, scratch)
    none = F.lit(None).cast("long")
    whole = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk_bytes).select(none.alias("row_id"), "doc_id", "text_key", none.alias("own"), "text")
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col("text").alias("text"))
    wanted_chunks = _chunks(wanted, chunk_bytes, order, scratch)
    wanted = wanted.where(F.octet_length("text") <= chunk_bytes).select("text", none.alias("own")).unionByName(wanted_chunks.select("text", "own"))
    of_docs = _counts(whole.select("text", "own").unionByName(chunks.select("text", "own")), order, buckets)
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(of_docs, _counts(wanted, order, buckets), buckets).collect():  # a row a bucket
        gains[r["bucket"]] = r["gain"]

    names = ("row_id", "doc_id", "text_key")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    of_long = _weights(chunks, gains, order).groupBy(*names).agg(*sums)
    found = _weights(whole, gains, order).unionByName(of_long).drop("row_id")
    scored = scratch.table(found.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed)), "scored")
    return _ranked(scored, percent, least_words, scratch)


def _ranked(scored: DataFrame, percent: int, least_words: int, scratch: Scratch) -> DataFrame:
    """``scored`` with ``rank``; only rows above a bound that is sure to hold all drawn ones are sorted."""
    able = F.col("n_words") >= least_words
    near = F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.01), 10_000)
    n, bound = scored.where(able).agg(F.count("*"), near).first()
    drawn = percent * n // 100
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    if scored.where(able & (F.col("score") >= bound)).count() < drawn:
        bound = -(2**63)
    high = F.coalesce(able & (F.col("score") >= bound), F.lit(False))
    by = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.table(scored.where(high).repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "candidates")
    before = dealt.groupBy("part").agg(F.count("*").alias("many"))  # a row a partition
    before = before.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("before")
    top = dealt.join(F.broadcast(before), "part").withColumn("rank", rank.cast("long")).drop("part", "before")
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(top)


def drawn_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``importance_resample`` drew, with all their columns.

    A row is named by its id and text; of repeated rows all are drawn if one is.
    """
    names = row_keys(verdicts.where(F.col("rank").isNotNull())).distinct()
    return keyed(docs).join(side(names), list(KEYS), "left_semi").drop(*KEYS)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 5 % of ``documents`` towards the distribution of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: The checksum goes through a feature's bytes by half bytes, low half first; the 16 values are those of the half-byte table of polynomial EDB88320.
OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, w FROM d UNION ALL SELECT NULL, w FROM b)),
grams AS (SELECT r, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM starts, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM grams)),
crc AS MATERIALIZED (SELECT f, xor(4294967295::BIGINT, list_reduce(list_transform(range(length(x)), lambda i: (instr('0123456789ABCDEF', substr(x, CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1)) - 1)::BIGINT), lambda acc, h: xor(acc >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][((xor(acc, h) & 15) + 1)]), 4294967295::BIGINT)) % 10000 AS bucket FROM names),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (r IS NULL), 0) AS t FROM grams JOIN crc USING (f) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM grams JOIN crc USING (f) JOIN gains USING (bucket) WHERE r IS NOT NULL GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(weights.n, 0) AS n_features, coalesce(weights.total, 0) AS weight, coalesce(weights.total, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(able.rank AS BIGINT) AS rank, CAST(n_words AS BIGINT) AS n_words
FROM scored LEFT JOIN (SELECT doc_id, rank FROM able WHERE rank <= 5 * n // 100) able USING (doc_id)
"""

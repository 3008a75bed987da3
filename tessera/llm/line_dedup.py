"""Removal of repeated line runs by winnowing over line hashes.

A gram is the shortest run of lines from a line on with at least 25 words, a window the
same with 50. Each window's smallest gram hash is a fingerprint, so any run of 50 words
that stands in two places has a fingerprint in common. Positions of shared fingerprints
are joined to their texts, and each is extended both ways over the lines around it to every
window that can hold it; windows are joined to the first place of the same lines (by two 64-bit
hashes), and a window whose lines stood earlier is deleted. Earlier means a
smaller document id (null last), then the order of rows, then the line. Joining each
place to the first one, not to all others, keeps a line of many copies from being squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._skew import join_counted
from tessera.llm._text import NON_SPACE, as_long, blocks, mix, runs, span_hash, tidy
from tessera.session import Scratch

GRAM_WORDS = 25
RUN_WORDS = 50
BROADCAST_BYTES = 8 << 20

#: Primes below 2 ** 31 and the bases of the hashes of line runs.
_RINGS = ((2147483647, 1103515245), (2147483629, 1664525), (2147483587, 214013), (2147483579, 69069))


def _lines(data: np.ndarray, offs: np.ndarray):
    """(two hashes, words, bounds) of the \n-split lines of each row; an empty row has one empty line."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    inner = np.searchsorted(breaks, offs)
    per = np.diff(inner) + 1
    bounds = np.concatenate([[0], np.cumsum(per)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    starts[bounds[:-1]], ends[bounds[1:] - 1] = offs[:-1], offs[1:]
    at = np.arange(len(breaks)) + np.repeat(np.arange(len(per)), np.diff(inner))
    ends[at], starts[at + 1] = breaks, breaks + 1
    first, _ = runs(NON_SPACE[data], offs) if n else (np.zeros(0, np.int64), None)
    words = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    return np.stack([span_hash(data, starts, ends), span_hash(data, starts, ends, 1)]), words, bounds


def _reach(total: np.ndarray, until: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest run from it with ``least`` words; 0 if it would pass ``until``.

    ``total`` counts the words before each line.
    """
    end = np.maximum(np.searchsorted(total, total[:-1] + least), np.arange(1, len(total)))
    return np.where(end <= until, end, 0)


class _Runs:
    """Hashes of runs of lines in constant time each, from prefix sums over line hashes.

    A run is a polynomial in a fixed base modulo a prime, for four primes of 31 bits.
    """

    def __init__(self, hashes: np.ndarray, rings: int = len(_RINGS)):
        n = hashes.shape[1]
        self.rings = []
        for k, (prime, base) in enumerate(_RINGS[:rings]):
            half = (hashes[k // 2] >> np.uint64(32 * (k % 2))) & np.uint64(0xFFFFFFFF)
            value = half % np.uint64(prime) + np.uint64(1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value * _powers(base, prime, n) % np.uint64(prime), out=total[1:])
            self.rings.append((prime, total % np.uint64(prime), _powers(pow(base, -1, prime), prime, n)))

    def keys(self, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
        """64-bit hash of each run [lo, hi); ``which`` (0 or 1) chooses one of two."""
        parts = []
        for prime, total, down in self.rings[2 * which : 2 * which + 2]:
            parts.append((total[hi] + np.uint64(prime) - total[lo]) % np.uint64(prime) * down[lo] % np.uint64(prime))
        return mix((parts[0] << np.uint64(32)) + parts[1] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo a prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out[: n - len(out)] * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def _least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the smallest value in each range [lo, hi), the last on ties, by doubling ranges."""
    out = np.empty(len(lo), np.int64)
    level = np.floor(np.log2(np.maximum(hi - lo, 1))).astype(np.int64)
    best, step = np.arange(len(values)), 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        a, b = best[lo[at]], best[hi[at] - step]
        out[at] = np.where(values[b] <= values[a], b, a)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] <= values[a], b, a)
        step *= 2
    return out


def _fingerprints(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the lines that windows select, over all rows of a block."""
    total = np.concatenate([[0], np.cumsum(words)])
    until = np.repeat(bounds[1:], np.diff(bounds))
    gram_end, window_end = _reach(total, until, GRAM_WORDS), _reach(total, until, RUN_WORDS)
    start = np.flatnonzero(window_end)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    gram = np.full(len(words), np.uint64(2**64 - 1))
    has = np.flatnonzero(gram_end)
    gram[has] = _Runs(hashes, 2).keys(has, gram_end[has], 0)
    edge = np.where(gram_end > 0, gram_end, until + 1)  # a line near its row's end has no gram
    place = np.unique(_least_in(gram, start, np.searchsorted(np.maximum.accumulate(edge), window_end[start], "right")))
    return place, gram[place]


def _windows(hashes: np.ndarray, words: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, two hashes) of the shortest runs of 50 words, from their first or to their last line, around hits."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    lo = np.maximum(np.searchsorted(total, total[hits] - RUN_WORDS, "right") - 1, 0)
    hi = np.minimum(np.searchsorted(total, total[hits + 1] + RUN_WORDS), n)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    near = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    ahead = _reach(total, np.full(n, n), RUN_WORDS)[near]
    back = np.searchsorted(total, total[near + 1] - RUN_WORDS, "right") - 1
    back = np.minimum(back, near)
    spans = np.concatenate([np.stack([near, ahead], 1)[ahead > 0], np.stack([back, near + 1], 1)[back >= 0]])
    lo, hi = np.unique(spans, axis=0).T
    held = _Runs(hashes)
    return lo, hi, held.keys(lo, hi, 0), held.keys(lo, hi, 1)


def _mark(batches):
    """Rows with fingerprints: their line hashes, words, fingerprints and places."""
    for batch in batches:
        names, ids = batch.column(0), batch.column(1)
        for first, data, offs in blocks(batch.column(2)):
            hashes, words, bounds = _lines(data, offs)
            place, gram = _fingerprints(hashes, words, bounds)
            row, where = np.unique(np.searchsorted(bounds, place, "right") - 1, return_index=True)
            offsets = pa.array(np.append(where, len(place)), pa.int32())
            spans = [(bounds[r], bounds[r + 1]) for r in row]
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(first + row)),
                    ids.take(pa.array(first + row)),
                    pa.array([hashes[:, a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([words[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(as_long(gram))),
                    pa.ListArray.from_arrays(offsets, pa.array((place - bounds[np.searchsorted(bounds, place, "right") - 1]).astype(np.int32))),
                ],
                names=["__row", "doc_id", "hashes", "words", "fps", "places"],
            )


def _extend(batches):
    """Windows around the hits of each row."""
    for batch in batches:
        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        for i in range(batch.num_rows):
            words = np.frombuffer(batch.column(3)[i].as_buffer(), np.int32)
            hashes = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64).reshape(2, -1)
            lo, hi, a, b = _windows(hashes, words, batch.column(4)[i].values.to_numpy().astype(np.int64))
            for column, value in zip(out, (np.full(len(lo), i), lo, hi, as_long(a), as_long(b))):
                column.append(value)
        at, lo, hi, a, b = (np.concatenate(column) for column in out)
        at = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(a), pa.array(b)], names=["__row", "doc_id", "lo", "hi", "run", "again"]
        )


def find_repeated_lines(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): docs with ``__row``, as written, and (__row, __spans array<struct<lo,hi>>) to delete."""
    rows = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    lines = rows.select("__row", F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_mark), "__row long, doc_id long, hashes binary, words binary, fps array<long>, places array<int>")
    lines = scratch.table(lines, "lines")
    marks = lines.select("__row", F.explode(F.arrays_zip("fps", "places")).alias("m")).select("__row", F.col("m.fps").alias("fp"), F.col("m.places").alias("place"))
    shared = scratch.table(marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hits = join_counted(marks, shared, ["fp"], "n").groupBy("__row").agg(F.collect_list("place").alias("hits"))  # of one text, so bounded by it
    windows = lines.join(hits, "__row").select("__row", "doc_id", "hashes", "words", "hits").mapInArrow(tidy(_extend), "__row long, doc_id long, lo int, hi int, run long, again long")
    windows = scratch.table(windows, "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "lo", "hi")
    first = scratch.table(windows.groupBy("run", "again").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    later = join_counted(windows, first, ["run", "again"], "n").where((F.col("__row") != F.col("first.__row")) | (F.col("lo") >= F.col("first.hi")))
    spans = later.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("__spans"))
    return rows, scratch.table(spans, "spans")


OWN_NAMES = ("__row", "__spans", "__lines", "__kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeats of line runs of 50 or more words deleted from ``text``.

    Adds ``n_lines`` and ``n_removed``; every row stays, with an empty text when all its
    lines go. Null text stays null (no lines). Equal rows: the first keeps its lines, and
    which is first is fixed when the rows are first written. Other columns pass through, whatever their
    names; columns already named ``n_lines`` or ``n_removed`` are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lent = {c: f"{c}_{i}_of_docs" for i, c in enumerate(docs.columns) if c.lower() in OWN_NAMES}
    rows, spans = find_repeated_lines(docs.withColumnsRenamed(lent), scratch)
    few = (spans.agg(F.sum(64 + 16 * F.size("__spans"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(spans) if few else spans.hint("merge"), "__row", "left")
    lines = F.split("text", "\n", -1)
    gone = lambda i: F.exists("__spans", lambda s: (s["lo"] <= i) & (i < s["hi"]))
    kept = F.filter("__lines", lambda _, i: ~gone(i))
    out = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__spans").isNull(), F.col("__lines")).otherwise(kept))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n("__lines"))
    n_kept = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n("__kept"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return out.select(*[F.col(f"`{lent.get(c, c)}`").alias(c) for c in names], text.alias("text"), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete repeated line runs from ``documents``; a digest of each text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, CAST(len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT r, doc_id, i, w, sum(w) OVER (PARTITION BY r ORDER BY i) AS upto FROM l),
win AS (SELECT DISTINCT a.r, a.doc_id, a.i AS lo, b.i AS hi FROM c a JOIN c b ON a.r = b.r AND a.i <= b.i AND b.upto - a.upto + a.w >= {RUN_WORDS} AND (b.upto - b.w - a.upto + a.w < {RUN_WORDS} OR b.upto - a.upto < {RUN_WORDS})),
named AS (SELECT win.r, win.doc_id, lo, hi, array_to_string(lines[lo : hi], chr(10)) AS run FROM win JOIN d USING (r)),
firsts AS (SELECT run, min(ROW(doc_id, r, lo, hi)) AS f FROM named GROUP BY run),
gone AS (SELECT DISTINCT r, unnest(range(lo, hi + 1)) AS i FROM named JOIN firsts USING (run) WHERE r <> f[2] OR lo > f[4]),
stay AS (SELECT l.r, string_agg(d.lines[l.i], chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l JOIN d USING (r) LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY l.r)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(stay.text, '')) AS text_sha256 FROM d LEFT JOIN stay USING (r)
"""

"""Vector compression by product codes, with an exact triangle search for the nearest entry.

Vectors become integers and are cut into parts; each part position has a codebook. Rounds
of assigning and averaging follow. A part starts at the entry it had in the round before:
an entry as near as that one lies within twice the distance from it, so only that
entry's neighbours inside this radius are looked at, in order of distance from it. All
distances are exact integers and ties go to the lower index, so every assignment is that
of a full search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._skew import join_counted
from tessera.llm._text import tidy
from tessera.session import Scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 27  # of a component; beyond it, squared distances could pass 64 bits
PIVOTS = 8  # entries among which a part without an entry finds one to start from


class Codebooks:
    """Entries (part, entry, component) and, for each entry, the others by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.many, self.width = entries.shape
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        self.near = np.argsort(apart, axis=-1, kind="stable").reshape(-1, self.many)
        self.apart = np.take_along_axis(apart.reshape(-1, self.many), self.near, -1)
        self.flat = entries.reshape(-1, self.width)

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.flat[at]) ** 2).sum(1)

    def assign(self, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each part (rows, parts) of integer vectors.

        ``start`` has the entries to start from; where it is None, the nearest of the first few is taken.
        """
        x = vectors.reshape(-1, self.width)
        base = np.tile(np.arange(self.parts) * self.many, len(vectors))
        if start is None:
            begin = np.zeros(len(x), np.int64)
            least = self._distance(x, base)
            for e in range(1, min(PIVOTS, self.many)):
                d = self._distance(x, base + e)
                better = d < least
                begin[better], least[better] = e, d[better]
        else:
            begin = start.reshape(-1).astype(np.int64)
            least = self._distance(x, base + begin)
        row = base + begin
        best, radius, left = begin.copy(), 4 * least, np.arange(len(x))
        for j in range(self.many):
            left = left[self.apart[row[left], j] <= radius[left]]
            if not len(left):
                break
            e = self.near[row[left], j]
            d = self._distance(x[left], base[left] + e)
            better = (d < least[left]) | ((d == least[left]) & (e < best[left]))
            at = left[better]
            best[at], least[at] = e[better], d[better]
        return best.reshape(len(vectors), self.parts), least.reshape(len(vectors), self.parts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _vectors(column: pa.Array, size: int, parts: int) -> np.ndarray:
    """Integer vectors (rows, parts, components) from a column of packed bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int32) if len(column) else np.zeros(0, np.int32)
    return raw.astype(np.int64).reshape(len(column), parts, size // parts)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assigned(held: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """``held`` with the code of each vector and its error."""
    spread = held.sparkSession.sparkContext.broadcast(books)  # parts x entries x components

    def assign(batches):
        mine = spread.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("vector"), size, mine.parts)
            before = batch.column("code")
            start = None if before.null_count else np.frombuffer(b"".join(before.to_pylist()), np.int16).reshape(len(x), -1)
            code, error = mine.assign(x, start)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), _packed(code.astype(np.int16)), pa.array(error.sum(1))], names=["vec_id", "label", "vector", "code", "error"])

    return held.select("vec_id", "label", "vector", "code").mapInArrow(tidy(assign), "vec_id long, label string, vector binary, code binary, error long")


def _averaged(held: DataFrame, books: Codebooks, size: int) -> Codebooks:
    """Entries replaced by the floor of their parts' means; each task sends one row an entry in use."""
    parts, many, width = books.parts, books.many, books.width
    names = [f"s{i}" for i in range(width)]

    def total(batches):
        sums, counts = np.zeros((parts * many, width), np.int64), np.zeros(parts * many, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), size, parts).reshape(-1, width)
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).astype(np.int64)
            at += np.tile(np.arange(parts) * many, len(at) // parts)
            counts += np.bincount(at, minlength=parts * many)
            order = np.argsort(at, kind="stable")
            upto = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(x[order], axis=0)])
            ends = np.cumsum(np.bincount(at, minlength=parts * many))
            sums += upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *[pa.array(sums[used, i]) for i in range(width)]], names=["at", "n", *names])

    rows = held.select("vector", "code").mapInArrow(tidy(total), f"at long, n long, {', '.join(f'{c} long' for c in names)}")
    entries = books.entries.reshape(-1, width).copy()
    for r in rows.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # a row an entry
        entries[r["at"]] = [r[c] // r["n"] for c in names]
    return Codebooks(entries.reshape(books.entries.shape))


def compress_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of every kept vector, the codebooks).

    Component x counts as floor(scale * x). Rows whose vector is null or holds a null or
    non-finite component are dropped, and so are vectors of another length than that of the
    smallest kept id. The codebooks start as the parts of the ``entries`` smallest kept ids
    (null ids last, equal ids by vector); with fewer vectors there are fewer entries.
    ``code`` is an array of entries by part, ``error`` the sum of squared distances. Rows
    with equal ids are kept each; without rows the codebooks are None. ``label`` is handed on
    as text; other columns are ignored. A length that ``parts`` doesn't divide, or a
    scaled component of over 2^27, raises ValueError.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "codes")
    x = F.col("v")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    kept = kept.where(x.isNotNull() & F.coalesce(F.forall(x, sound), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select(scaled.alias("v")).collect()  # ``entries`` rows
    names = "vec_id long, label string, code array<int>, error long"
    if not first:
        return spark.createDataFrame([], names), None
    size = len(first[0]["v"])
    if not size or size % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {size} components")
    of_size = kept.where(F.size("v") == size)
    start = [r["v"] for r in first if len(r["v"]) == size]
    if len(start) < len(first):
        start = [r["v"] for r in of_size.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select(scaled.alias("v")).collect()]
    books = Codebooks(np.array(start, np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy())

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if np.abs(whole).max() > LARGEST:
                raise ValueError(f"a scaled component of over {LARGEST}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(whole.astype(np.int32).reshape(-1, size))], names=["vec_id", "label", "vector"])

    held = of_size.select("vec_id", "label", "v").mapInArrow(tidy(pack), "vec_id long, label string, vector binary").withColumn("code", F.lit(None).cast("binary"))
    before = None
    for _ in range(rounds):
        held = scratch.table(_assigned(held, books, size), "assigned")
        if before is not None:
            scratch.drop(before)
        before = held
        books = _averaged(held, books, size)

    def unpack(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int16).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * parts, pa.int32()), pa.array(codes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, batch.column(3)], names=["vec_id", "label", "code", "error"])

    out = _assigned(held, books, size).select("vec_id", "label", "code", "error").mapInArrow(tidy(unpack), names)
    return scratch.table(out, "codes"), books


def decode_vectors(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``, the approximation that each code stands for: the middle of its integer cell."""
    spread = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def decode(code):
        import pandas as pd

        at = np.stack(code.to_list()) if len(code) else np.zeros((0, spread.value.parts), np.int64)
        found = spread.value.entries[np.arange(spread.value.parts), at]
        return pd.Series(list(((found + 0.5) / scale).reshape(len(at), -1)))

    return codes.withColumn("vector", decode("code"))


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors of its label added up; rows without a label go together."""
    keys = codes.withColumn("unlabelled", F.col("label").isNull()).withColumn("of", F.coalesce("label", F.lit("")))
    sums = Scratch(codes.sparkSession, "labels").table(keys.groupBy("unlabelled", "of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "sums")
    return join_counted(keys, sums, ["unlabelled", "of"], "n").drop("unlabelled", "of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of ``embeddings``."""
    codes, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return label_errors(codes).select("vec_id", text.alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Assignment a<i> to codebook b<i>, and codebook b<i + 1>."""
    mean = ", ".join(f"CAST(floor(sum(x[{k}]) / count(*)) AS BIGINT)" for k in range(1, 5))
    return f"""
a{i} AS MATERIALIZED (SELECT id, j, m.e AS e, m.d AS d FROM (SELECT p.id, p.j, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m FROM p JOIN b{i} b ON p.j = b.j GROUP BY p.id, p.j)),
b{i + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT a.j, a.e, [{mean}] AS x FROM a{i} a JOIN p ON p.id = a.id AND p.j = a.j GROUP BY a.j, a.e) n ON n.j = b.j AND n.e = b.e),"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT id, j, v[4 * j + 1 : 4 * j + 4] AS x FROM k, range(16) AS parts(j)),
b0 AS MATERIALIZED (SELECT j, id - 1 AS e, x FROM p WHERE id <= 64),{_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
codes AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY j) AS code, sum(d) AS error FROM a2 GROUP BY id)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) FROM b2) AS codebooks_sha256
FROM k JOIN codes USING (id)
"""

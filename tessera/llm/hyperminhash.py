"""Near duplicates by HyperMinHash registers, banding and verification.

1. Texts with equal sets of 4-word shingles form a class. The 64-bit hashes of a class's
   shingles fall into 2^9 buckets by their first bits; a register keeps the smallest rest in
   its bucket as a count of leading zeros and ten more bits, 16 bits in all.
2. For banding, an empty register borrows from another bucket by a fixed random walk, so a
   short text has as many registers as a long one, each equal in two sets with the
   probability of their Jaccard similarity. Bands are of seven registers. At similarity 0.8
   a pair misses all 73 bands with probability below 4e-8, above 0.8 far less.
3. Classes that share a band are candidates. The share of equal registers, less the
   equal ones that chance collisions of two unrelated minima explain, estimates the
   similarity; a pair is passed over only if the estimate is six standard errors too low.
   The minima are a sample of the union without replacement, so for short texts the error is small.
4. What is left is verified on the sets of the whole texts. Candidates are made in rounds:
   with a band's first class, with neighbours in the band, then all pairs of classes that
   lie in two components still, so no candidate link between components is lost and copies
   of one text are not squared. In the last round a band of many classes is cut into blocks
   whose registers are compared as matrices, and only likely pairs leave a task.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._rows import KEYS, keyed, row_keys, side
from tessera.llm._text import NON_SPACE, Words, as_long, blocks, mix, tidy
from tessera.llm.components import extended_components
from tessera.llm.jaccard_join import Verifier, document_components, name_classes, set_names
from tessera.session import Scratch

SHINGLE = 4
NUM, DEN = 4, 5  # similarity 0.8 as a fraction
BUCKET_BITS = 9
MANTISSA = 10
REGISTERS = 1 << BUCKET_BITS
BAND = 7
BANDS = REGISTERS // BAND
EMPTY = np.uint16(0xFFFF)
SIGMAS = 6
SLACK = 0.01  # of an estimate, for the rounding of the correction
TRIES = 4  # partners that a class tries in each round but the last
ROUNDS, NEIGHBOURS = 2, 3  # rounds and neighbours in a band that are tried before all pairs are
SPARSE = 16  # registers in use up to which the walks of the empty ones are looked up
LEAST = 4  # shingles of a set that can be similar to another one: n / (n + 1) is below 0.8 for fewer
SMALL = 32  # bands of more classes are compared in blocks
BLOCK = 512

_HASH = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.argsort(mix(np.arange(REGISTERS, dtype=np.uint64) * _HASH), kind="stable")[: BANDS * BAND]  # which registers make which band


def sorted_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row in ascending order, bounds of the rows) of a block."""
    grams, bounds, _ = Words(data, offs, NON_SPACE, True).grams(k)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(bounds)))


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (rows, REGISTERS) of sorted sets: six bits of leading zeros, ten of mantissa."""
    rows = len(bounds) - 1
    out = np.full((rows, REGISTERS), EMPTY, np.uint16)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    bucket = (sets >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    rest = (sets[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, exact as a double
    zeros = 53 - np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    mantissa = ((rest << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - MANTISSA)
    out[row[first], bucket[first]] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def _walk(turn: int) -> np.ndarray:
    """The bucket that each register's walk visits at a turn."""
    return (mix(np.arange(REGISTERS, dtype=np.uint64) + (turn << 32)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@cache
def _first_turns() -> np.ndarray:
    """The first turn at which the walk of each register visits each bucket."""
    out, at, turn = np.full((REGISTERS, REGISTERS), 0xFFFF, np.uint16), np.arange(REGISTERS), 0
    while (out == 0xFFFF).any():
        for _ in range(500):
            turn += 1
            to = _walk(turn)
            out[at, to] = np.minimum(out[at, to], turn)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one replaced by the first that a walk of its own finds filled."""
    out = regs.copy()
    many = (regs != EMPTY).sum(1)
    for few in np.unique(many[(many > 0) & (many <= SPARSE)]).tolist():  # a walk would take long; look up which bucket it meets first
        rows = np.flatnonzero(many == few)
        for lo in range(0, len(rows), 256):
            some = rows[lo : lo + 256]
            held = np.nonzero(regs[some] != EMPTY)[1].reshape(len(some), few)
            met = np.take_along_axis(held[:, None, :], _first_turns()[:, held].transpose(1, 0, 2).argmin(2)[:, :, None], 2)[:, :, 0]
            out[some] = np.where(regs[some] != EMPTY, regs[some], np.take_along_axis(regs[some], met, 1))
    row, at = np.nonzero(regs == EMPTY)
    open_ = many[row] > SPARSE
    row, at, turn = row[open_], at[open_], 0
    while len(row):
        turn += 1
        found = regs[row, _walk(turn)[at]]
        hit = found != EMPTY
        out[row[hit], at[hit]] = found[hit]
        row, at = row[~hit], at[~hit]
    return out


def band_parts(regs: np.ndarray) -> np.ndarray:
    """The registers of each band (rows, BANDS, BAND), none of them empty."""
    return filled(regs)[:, _PLACES].reshape(len(regs), BANDS, BAND)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit names (rows, BANDS) of the bands' registers."""
    parts = band_parts(regs).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(BAND):
        key = mix(key * _HASH + parts[:, :, j])
    return key


def collisions(na: np.ndarray, nb: np.ndarray, bits: int = MANTISSA) -> np.ndarray:
    """Probability that a bucket's registers of two unrelated sets of these sizes are equal and not empty.

    A register with z leading zeros stands for 2^bits cells, each 2^-(z + 1 + bits) wide; the
    two minima are exponential, so the chance of a common cell is near its width times
    the product of their densities, which is summed over the cells of each z in closed form.
    """
    a, b = na / REGISTERS, nb / REGISTERS
    total, rate = np.zeros(len(na)), a + b
    for z in range(54):
        low = 2.0 ** -(z + 1)
        total += 2.0 ** -(z + 1 + bits) * (np.exp(-rate * low) - np.exp(-rate * 2 * low))
    return total * a * b / rate


def corrected(equal: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers among those in use, less what collisions explain."""
    chance = np.minimum(collisions(na, nb) * REGISTERS / used, 0.5)
    return (equal / used - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of register rows, corrected for collisions, and the buckets it rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    return corrected(((a == b) & (a != EMPTY)).sum(1), used, na, nb), used


def may_link(found: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with this estimate can have the similarity.

    At the similarity itself the union has (na + nb) / (1 + similarity) shingles, of which
    the registers in use hold a random sample without replacement.
    """
    level = NUM / DEN
    union = np.maximum((na + nb) / (1 + level), used + 1e-9)
    error = np.sqrt(level * (1 - level) / used * (union - used) / np.maximum(union - 1, 1e-9))
    return (DEN * na >= NUM * nb) & (DEN * nb >= NUM * na) & (found >= level - SIGMAS * error - SLACK)


def _sketches(texts: DataFrame, k: int) -> DataFrame:
    """(class, n, registers, bands) of the sets of ``texts`` that can be similar to others; smaller ones have equals only."""

    def sketch(batches):
        for batch in batches:
            for _, data, offs in blocks(batch.column(0)):
                sets, bounds = sorted_sets(data, offs, k)
                n = np.diff(bounds)
                rows = np.flatnonzero(n >= LEAST)
                if not len(rows):
                    continue
                sets, bounds = sets[np.repeat(n >= LEAST, n)], np.concatenate([[0], np.cumsum(n[rows])])
                regs = registers(sets, bounds)
                keys = as_long(band_keys(regs)).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(set_names(sets, bounds)), pa.array(n[rows]), pa.array([r.tobytes() for r in regs], pa.binary()), lists], names=["class", "n", "regs", "bands"])

    return texts.select("text").mapInArrow(tidy(sketch), "class long, n long, regs binary, bands array<long>")


class _Likely:
    """Keeps the pairs of classes whose registers don't rule the similarity out."""

    def __init__(self, sketches: DataFrame, scratch: Scratch):
        self.sketches, self.scratch = sketches, scratch

    def __call__(self, pairs: DataFrame) -> DataFrame:
        def check(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(may_link(*estimates(a, b, na, nb), na, nb)))

        a = self.sketches.select(F.col("class").alias("src"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        b = self.sketches.select(F.col("class").alias("dst"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        both = pairs.join(b, "dst").join(a, "src").select("src", "dst", "na", "nb", "ra", "rb")
        return self.scratch.table(both.mapInArrow(tidy(check), "src long, dst long"), "likely")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, first): components of documents linked at Jaccard 0.8.

    ``text_key`` is xxhash64 of the text; ``first`` marks the rows of one (id, text) of
    each component, the smallest. A row for each row of ``docs`` (doc_id, text). A text
    without words, or null, has no shingle and is its own component; one of fewer than
    ``k`` words has its sequence as its one shingle. Rows with equal ids take part each
    and share the smallest id of their links; a null id is kept and never the smallest
    unless alone. An empty input gives no row; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "hyperminhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    classes = name_classes(docs, k, scratch)
    full = classes.where(F.col("class").isNotNull())
    return document_components(classes, full, _class_components(docs, full, k, scratch))


def _class_components(docs: DataFrame, full: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    reps = full.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"))
    extra = full.join(reps, "class").where(~F.struct("doc_id", "text_key").eqNullSafe(F.col("rep")))
    extra = scratch.table(row_keys(extra).distinct(), "copies")
    texts = keyed(docs)
    unique = texts.join(side(extra), list(KEYS), "left_anti")
    sketches = scratch.table(_sketches(unique, k), "sketches")  # rows that agree in id and text give one each

    bands = sketches.select("class", "n", F.posexplode("bands").alias("place", "band")).repartition("band")  # one exchange for the count and the join below
    shared = bands.groupBy("band").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("band")
    posts = scratch.table(bands.join(shared.hint("shuffle_hash"), "band").distinct(), "bands")
    met = scratch.table(posts.select("class").distinct(), "met")
    sketches = scratch.table(sketches.join(met, "class").select("class", "n", "regs").dropDuplicates(["class"]), "registers")
    wanted = scratch.table(row_keys(met.join(reps, "class").select("class", "rep.doc_id", "rep.text_key"), "class"), "wanted")
    texts = texts.select(*KEYS, "text").join(side(wanted), list(KEYS))
    texts = scratch.table(texts.groupBy("class").agg(F.first("text").alias("text")), "texts")
    likely, verifier = _Likely(sketches, scratch), Verifier(texts, k, scratch, NUM, DEN)

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs (src < dst) of rows (a, b) whose sizes allow the similarity, and how often they are ``shared``."""
        na, nb = F.col("a.n"), F.col("b.n")
        pairs = pairs.where((F.col("a.class") != F.col("b.class")) & (DEN * na >= NUM * nb) & (DEN * nb >= NUM * na))
        return pairs.groupBy(F.least("a.class", "b.class").alias("src"), F.greatest("a.class", "b.class").alias("dst")).agg(F.count("*").alias("shared"))

    def tried(pairs: DataFrame) -> DataFrame:
        """The few pairs of each class that are shared most; later rounds do what is left."""
        return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("shared"), "src"))).where(F.col("nth") <= TRIES).select("src", "dst")

    # round 1: the first class of each band with every other
    first = posts.groupBy("band").agg(F.min(F.struct("class", "n")).alias("a"))
    star = fitting(posts.select("band", F.struct("class", "n").alias("b")).join(first, "band"))
    done = scratch.table(tried(star), "pairs")
    component = extended_components(None, verifier.links(likely(done)), scratch)

    # middle rounds: neighbours in a band that lie in two components, in a new order each time
    mixed = posts
    for turn in range(ROUNDS):
        mixed = scratch.table(_mixed(mixed, component), "mixed")
        by = Window.partitionBy("band").orderBy("order", "class")
        near = mixed.withColumn("order", F.xxhash64("class", "band", F.lit(turn))).withColumn("b", F.struct("class", "n", "root"))
        near = near.withColumn("before", F.array(*[F.lag("b", i).over(by) for i in range(1, NEIGHBOURS + 1)]))
        near = tried(fitting(near.select("b", F.explode("before").alias("a")).where("a.root <> b.root")))
        new = scratch.table(near.join(done, ["src", "dst"], "left_anti"), "pairs")
        component = extended_components(component, verifier.links(likely(new)), scratch)
        done = done.unionByName(new)
        mixed = mixed.select("band", "place", "class", "n")

    # last round: all pairs of a band whose classes lie in two components; one of them is outside the band's largest
    mixed = scratch.table(_mixed(mixed, component), "mixed")
    parts = mixed.groupBy("band", "root").agg(F.count("*").alias("many"))
    shapes = parts.groupBy("band").agg(F.sum("many").alias("many"), F.max(F.struct("many", "root")).alias("top"))
    shapes = scratch.table(shapes.select("band", "many", F.col("top.root").alias("top"), F.col("top.many").alias("in_top")), "shapes")
    rest = _likely_in_blocks(mixed.join(shapes, "band"), shapes, sketches)
    rest = scratch.table(rest.join(done, ["src", "dst"], "left_anti"), "pairs")
    component = extended_components(component, verifier.links(rest), scratch)
    return component.select(F.col("node").alias("class"), F.col("root").alias("component"))


def _likely_in_blocks(rows: DataFrame, shapes: DataFrame, sketches: DataFrame) -> DataFrame:
    """(src, dst): likely pairs of two components that share a band, each from the first band that it shares.

    ``rows`` has (band, place, class, n, root, many, top, in_top), ``shapes`` a row a band. Small
    bands are put together into blocks of about BLOCK rows. Those of many classes are dealt
    into such blocks, those of their largest component apart, and every two blocks of a band
    meet but two of its largest component. No task holds more than two blocks of registers.
    """
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keep = ["band", "place", "class", "n", "root"]
    few = shapes.where(F.col("many") <= SMALL).agg(F.sum("many")).first()[0] or 0
    small = rows.where(F.col("many") <= SMALL).select(*keep, F.pmod(F.xxhash64("band"), F.lit(few // BLOCK + 1)).alias("cell"), *[F.lit(0).alias(c) for c in "ijb"])
    rows = rows.where(F.col("many") > SMALL).withColumn("cell", F.col("band")).withColumn("mb", blocks_of(F.col("many") - F.col("in_top"))).withColumn("tb", blocks_of(F.col("in_top")))
    minor = rows.where("root <> top").withColumn("b", deal(F.col("mb")))
    top = rows.where("root = top").withColumn("b", -1 - deal(F.col("tb")))
    keep = [*keep, "cell"]
    inside = minor.select(*keep, "b", every(F.col("mb")).alias("o")).select(*keep, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b")
    outside = minor.select(*keep, "b", every(F.col("tb")).alias("o")).select(*keep, F.col("b").alias("i"), (-1 - F.col("o")).alias("j"), "b")
    met = top.select(*keep, "b", every(F.col("mb")).alias("o")).select(*keep, F.col("o").alias("i"), F.col("b").alias("j"), "b")
    large = inside.unionByName(outside).unionByName(met)
    dealt = small.withColumn("whole", F.lit(False)).unionByName(large.withColumn("whole", F.lit(True))).join(sketches.select("class", "regs"), "class")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(-1, REGISTERS)
        band, place, name, n, root, b = (pdf[c].to_numpy() for c in ("band", "place", "class", "n", "root", "b"))
        left, right = _pairs(band) if not pdf["whole"].iloc[0] else _two_blocks(b, pdf["i"].iloc[0], pdf["j"].iloc[0])
        fits = (root[left] != root[right]) & (DEN * n[left] >= NUM * n[right]) & (DEN * n[right] >= NUM * n[left])
        left, right = left[fits], right[fits]
        parts, src, dst = None, [], []
        for lo in range(0, len(left), 4096):
            x, y = left[lo : lo + 4096], right[lo : lo + 4096]
            nx, ny = n[x].astype(float), n[y].astype(float)
            some = np.flatnonzero(may_link(*estimates(regs[x], regs[y], nx, ny), nx, ny))
            if len(some):
                parts = band_parts(regs) if parts is None else parts
                x, y = x[some], y[some]
                first = (parts[x] == parts[y]).all(2).argmax(1) == place[x]
                src.append(np.minimum(name[x], name[y])[first])
                dst.append(np.maximum(name[x], name[y])[first])
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"src": np.concatenate([none, *src]), "dst": np.concatenate([none, *dst])})

    return dealt.groupBy("whole", "cell", "i", "j").applyInPandas(compare, "src long, dst long").distinct()


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places that hold the same key."""
    order = np.argsort(keys, kind="stable")
    held, left, right = keys[order], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(keys)):
        same = np.flatnonzero(held[step:] == held[:-step])
        if not len(same):
            break
        left.append(order[same])
        right.append(order[same + step])
    return np.concatenate(left), np.concatenate(right)


def _two_blocks(b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of two blocks, or of one block with itself."""
    x, y = np.flatnonzero(b == i), np.flatnonzero(b == j)
    if i == j:
        u, v = np.triu_indices(len(x), 1)
        return x[u], x[v]
    return np.repeat(x, len(y)), np.tile(y, len(x))


def _mixed(posts: DataFrame, component: DataFrame) -> DataFrame:
    """Rows of bands whose classes lie in more than one component, with the component of each."""
    labelled = posts.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")).repartition("band")
    mixed = labelled.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    return labelled.join(mixed.hint("shuffle_hash"), "band").select("band", "place", "class", "n", "root")


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` at similarity 0.8 of 4-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id, d.doc_id = min(reach.y) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""

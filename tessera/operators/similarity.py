"""Vector retrieval: anchors, nearest neighbours and similarity between groups in cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, cosine_distance
from tessera.operators.cells import SLACK, angles, block_of, every, unit
from tessera.session import Scratch

FUNNEL_LEAST = 0.35
SIMILAR_OVER = 0.85
MOST_ANCHORS = 64
PIVOT_FLOATS = 1 << 22  # numbers that the pivots of one vector length may have
MOST_CELLS = 64  # of a scope, so that a row is lent a bounded number of times
SPLIT = 12  # blocks that a large scope is cut into, whatever its rows
BLOCK_FLOATS = 1 << 23  # numbers of one block at most: only beyond SPLIT of these do copies of a row grow with its scope
WORTH = 0.25  # share of other cells that rows may be lent to on average for cells to be used
TILE = (1024, 4096)
HELD_PAIRS = 1 << 20
BROADCAST_KEYS = 100_000


def semantic_funnel(chunks: DataFrame, anchors: DataFrame, key: str, vector: str, least: float = FUNNEL_LEAST) -> DataFrame:
    """Chunks whose best similarity to an anchor is at least ``least``, with that similarity.

    Anchors are a stated set of at most 64 rows, checked; they travel as one array with
    the chunks' scan, so no pairs are made.
    """
    rows = anchors.select(vector).limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"at most {MOST_ANCHORS} anchors")
    targets = [np.asarray(r[0], float) for r in rows if r[0] is not None]
    targets = [t / np.linalg.norm(t) for t in targets if np.linalg.norm(t) > 0]
    kind = chunks.schema[key].dataType.simpleString()

    def best(batches):
        for pdf in batches:
            out = np.full(len(pdf), -np.inf)
            sizes = pdf[vector].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for size in set(map(len, targets)):  # vectors of other sizes are similar to nothing
                at = np.flatnonzero(sizes == size)
                if len(at):
                    m = np.stack(pdf[vector].to_numpy()[at]).astype(float)
                    norm = np.linalg.norm(m, axis=1)
                    sims = (m @ np.stack([t for t in targets if len(t) == size]).T).max(axis=1) / np.where(norm > 0, norm, np.nan)
                    out[at] = np.fmax(out[at], sims)
            keep = out >= least
            yield pd.DataFrame({key: pdf[key][keep], "max_similarity": out[keep]})

    return chunks.select(key, vector).mapInPandas(best, f"`{key}` {kind}, max_similarity double")


def nearest(chunks: DataFrame, query: list[float], key: str, vector: str, k: int = 10) -> DataFrame:
    """The k nearest chunks by cosine distance; ties by key. Null vectors are left out."""
    target = F.array(*[F.lit(float(x)) for x in query])
    found = chunks.where(F.col(vector).isNotNull()).select(key, cosine_distance(F.col(vector), target).alias("distance"))
    return found.orderBy("distance", key).limit(k)


def _pivots(rows: DataFrame, most_floats: int) -> dict[int, np.ndarray]:
    """For each vector size: the pivots, drawn by a hash; as many as its scopes have cells, up to a bound on their floats."""
    many = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.max("cells").alias("n")).collect()}  # a row a vector size
    out = {}
    for size, n in many.items():
        want = max(1, min(n, most_floats // max(size, 1)))
        drawn = rows.where(F.col("size") == size).orderBy(F.xxhash64("g", "v", F.lit(1)), "g", "v").limit(want).select("v").collect()  # at most MOST_CELLS rows
        out[size] = unit([r["v"] for r in drawn])
    return out


def _side(keys: DataFrame) -> DataFrame:
    """A written table of keys as a side of a join: broadcast if it is small, so that rows of one key stay where they are."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as unit rows."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _near(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]):
    """For each vector size and number of cells in a batch (size, cells, v): its rows, and their angles from the pivots."""
    kinds = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("size", "cells")], 1)
    for size, cells in np.unique(kinds, axis=0) if len(kinds) else ():
        at = np.flatnonzero((kinds == (size, cells)).all(1))
        yield at, np.nan_to_num(angles(_matrix(batch.column("v").take(pa.array(at))), pivots[size][:cells]), nan=np.pi)


def _celled(chunks: DataFrame, group: str, vector: str, over: float, block_rows: int, within: str | None, most_floats: int) -> DataFrame:
    """Rows placed in the products they take part in: (s, size, cell, i, j, b, g, v).

    A product is of block i of a cell's own rows and block j of its own or of the rows that
    other cells lend it; ``b`` is the row's own block, and blocks of lent rows are negative.
    A scope has at most MOST_CELLS cells, and its blocks grow with it, so copies of a row don't.
    A scope whose rows would be lent to most cells is cut into blocks only. Rows equal in scope, group and vector count once.
    """
    scope = F.col(within).cast("string") if within else F.lit("")
    scratch = Scratch(chunks.sparkSession, "similar")
    cut = chunks.where(F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("g"), scope.alias("s"), F.col(vector).alias("v"), F.size(vector).alias("size"))
    cut = scratch.table(cut.where("size > 0 AND s IS NOT NULL AND g IS NOT NULL").distinct(), "vectors")
    keys = ["s", "size", "cell"]
    rows = F.greatest(F.lit(block_rows), F.ceil(F.count("*") / SPLIT))
    rows = F.greatest(F.lit(1), F.least(rows, F.ceil(F.lit(BLOCK_FLOATS) / F.col("size"))))
    cells = F.least(F.ceil(F.count("*") / block_rows), F.lit(MOST_CELLS), F.greatest(F.lit(1), F.floor(F.lit(most_floats) / F.col("size"))))
    scopes = scratch.table(cut.groupBy("s", "size").agg(cells.cast("int").alias("cells"), rows.cast("long").alias("rows"), F.count("*").alias("n")), "scopes")
    if (scopes.agg(F.max("cells")).first()[0] or 1) == 1:  # every scope is one block
        return cut.select("s", "size", *[F.lit(0).alias(c) for c in ("cell", "i", "j", "b")], "g", "v")
    sized = cut.join(_side(scopes.select("s", "size", "cells")), ["s", "size"])
    pivots = cut.sparkSession.sparkContext.broadcast(_pivots(sized, most_floats))
    reach = float(np.arccos(over)) if 0 < over < 1 else np.pi
    kind = chunks.schema[vector].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, near in _near(batch, pivots.value):
                cell[at], far[at] = near.argmin(1), near.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("size"), pa.array(cell), pa.array(far)], names=["s", "size", "cell", "angle"])

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]  # scope, radius of its cells; one without rows has nothing to be near to

        def radius_of(batch: pa.RecordBatch, i: int, cells: int) -> np.ndarray:
            scope = batch.column("s")[i].as_py(), cells, batch.column("size")[i].as_py()
            if last[0] != scope:
                held = batch.column("radius")[i].as_py()
                last[:] = scope, np.full(cells, -np.inf)
                last[1][[h["cell"] for h in held]] = [h["radius"] for h in held]
            return last[1]

        for batch in batches:
            cell, lends = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, near in _near(batch, pivots.value):
                every_cell, own = np.arange(near.shape[1])[None], near.argmin(1)
                radius = np.stack([radius_of(batch, i, near.shape[1]) for i in at])
                to = (near <= (near.min(1) + 2 * reach + SLACK)[:, None]) & (near <= radius + reach + SLACK)
                to &= ((every_cell + own[:, None]) % 2 == 1) == (own[:, None] < every_cell)  # a pair of cells lends one way only
                to[np.arange(len(at)), own] = False
                cell[at] = own
                for k, i in enumerate(at):
                    lends[i] = np.flatnonzero(to[k]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("s", "size", "g", "v")), pa.array(cell), pa.array(lends, pa.list_(pa.int32()))], names=["s", "size", "g", "v", "cell", "lends"])

    homes = sized.where("cells > 1").select("s", "size", "cells", "v").mapInArrow(home, "s string, size int, cell int, angle double")
    radius = homes.groupBy(*keys).agg(F.max("angle").alias("radius")).groupBy("s", "size").agg(F.collect_list(F.struct("cell", "radius")).alias("radius"))  # at most MOST_CELLS
    radius = scratch.table(radius, "radius")
    placed = sized.where("cells > 1").join(_side(radius), ["s", "size"]).select("s", "size", "cells", "g", "v", "radius")
    placed = scratch.table(placed.mapInArrow(lend, f"s string, size int, g string, v {kind}, cell int, lends array<int>"), "cells")
    lent_to = placed.groupBy("s", "size").agg(F.avg(F.size("lends")).alias("lends"))
    scopes = scratch.table(scopes.join(lent_to, ["s", "size"], "left").select("s", "size", "rows", F.coalesce(F.col("lends") <= F.lit(WORTH) * F.col("cells"), F.lit(False)).alias("celled")), "scopes")
    known = _side(scopes)
    placed = placed.join(known, ["s", "size"]).where("celled")
    plain = cut.join(known, ["s", "size"]).where("NOT celled").select("s", "size", F.lit(0).alias("cell"), "g", "v", "rows")
    own = placed.select(*keys, "g", "v", "rows").unionByName(plain)
    lent = placed.select("s", "size", F.explode("lends").alias("cell"), "g", "v")
    blocks = F.greatest(F.ceil(F.count("*") / F.first("rows")), F.lit(1)).cast("int")
    counts = own.groupBy(*keys).agg(blocks.alias("hb"))
    others = placed.select("s", "size", F.explode("lends").alias("cell"), "rows").groupBy(*keys).agg(blocks.alias("ob"))
    counts = _side(scratch.table(counts.join(others, keys, "left").withColumn("ob", F.coalesce("ob", F.lit(0))), "blocks"))
    mine = own.join(counts, keys).withColumn("b", block_of(F.col("hb"), F.col("g"), F.col("v")))
    theirs = lent.join(counts, keys).withColumn("b", -1 - block_of(F.col("ob"), F.col("g"), F.col("v")))
    inside = mine.select(*keys, "b", "g", "v", "hb", every(F.col("hb")).alias("o")).select(*keys, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "g", "v")
    lending = mine.select(*keys, "b", "g", "v", every(F.col("ob")).alias("o")).select(*keys, F.col("b").alias("i"), (-1 - F.col("o")).alias("j"), "b", "g", "v")
    borrowed = theirs.select(*keys, "b", "g", "v", every(F.col("hb")).alias("o")).select(*keys, F.col("o").alias("i"), F.col("b").alias("j"), "b", "g", "v")
    return inside.unionByName(lending).unionByName(borrowed)


def compared_pairs(chunks: DataFrame, group: str, vector: str, over: float = SIMILAR_OVER, block_rows: int = 4096, within: str | None = None, most_floats: int = PIVOT_FLOATS) -> int:
    """How many pairs of rows ``similar_groups`` multiplies."""
    placed = _celled(chunks, group, vector, over, block_rows, within, most_floats)
    sides = placed.groupBy("s", "size", "cell", "i", "j").agg(F.count_if(F.col("b") == F.col("i")).alias("a"), F.count_if(F.col("b") == F.col("j")).alias("b"))
    return int(sides.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)


class _Product:
    """Two blocks of one product as unit rows, multiplied in tiles of single precision; what may be over the bound is computed again in double."""

    def __init__(self, batches: Iterator[pa.RecordBatch], over: float):
        b, ends, groups, rows = [], [0, 0], [], []
        for batch in batches:
            ends = [batch.column("i")[0].as_py(), batch.column("j")[0].as_py()]
            b.append(batch.column("b").to_numpy(zero_copy_only=False))
            groups += batch.column("g").to_pylist()
            rows.append(_matrix(batch.column("v")))
        b, self.rows = np.concatenate(b), np.concatenate(rows)
        rows.clear()
        self.names, self.group = np.unique(np.array(groups, object), return_inverse=True)
        self.single, self.over = self.rows.astype(np.float32), over
        self.a, self.b = (np.flatnonzero(b == end) for end in ends)
        self.square = ends[0] == ends[1]
        self.slack = (self.rows.shape[1] + 8) * 2.0**-23  # more than the rounding of a product of unit rows

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(self.a), TILE[0]):
            for at in range(0, len(self.b), TILE[1]):
                if not self.square or at + TILE[1] > lo:  # else its mirror image is another tile's
                    yield self.a[lo : lo + TILE[0]], self.b[at : at + TILE[1]]

    def pairs(self, x: np.ndarray, y: np.ndarray, least: float, fine=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, similarity) of pairs of x and y over the bound; those surely under ``least``, or not ``fine``, may be left out."""
        if not len(x) or not len(y):
            return
        near = self.single[x] @ self.single[y].T
        r, c = np.nonzero(near > max(self.over, least) - self.slack)
        if fine is not None:
            keep = fine(x[r], y[c], near[r, c] + self.slack)
            r, c = r[keep], c[keep]
        step = max(1, (1 << 22) // self.rows.shape[1])
        for lo in range(0, len(r), step):
            p, q = x[r[lo : lo + step]], y[c[lo : lo + step]]
            sims = np.einsum("ij,ij->i", self.rows[p], self.rows[q])
            keep = sims > self.over
            yield p[keep], q[keep], sims[keep]


def _best_pairs(product: _Product) -> Iterator[pa.RecordBatch]:
    """(src, dst, weight) of pairs of groups over the bound; a pair may come more than once if groups are many."""
    n, group = len(product.names), product.group

    def batch(key: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(product.names[key // n], pa.string()), pa.array(product.names[key % n], pa.string()), pa.array(weight)], names=["src", "dst", "weight"])

    if n * n <= HELD_PAIRS:  # the best so far of every pair of groups
        best = np.full((n, n), -np.inf)
        met = np.unique(group[product.a])[:, None] != np.unique(group[product.b])[None]
        rows, cols = np.unique(group[product.a]), np.unique(group[product.b])

        def fine(p, q, most):
            gp, gq = group[p], group[q]
            return (gp != gq) & (most >= best[np.minimum(gp, gq), np.maximum(gp, gq)])

        for x, y in product.tiles():
            held = np.maximum(best, best.T)[np.ix_(rows, cols)][met]
            for p, q, sims in product.pairs(x, y, held.min(initial=np.inf), fine):
                gp, gq = group[p], group[q]
                np.maximum.at(best, (np.minimum(gp, gq), np.maximum(gp, gq)), sims)
        key = np.flatnonzero(best > product.over)
        yield batch(key, best.ravel()[key])
        return
    keys, weights, held = [], [], 0

    def compacted():
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.lexsort((weight, key))
        key, weight = key[order], weight[order]
        last = np.append(key[1:] != key[:-1], True)
        return key[last], weight[last]

    for x, y in product.tiles():
        for p, q, sims in product.pairs(x, y, -np.inf, lambda p, q, most: group[p] != group[q]):
            gp, gq = group[p], group[q]
            keys.append(np.minimum(gp, gq) * n + np.maximum(gp, gq))
            weights.append(sims)
            held += len(sims)
            if held > 2 * HELD_PAIRS:
                key, weight = compacted()
                if len(key) > HELD_PAIRS:
                    yield batch(key, weight)
                    key, weight = key[:0], weight[:0]
                keys, weights, held = [key], [weight], len(key)
    if keys:
        yield batch(*compacted())


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (each the smallest member of its class) after the classes of p and q are joined."""
    while True:
        p, q = label[p], label[q]
        apart = p != q
        if not apart.any():
            return label
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def _forest(product: _Product) -> Iterator[pa.RecordBatch]:
    """(src, dst): for every group but the first of its class, that first one; pairs inside a class that is known aren't multiplied."""
    group, label = product.group, np.arange(len(product.names))
    for x, y in product.tiles():
        lx, ly = label[group[x]], label[group[y]]
        most = np.bincount(lx).argmax()  # the class that holds most of the tile's rows
        parts = [(x[lx != most], y), (x[lx == most], y[ly != most])]
        for rows, cols in parts:
            for p, q, _ in product.pairs(rows, cols, -np.inf, lambda p, q, _: label[group[p]] != label[group[q]]):
                label = _joined(label, group[p], group[q])
    at = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([pa.array(product.names[label[at]], pa.string()), pa.array(product.names[at], pa.string())], names=["src", "dst"])


def similar_groups(chunks: DataFrame, group: str, vector: str, over: float = SIMILAR_OVER, block_rows: int = 4096, within: str | None = None, most_floats: int = PIVOT_FLOATS) -> DataFrame:
    """(src, dst, weight): pairs of groups whose best chunk similarity is over ``over``, src < dst.

    Exact. Rows go to the cell of their nearest pivot, and are lent to another cell only if the
    triangle inequality lets a row there be similar (see ``cells``); what meets is
    multiplied in blocks, of ``block_rows`` or of a twelfth of a large scope, and only pairs over the threshold leave a
    task. Vectors that cluster meet few others. Where all angles are alike, as with random
    vectors or a low threshold, every row meets every other: the products are quadratic in a
    scope's rows, what is shuffled is not. With ``within`` only rows that agree in that column meet, and rows without it don't. Null and empty vectors
    are similar to nothing, nor are vectors of unequal length. Pivots are at most
    ``most_floats`` numbers for each vector length; any pivots give the same result.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best_pairs(_Product(batches, over))

    placed = _celled(chunks, group, vector, over, block_rows, within, most_floats)
    pairs = placed.groupBy("s", "size", "cell", "i", "j").applyInArrow(multiply, "src string, dst string, weight double")
    return pairs.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def similar_classes(chunks: DataFrame, group: str, vector: str, over: float = SIMILAR_OVER, block_rows: int = 4096, within: str | None = None, most_floats: int = PIVOT_FLOATS) -> DataFrame:
    """(src, dst): links between groups with the components of ``similar_groups``, at most one for each row of a product.

    A product yields its classes and not its pairs, whose number is quadratic at a low threshold.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _forest(_Product(batches, over))

    placed = _celled(chunks, group, vector, over, block_rows, within, most_floats)
    return placed.groupBy("s", "size", "cell", "i", "j").applyInArrow(multiply, "src string, dst string").distinct()

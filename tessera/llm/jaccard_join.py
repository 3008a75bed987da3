"""Exact n-gram Jaccard join by grouped prefixes.

1. Every text's distinct 5-word shingles are hashed; texts with equal sets form a class.
2. A count sketch over all texts orders shingles from rare to frequent (ties by hash).
   Any order is correct; this one keeps passages that many texts share out of prefixes.
3. Two sets of Jaccard 0.75 or more share a shingle among the first n - ceil(0.75 n) + 1
   of each. Classes with the same prefix and size are one group with one leading class;
   postings hold groups only, and pairs of groups that meet on a prefix shingle must pass
   the size and position bounds.
4. Group pairs that are left are expanded to member classes and verified on their whole
   texts. First the leading classes of each posting's first group and of neighbours are
   linked, and each group's members to its leading class; the last round expands every
   group pair whose members lie in two components still, so no link between components
   is missed. Pairs inside one component are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._dense import SCHEMA, dense_rows, merge_dense
from tessera.llm._text import NON_SPACE, Words, as_long, blocks, mix, tidy
from tessera.llm._rows import KEYS, keyed, row_keys, side
from tessera.llm._skew import join_counted
from tessera.llm.components import extended_components
from tessera.session import Scratch

SHINGLE = 5
NUM, DEN = 3, 4  # similarity 0.75 as a fraction
SKETCH_BITS = 20
FIRSTS = 3  # firsts of postings that a group is compared with in round 1
ROUNDS, NEIGHBOURS = 1, 4  # rounds and neighbours in a posting that are tried before all pairs are
LARGE = 32  # postings of so many members try neighbours whatever their places
SIZE_STEP = 1.34  # sets of similarity 0.75 lie in the same or neighbouring powers of this size

_SALT = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(column, k: int):
    """Yield (row, sorted distinct shingle hashes) for each row of a column."""
    for lo, data, offs in blocks(column):
        words = Words(data, offs, NON_SPACE, True)
        grams, bounds, _ = words.grams(k)
        for i in range(len(words)):
            one = np.sort(grams[bounds[i] : bounds[i + 1]])
            yield lo + i, one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) else one


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set of shingles, its size mixed in."""
    return int(as_long(mix(np.array([mix(shingles ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)))[0])


def set_names(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The same names for all sets of a block, none of them empty."""
    sums = np.add.reduceat(mix(sets ^ _SALT), bounds[:-1]) if len(bounds) > 1 else np.zeros(0, np.uint64)
    return as_long(mix(sums + np.diff(bounds).astype(np.uint64)))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    shift = np.uint64(64 - bits)

    def count(batches):
        own = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, data, offs in blocks(batch.column(0)):
                own += np.bincount((Words(data, offs, NON_SPACE, True).grams(k)[0] >> shift).astype(np.int64), minlength=1 << bits)
        for part in pa.Table.from_pandas(dense_rows(np.minimum(own, 2**31 - 1).astype(np.uint32), TaskContext.get().partitionId()), preserve_index=False).to_batches():
            yield part.cast(pa.schema([("chunk", pa.int32()), ("lane", pa.int32()), ("data", pa.binary())]))

    return merge_dense(docs.select("text").mapInArrow(tidy(count), SCHEMA), 1 << bits, "uint32", "sum")


def name_classes(docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, n_shingles, class) of every document."""

    def name(batches):
        for batch in batches:
            ns, keys = [], []
            for _, one in shingle_sets(batch.column(2), k):
                ns.append(len(one))
                keys.append(set_key(one) if len(one) else None)
            if ns:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "text_key", "n_shingles", "class"])

    named = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return scratch.table(named.mapInArrow(tidy(name), "doc_id long, text_key long, n_shingles long, class long"), "classes")


def _sizes_hold(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (DEN * na >= NUM * nb) & (DEN * nb >= NUM * na)


def _places_hold(a: str, b: str) -> Column:
    """Whether the sets can be similar if their first common shingle stands at these places."""
    na, nb, at_a, at_b = (F.col(f"{x}.{y}") for y in ("n", "pos") for x in (a, b))
    least = F.ceil((F.lit(NUM) * (na + nb)) / F.lit(NUM + DEN))
    return 1 + F.least(na - at_a - 1, nb - at_b - 1) >= least


class Verifier:
    """Checks pairs of classes on their texts and collects the links."""

    def __init__(self, texts: DataFrame, k: int, scratch: Scratch, num: int = NUM, den: int = DEN):
        self.texts, self.k, self.scratch, self.least = texts, k, scratch, (num, den)

    def links(self, pairs: DataFrame) -> DataFrame:
        k, (num, den) = self.k, self.least

        def check(batches):
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                left = dict(shingle_sets(batch.column(2), k))
                for row, b in shingle_sets(batch.column(3), k):
                    a = left.pop(row)
                    both = np.concatenate([a, b])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[row] = den * common >= num * (len(both) - common)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep))

        b = self.texts.select(F.col("class").alias("dst"), F.col("text").alias("text_b"))
        a = self.texts.select(F.col("class").alias("src"), F.col("text").alias("text_a"))
        both = pairs.join(b, "dst").join(a, "src").select("src", "dst", "text_a", "text_b")
        return self.scratch.table(both.mapInArrow(tidy(check), "src long, dst long"), "links")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, first): components of documents linked at Jaccard 0.75.

    ``text_key`` is xxhash64 of the text; ``first`` marks the rows of one (id, text) of
    each component, the smallest.

    A row for each row of ``docs`` (doc_id, text). A text without words, or null, has no
    shingle and is its own component; one of fewer than ``k`` words has its sequence as
    its one shingle. Rows with equal ids take part each and share the smallest id of
    their links; a null id is kept and never the smallest unless alone. Other columns
    are ignored. Sets are compared by 64-bit shingle hashes.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    classes = name_classes(docs, k, scratch)
    full = classes.where(F.col("class").isNotNull())
    return document_components(classes, full, _class_components(docs, full, k, sketch_bits, scratch))


def document_components(classes: DataFrame, full: DataFrame, component: DataFrame) -> DataFrame:
    """Components of documents from those of their classes, ``component`` (class, component) where linked."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    by_class = full.groupBy("class").agg(F.min(own).alias("least"))
    named = by_class.join(component, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
    roots = named.groupBy("component").agg(F.min("least").alias("root"))
    named = named.join(roots, "component").select("class", "root")
    out = classes.join(named, "class", "left")
    alone = F.col("root").isNull()
    return out.select(
        "doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("root.doc_id")).alias("component_id"), (alone | F.col("root").eqNullSafe(own)).alias("first")
    )


def _class_components(docs: DataFrame, full: DataFrame, k: int, bits: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, k, bits))  # 2 ** bits counters
    reps = full.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"))
    extra = full.join(reps, "class").where(~F.struct("doc_id", "text_key").eqNullSafe(F.col("rep")))
    extra = scratch.table(row_keys(extra).distinct(), "copies")
    texts = keyed(docs)
    unique = texts.join(side(extra), list(KEYS), "left_anti")
    shift = np.uint64(64 - bits)

    def prefixes(batches):
        row_id = TaskContext.get().partitionId() << 36
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for row, one in shingle_sets(batch.column(2), k):
                key = set_key(one) if len(one) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                size = len(one)
                take = prefix_length(size)
                weight = sketch.value[(one >> shift).astype(np.int64)]
                if take < size:
                    edge = np.partition(weight, take - 1)[take - 1]
                    low = np.flatnonzero(weight <= edge)
                else:
                    low = np.arange(size)
                order = low[np.lexsort((one[low], weight[low]))][:take]
                first = one[order]
                rows.append((row_id, key, set_key(np.append(np.sort(first), np.uint64(size))), size, as_long(first)))
                row_id += 1
            if rows:
                ids, keys, groups, sizes, firsts = zip(*rows)
                flat = pa.array(np.concatenate(firsts))
                offs = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in firsts])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(groups, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offs, flat)], names=["row_id", "class", "grp", "n", "prefix"])

    held = unique.select(*KEYS, "text").mapInArrow(tidy(prefixes), "row_id long, class long, grp long, n long, prefix array<long>")
    held = scratch.table(held, "prefixes")
    named = held.select("row_id", "grp", "class", "n")
    lead = named.groupBy("grp").agg(F.min(F.struct("class", "row_id")).alias("lead"), F.count("*").alias("many"))
    members = named.join(lead, "grp").select(F.col("lead.class").alias("gid"), "class", "n", "row_id", (F.col("lead.row_id") == F.col("row_id")).alias("leads"), "many")
    members = scratch.table(members, "members")
    others = members.where("NOT leads").select("row_id")
    posts = held.join(side(others), "row_id", "left_anti").select("row_id", "n", F.posexplode("prefix").alias("pos", "shingle"))
    posts = posts.select("shingle", "row_id", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    posts = posts.repartition("shingle")  # one exchange for the count and the join below
    shared = posts.groupBy("shingle").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).where("a <> b").select("shingle")
    posts = posts.join(shared.hint("shuffle_hash"), "shingle").join(members.where("leads").select("row_id", "gid"), "row_id")
    posts = scratch.table(posts.select("shingle", "gid", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("pos")), "postings")
    sizes = scratch.table(posts.groupBy("gid").agg(F.count("*").alias("posts")), "met")
    # classes of groups that meet another group, or that have several members
    of_group = members.select("gid", "class", "many").distinct()
    of_group = scratch.table(of_group.join(sizes, "gid", "left").where("many > 1 OR posts IS NOT NULL").select("gid", "class"), "classes")
    wanted = scratch.table(row_keys(of_group.join(reps, "class").select("class", "rep.doc_id", "rep.text_key"), "class"), "wanted")
    texts = texts.select(*KEYS, "text").join(side(wanted), list(KEYS))
    texts = scratch.table(texts.groupBy("class").agg(F.first("text").alias("text")), "texts")
    scratch.drop(held)
    verifier = Verifier(texts, k, scratch)

    # round 1: the first group of each posting with every other, by leading class, and members with their own;
    # a group in postings of many firsts tries the smallest, and later rounds what is left
    first = posts.groupBy("shingle").agg(F.min(F.struct("gid", "n", "pos")).alias("a"))
    star = posts.select("shingle", F.struct("gid", "n", "pos").alias("b")).join(first, "shingle")
    inside = of_group.where("class <> gid").select(F.least("gid", "class").alias("src"), F.greatest("gid", "class").alias("dst"))
    tried = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    star = _group_pairs(star).withColumn("nth", tried).where(F.col("nth") <= FIRSTS).drop("nth")
    done = scratch.table(star.unionByName(inside), "pairs")
    component = extended_components(None, verifier.links(done), scratch)

    # middle rounds: neighbours of a posting that lie in two components, in a new order each time
    mixed = posts
    for turn in range(ROUNDS):
        mixed = scratch.table(_mixed(mixed, _spread(of_group, component, sizes, scratch)), "mixed")
        by = Window.partitionBy("shingle").orderBy("order", "gid")
        near = mixed.withColumn("order", F.xxhash64("gid", "shingle", F.lit(turn))).withColumn("b", F.struct("gid", "n", "pos", "lo", "hi"))
        near = near.withColumn("before", F.array(*[F.lag("b", i).over(by) for i in range(1, NEIGHBOURS + 1)])).withColumn("many", F.count("*").over(Window.partitionBy("shingle")))
        near = near.select("b", "many", F.explode("before").alias("a")).where("a.lo <> b.lo")
        new = scratch.table(_group_pairs(near, F.col("many") >= LARGE).join(done, ["src", "dst"], "left_anti"), "pairs")
        component = extended_components(component, verifier.links(new), scratch)
        done = done.unionByName(new)
        mixed = mixed.select("shingle", "gid", "n", "pos")

    # last round: all group pairs, and groups by themselves, with members in two components;
    # one of a pair has a member outside the posting's largest component
    spread = _spread(of_group, component, sizes, scratch)
    mixed = scratch.table(_mixed(mixed, spread), "mixed")
    parts = mixed.groupBy("shingle", "lo").agg(F.count("*").alias("many"))
    largest = parts.groupBy("shingle").agg(F.max(F.struct("many", "lo")).alias("top")).select("shingle", F.col("top.lo").alias("top"))
    bucket = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")
    entry = F.struct("gid", "n", "pos", "lo", "hi")
    minor = mixed.join(largest, "shingle").where("lo <> top OR hi <> top").select("shingle", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), entry.alias("a"))
    whole = mixed.select("shingle", bucket.alias("bucket"), entry.alias("b"))
    rest = minor.join(whole, ["shingle", "bucket"]).where("a.lo <> b.lo OR a.hi <> b.hi OR a.lo <> a.hi")
    rest = _group_pairs(rest).unionByName(spread.where("lo <> hi").select(F.col("gid").alias("src"), F.col("gid").alias("dst")))
    rest = scratch.table(_expanded(rest, of_group, component).join(done, ["src", "dst"], "left_anti"), "pairs")
    component = extended_components(component, verifier.links(rest), scratch)
    return component.select(F.col("node").alias("class"), F.col("root").alias("component"))


def _group_pairs(met: DataFrame, anywhere: Column | None = None) -> DataFrame:
    """Distinct pairs of groups (src < dst) of rows (a, b) that pass the bounds; ``anywhere``: sizes alone must fit."""
    placed = _places_hold("a", "b") if anywhere is None else _places_hold("a", "b") | anywhere
    met = met.where((F.col("a.gid") != F.col("b.gid")) & _sizes_hold("a", "b") & placed)
    return met.select(F.least("a.gid", "b.gid").alias("src"), F.greatest("a.gid", "b.gid").alias("dst")).distinct()


def _expanded(pairs: DataFrame, of_group: DataFrame, component: DataFrame) -> DataFrame:
    """Distinct pairs of classes (src < dst) in two components, of group pairs (src, dst)."""
    member = of_group.join(component.withColumnRenamed("node", "class"), "class", "left").select("gid", "class", F.coalesce("root", "class").alias("root"))
    a = member.select(F.col("gid").alias("src"), F.col("class").alias("a"), F.col("root").alias("of_a"))
    b = member.select(F.col("gid").alias("dst"), F.col("class").alias("b"), F.col("root").alias("of_b"))
    both = pairs.join(a, "src").join(b, "dst").where("of_a <> of_b")
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def _spread(of_group: DataFrame, component: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(gid, lo, hi, posts): least and largest component of each group's classes, and its number of postings."""
    member = of_group.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    found = member.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).join(sizes, "gid", "left")
    return scratch.table(found, "spread")


def _mixed(posts: DataFrame, spread: DataFrame) -> DataFrame:
    """Postings whose groups have members in more than one component, with each group's components."""
    labelled = join_counted(posts, spread.where("posts IS NOT NULL"), ["gid"], "posts").repartition("shingle")
    mixed = labelled.groupBy("shingle").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("shingle")
    return labelled.join(mixed.hint("shuffle_hash"), "shingle").select("shingle", "gid", "n", "pos", "lo", "hi")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""

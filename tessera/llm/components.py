"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._rows import side
from tessera.session import Scratch


def _is_stars(edge: DataFrame) -> bool:
    """Whether every node either points at one smaller node or is pointed at, and no node does both."""
    nodes = edge.select(F.col("hi").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edge.select(F.col("lo").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return nodes.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR out = 1 AND in = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst) but the roots; root is the smallest node reachable.

    Each round points neighbours at smaller nodes (large star), then nodes at their
    smallest neighbour (small star); rounds grow with the logarithm of the longest
    chain and end when the edges are stars, which is tested exactly. Minima are partial
    aggregates; the joins on a star's centre shuffle its edges, and adaptive execution splits
    a large one. Each round is written to the shared folder. Self edges count for nothing.
    """
    both = edges.where("src <> dst").select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    edge = scratch.table(both.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _is_stars(edge):
        nodes = edge.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(edge.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = nodes.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root"))
        large = nodes.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("root").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(least, "hi")
        small = small.select(F.col("hi"), F.col("root").alias("lo")).unionAll(small.where("lo > root").select(F.col("lo").alias("hi"), F.col("root").alias("lo")))
        new = scratch.table(small.distinct(), "edges")
        scratch.drop(edge)
        edge = new
    return edge.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def extended_components(component: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``component`` (node, root) after more ``links`` (src, dst).

    Links are rewritten to the roots that are known; those inside one component go, and rounds
    run on what is left, so links met before cost nothing again.
    """
    if component is None:
        return connected_components(links, scratch)
    ends = links.select("src", "dst")
    for end in ("src", "dst"):
        known = component.select(F.col("node").alias(end), F.col("root").alias("of"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    merged = connected_components(ends, scratch)
    new = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = component.join(side(new), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.table(moved.unionByName(merged), "components")

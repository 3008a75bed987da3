"""Entity resolution: components of a similarity graph, canonical vertices, communities."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Scratch

MERGE_AT = 0.85


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (src, dst).

    Labels jump to their neighbours' and to their label's label each round, so rounds
    grow with the logarithm of a chain's length; each round is written to the shared
    folder. Clustering with a minimum size of one is this very partition.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = scratch.table(both.where("src <> dst").distinct(), "edges")
    labels = scratch.table(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = scratch.table(step.join(jump, "component").select("id", "was", F.least("component", "root").alias("component")), "labels")
        if new.where("was <> component").isEmpty():
            return new.select("id", "component")
        scratch.drop(labels)
        labels = new.drop("was")
        labels._tessera_path = new._tessera_path


def similarity_edges(entities: DataFrame, vector: str, at_least: float = MERGE_AT, within: str | None = None) -> DataFrame:
    """(src, dst) pairs of entities (id) whose similarity is at least ``at_least``, of equal ``within`` if named."""
    from tessera.operators.similarity import similar_groups

    pairs = similar_groups(entities, "id", vector, over=at_least - 1e-12, within=within)
    kind = entities.schema["id"].dataType.simpleString()
    return pairs.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))


def similarity_links(entities: DataFrame, vector: str, at_least: float = MERGE_AT, within: str | None = None) -> DataFrame:
    """(src, dst) links with the components of ``similarity_edges``, of which there may be quadratically many."""
    from tessera.operators.similarity import similar_classes

    links = similar_classes(entities, "id", vector, over=at_least - 1e-12, within=within)
    kind = entities.schema["id"].dataType.simpleString()
    return links.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))


def canonicalise(entities: DataFrame, component: DataFrame) -> DataFrame:
    """One vertex a component: shortest name, most frequent type (smallest on ties), longest description.

    ``entities`` are (id, name, type, description); earlier ids win ties of length, blank
    types don't count, a component without types is 'Unknown'.
    """
    kinds = F.mode(F.when(F.col("type") != "", F.col("type")), True)
    joined = entities.join(component, "id")
    return joined.groupBy("component").agg(
        F.min_by("name", F.struct(F.length("name"), "id")).alias("name"),
        F.coalesce(kinds, F.lit("Unknown")).alias("type"),
        F.coalesce(F.max_by("description", F.struct(F.length("description"), -F.col("id"))), F.lit("")).alias("description"),
        F.count("*").alias("members"),
    )


def _weights(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, w): parallel edges summed, in both directions, without self loops."""
    both = edges.select(*keys, "src", "dst", F.lit(1.0).alias("w")).unionAll(edges.select(*keys, F.col("dst"), F.col("src"), F.lit(1.0)))
    return both.where("src <> dst").groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))


def label_propagation(edges: DataFrame) -> DataFrame:
    """(id, community): each vertex takes the heaviest label around it, the smallest on ties, until none changes.

    Seeded by ids. A vertex leaves its label only for a heavier one, or an equal one that is
    smaller. In a round only half of the vertices (by hash of id and round, so another half each
    time) may change, so that neighbours don't swap labels for ever.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    both = scratch.table(_weights(edges, []), "edges")
    labels = scratch.table(both.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct(), "labels")
    for turn in itertools.count():
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.max_by(F.struct("community", "w"), F.struct("w", -F.col("community"))).alias("best"))
        own = labels.join(votes.withColumnRenamed("src", "id"), ["id", "community"], "left").select("id", "community", F.coalesce("w", F.lit(0.0)).alias("own"))
        gain = (F.col("best.w") > F.col("own")) | ((F.col("best.w") == F.col("own")) & (F.col("best.community") < F.col("community")))
        moves = gain & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        step = own.join(best.withColumnRenamed("src", "id"), "id")
        new = scratch.table(step.select("id", F.when(moves, F.col("best.community")).otherwise(F.col("community")).alias("community"), gain.alias("wants")), "labels")
        scratch.drop(labels)
        labels = new.drop("wants")
        labels._tessera_path = new._tessera_path
        if new.where("wants").isEmpty():
            return labels


LEAST_GAIN = 1e-12
LANES = 2
MOST_LANES = 32


def louvain(edges: DataFrame, scope: str) -> DataFrame:
    """(scope, id, community) by modularity gains, within each scope (a pipeline's projected graph).

    Parallel edges are summed first. In a round every vertex looks for the neighbouring
    community of largest gain, by joins and aggregates. Those in the lane of the scope's best move (lanes
    by a hash of vertex and round) move, and a scope keeps the round if its own modularity rises; if not, it
    goes on with more and so smaller lanes, at last with its single best move, which always
    gains. A level ends for a scope when no vertex of it has a gain, whatever its lane; then
    communities become the vertices of the next level, until a level moves nothing. What a
    scope gets doesn't depend on the others. A community is named by its smallest vertex.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    graph = scratch.table(_weights(edges, [scope]), "edges")  # no self loops at the first level
    home = scratch.table(graph.select(scope, F.col("src").alias("id"), F.col("src").alias("node")).distinct(), "home")
    while True:
        node = graph.groupBy(scope, "src").agg(F.sum("w").alias("k")).withColumnRenamed("src", "node")
        total = graph.groupBy(scope).agg(F.sum("w").alias("m2"))
        node = _settled(graph, scratch.table(node.join(total, scope).withColumn("community", F.col("node")), "nodes"), scope, scratch)
        if node.where("community <> node").isEmpty():
            return home.select(scope, "id", F.col("node").alias("community"))
        names = node.groupBy(scope, "community").agg(F.min("node").alias("name"))
        named = scratch.table(node.join(names, [scope, "community"]).select(scope, "node", "name"), "names")
        home = scratch.table(home.join(named, [scope, "node"]).select(scope, "id", F.col("name").alias("node")), "home")
        src, dst = (named.select(scope, F.col("node").alias(x), F.col("name").alias(f"__{x}")) for x in ("src", "dst"))
        merged = graph.join(src, [scope, "src"]).join(dst, [scope, "dst"]).groupBy(scope, F.col("__src").alias("src"), F.col("__dst").alias("dst")).agg(F.sum("w").alias("w"))
        graph = scratch.table(merged, "edges")


def _settled(graph: DataFrame, node: DataFrame, scope: str, scratch: Scratch) -> DataFrame:
    """Nodes (scope, node, k, m2, community) after moves until none has a gain."""
    state = scratch.table(modularities(graph, node, scope).withColumns({"lanes": F.lit(LANES), "ended": F.lit(False)}), "scopes")
    for turn in itertools.count():
        wishes = scratch.table(_wishes(graph, node.join(state.drop("q"), scope), scope), "wishes")
        if wishes.where("wants").isEmpty():
            return wishes.select(scope, "node", "k", "m2", F.col("was").alias("community"))
        step = scratch.table(_moved(wishes, scope, turn), "nodes")
        tried = step.groupBy(scope).agg(F.max(F.col("community") != F.col("was")).alias("moved"))
        after = modularities(graph, step, scope).withColumnRenamed("q", "now").join(tried, scope)
        gains = F.col("moved") & (F.col("now") > F.col("q") + LEAST_GAIN)
        lost = F.col("moved") & ~gains
        found = state.join(after, scope).select(
            scope, F.when(gains, F.col("now")).otherwise(F.col("q")).alias("q"), gains.alias("gains"),
            F.when(gains, F.greatest(F.lit(LANES), F.floor(F.col("lanes") / 2).cast("int"))).when(lost, F.col("lanes") * 2).otherwise(F.col("lanes")).alias("lanes"), (F.col("ended") | lost & (F.col("lanes") > MOST_LANES)).alias("ended"),
        )
        state = scratch.table(found, "scopes")
        kept = step.join(state.select(scope, "gains"), scope)
        node = kept.select(scope, "node", "k", "m2", F.when(F.col("gains"), F.col("community")).otherwise(F.col("was")).alias("community"))
        state = state.drop("gains")


def modularities(graph: DataFrame, node: DataFrame, scope: str) -> DataFrame:
    """(scope, q): the modularity of each scope's communities, for edges (scope, src, dst, w) in both directions."""
    src, dst = (node.select(scope, F.col("node").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inside = graph.join(src, [scope, "src"]).join(dst, [scope, "dst"]).where("c_src = c_dst").groupBy(scope).agg(F.sum("w").alias("inside"))
    square = node.groupBy(scope, "community", "m2").agg(F.sum("k").alias("k")).groupBy(scope, "m2").agg(F.sum(F.pow(F.col("k") / F.col("m2"), F.lit(2.0))).alias("square"))
    return square.join(inside, scope, "left").select(scope, (F.coalesce(F.col("inside"), F.lit(0.0)) / F.col("m2") - F.col("square")).alias("q"))


def _wishes(graph: DataFrame, node: DataFrame, scope: str) -> DataFrame:
    """Nodes with ``was``, the community of largest gain, how much more it gains, and whether that is worth a move."""
    size = node.groupBy(scope, "community").agg(F.sum("k").alias("held"))
    near = node.select(scope, F.col("node").alias("dst"), "community")
    links = graph.where("src <> dst").join(near, [scope, "dst"]).groupBy(scope, F.col("src").alias("node"), "community").agg(F.sum("w").alias("w"))
    options = links.join(size, [scope, "community"]).join(node.select(scope, "node", "k", "m2", F.col("community").alias("own")), [scope, "node"])
    rest = F.col("held") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    options = options.withColumn("gain", F.col("w") - F.col("k") * rest / F.col("m2"))
    best = options.groupBy(scope, "node").agg(
        F.max_by(F.struct("community", "gain"), F.struct("gain", -F.col("community"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("linked")
    )
    joined = node.join(size, [scope, "community"]).join(best, [scope, "node"], "left")
    stay = F.coalesce("linked", -F.col("k") * (F.col("held") - F.col("k")) / F.col("m2"))
    joined = joined.withColumn("more", F.col("best.gain") - stay)
    wants = F.coalesce((2 * F.col("more") / F.col("m2") > 4 * LEAST_GAIN) & ~F.col("ended"), F.lit(False))
    return joined.select(scope, "node", "k", "m2", "lanes", F.col("community").alias("was"), F.col("best.community").alias("best"), "more", wants.alias("wants"))


def _moved(wishes: DataFrame, scope: str, turn: int) -> DataFrame:
    """Nodes with their community before (``was``) and after the moves of the lane whose turn it is."""
    single = wishes.where("wants").groupBy(scope).agg(F.max_by("node", F.struct("more", -F.col("node"))).alias("single"))
    joined = wishes.join(single, scope, "left")
    lane = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.col("lanes"))
    turns = F.when(F.col("lanes") > MOST_LANES, F.col("node") == F.col("single")).otherwise(lane("node") == lane("single"))
    moves = F.col("wants") & F.coalesce(turns, F.lit(False))
    return joined.select(scope, "node", "k", "m2", "was", F.when(moves, F.col("best")).otherwise(F.col("was")).alias("community"))


def community_summaries(members: DataFrame, least: int = 3, most_names: int = 50) -> DataFrame:
    """(community, name, size, names): communities of at least 3, first 50 names in order, '...' when there are more."""
    names = F.array_sort(F.collect_list("name"))
    out = members.groupBy("community").agg(names.alias("all"), F.count("*").alias("size")).where(F.col("size") >= least)
    text = F.concat(F.array_join(F.slice("all", 1, most_names), ", "), F.when(F.col("size") > most_names, "...").otherwise(""))
    return out.select("community", F.concat(F.lit("Sector "), F.col("community").cast("string")).alias("name"), "size", text.alias("names"))


def chunk_ordinals(rows: DataFrame, group: str, order: str) -> DataFrame:
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)

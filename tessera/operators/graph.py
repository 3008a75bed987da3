"""Property-graph operators over vertex and edge tables.

Vertices are (id, name, type, ...); edges are (src, dst, type, ...). Every operator is a
plan of joins and aggregates; endpoints are matched by equi-joins whose small side
Spark broadcasts only under its own size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relational import keep_first
from tessera.sources.keyed_store import KeyedStore

#: Fixed values.
COMPANY_TYPES = ("Company", "Startup", "Incumbent", "Utility", "Investor")
REGULATORY = "(?i)^(?:.*regul.*|.*law.*|.*gov.*|.*polic.*|.*act.*|.*bill.*)$"
TOP_EDGES = 2500
SUPERNODE_DEGREE = 50
BRIDGE_DOCS = (2, 15)


def stable_id(*parts: Column) -> Column:
    """A surrogate id that doesn't depend on partitions or order."""
    return F.xxhash64(*parts)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, a self loop once."""
    swapped = edges.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped)


def resolve_edges(raw: DataFrame, resolves: DataFrame) -> DataFrame:
    """Raw relationships between canonical vertices: both endpoints replaced through ``resolves`` (raw, canonical)."""
    src = resolves.select(F.col("raw").alias("src"), F.col("canonical").alias("__s"))
    dst = resolves.select(F.col("raw").alias("dst"), F.col("canonical").alias("__t"))
    return raw.join(src, "src").join(dst, "dst").drop("src", "dst").withColumnsRenamed({"__s": "src", "__t": "dst"})


def collapse_edges(raw: DataFrame, resolves: DataFrame, evidence: bool = False) -> DataFrame:
    """One weighted edge for each (src, dst, type) between different vertices, with non-blank quotes and urls, sorted."""
    text = lambda c: F.array_sort(F.filter(F.collect_list(c), lambda q: q.isNotNull() & (q != "")))
    cols = [F.count("*").alias("weight"), text("quote").alias("quotes"), text("url").alias("source_urls")]
    if evidence:
        cols.append(F.array_sort(F.collect_list(F.struct("quote", "url"))).alias("evidence"))
    return resolve_edges(raw, resolves).where("src <> dst").groupBy("src", "dst", "type").agg(*cols)


def edge_weights(raw: DataFrame, resolves: DataFrame) -> DataFrame:
    """(src, dst, type, weight) between different vertices: ``collapse_edges`` without the evidence, so no row grows with an edge."""
    return resolve_edges(raw, resolves).where("src <> dst").groupBy("src", "dst", "type").agg(F.count("*").alias("weight"))


def edge_counts(raw: DataFrame, resolves: DataFrame) -> DataFrame:
    """Weight of each (src, dst, type), self loops kept: the export's edges."""
    return resolve_edges(raw, resolves).groupBy("src", "dst", "type").agg(F.count("*").alias("weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Incident edges of every vertex, 0 where there are none; a self loop counts once."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("id")))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def supernodes(vertices: DataFrame, edges: DataFrame, most: int = SUPERNODE_DEGREE) -> DataFrame:
    """Vertices of more than ``most`` incident edges, those of highest degree first."""
    return degrees(vertices, edges).where(F.col("degree") > most).orderBy(F.desc("degree"), "id")


def detach_delete(vertices: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the doomed vertices (id)."""
    gone = doomed.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.select(*edges.columns)


def prune_supernodes(vertices: DataFrame, edges: DataFrame, verdict, most: int = SUPERNODE_DEGREE) -> tuple[DataFrame, DataFrame]:
    """Delete the supernodes that the verdict (column expression of name and type) condemns."""
    return detach_delete(vertices, edges, supernodes(vertices, edges, most).where(verdict(F.col("name"), F.col("type"))))


def named_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the names and types of both ends."""
    s = vertices.select(F.col("id").alias("src"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    t = vertices.select(F.col("id").alias("dst"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return edges.withColumnRenamed("type", "rel_type").join(s, "src").join(t, "dst")


def _top(edges: DataFrame, limit: int) -> DataFrame:
    keys = [F.desc_nulls_first("weight"), *(F.asc_nulls_first(c) for c in ("src", "dst", "rel_type"))]
    return edges.orderBy(*keys).limit(limit)


def theme_full(edges: DataFrame, vertices: DataFrame, limit: int = TOP_EDGES) -> DataFrame:
    """The heaviest directed edges."""
    return _top(named_edges(edges, vertices), limit)


def theme_companies(edges: DataFrame, vertices: DataFrame, limit: int = TOP_EDGES) -> DataFrame:
    """The heaviest edges, in both directions, with a company at either end."""
    both = named_edges(undirected(edges), vertices)
    return _top(both.where(F.col("source_type").isin(*COMPANY_TYPES) | F.col("target_type").isin(*COMPANY_TYPES)), limit)


def theme_regulatory(edges: DataFrame, vertices: DataFrame, limit: int = TOP_EDGES) -> DataFrame:
    """The heaviest edges, in both directions, between a regulatory vertex and a company."""
    both = named_edges(undirected(edges), vertices)
    law, firm = (lambda c: F.col(c).rlike(REGULATORY)), (lambda c: F.col(c).isin(*COMPANY_TYPES))
    return _top(both.where((law("source_type") & firm("target_type")) | (law("target_type") & firm("source_type"))), limit)


def bridge_entities(mentions: DataFrame) -> DataFrame:
    """Entities mentioned by 2 to 15 documents."""
    counts = mentions.distinct().groupBy("entity").agg(F.count("*").alias("docs"))
    return counts.where(F.col("docs").between(*BRIDGE_DOCS)).select("entity")


def theme_documents(documents: DataFrame, similar: DataFrame, mentions: DataFrame, vertices: DataFrame, limit: int = TOP_EDGES) -> DataFrame:
    """Every document with its similar documents and bridge entities; isolated ones have a null edge of weight 0.5."""
    docs = documents.select(F.col("id").alias("src"), F.coalesce("title", "url").alias("source_name"))
    name = lambda c: documents.select(F.col("id").alias("dst"), F.coalesce("title", "url").alias("target_name"), F.lit("Document").alias("target_type"))
    to_docs = undirected(similar.select("src", "dst", "weight")).join(name("dst"), "dst").select("src", "dst", "target_name", "target_type", F.lit("SIMILAR_TO").alias("rel_type"), "weight")
    bridges = mentions.distinct().join(bridge_entities(mentions), "entity")
    ents = vertices.select(F.col("id").alias("entity"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    to_ents = bridges.join(ents, "entity").select(F.col("document").alias("src"), F.col("entity").alias("dst"), "target_name", "target_type", F.lit("MENTIONS").alias("rel_type"), F.lit(0.5).alias("weight"))
    out = docs.join(to_docs.unionByName(to_ents), "src", "left").withColumn("weight", F.coalesce("weight", F.lit(0.5)))
    return _top(out, limit)


def theme_nodes(edges: DataFrame) -> DataFrame:
    """Distinct vertices of a theme's edges."""
    ends = edges.select(F.col("src").alias("id"), F.col("source_name").alias("name"), F.col("source_type").alias("type"))
    ends = ends.unionByName(edges.where("dst IS NOT NULL").select(F.col("dst").alias("id"), F.col("target_name").alias("name"), F.col("target_type").alias("type")))
    return keep_first(ends, ["id"], [F.col("name"), F.col("type")])


def ego_entity(vertices: DataFrame, edges: DataFrame, centre) -> DataFrame:
    """A vertex and its edges either way, one for each (source, target, type); one null row if it has none."""
    mid = vertices.where(F.col("id") == F.lit(centre)).select(F.col("id").alias("central_id"), F.col("name").alias("central_name"))
    out = edges.where(F.col("src") == F.lit(centre)).select("src", "dst", "type", "weight", F.col("dst").alias("neighbour"), F.lit(True).alias("is_outgoing"))
    back = edges.where((F.col("dst") == F.lit(centre)) & (F.col("src") != F.lit(centre))).select("src", "dst", "type", "weight", F.col("src").alias("neighbour"), F.lit(False).alias("is_outgoing"))
    near = keep_first(out.unionByName(back), ["src", "dst", "type"], [F.col("weight").isNull(), -F.col("weight")])
    names = vertices.select(F.col("id").alias("neighbour"), F.col("name").alias("neighbour_name"), F.col("type").alias("neighbour_type"))
    found = near.join(names, "neighbour").withColumn("central_id", F.lit(centre))
    return mid.join(found, "central_id", "left").select("central_id", "central_name", "neighbour", "neighbour_name", "neighbour_type", F.col("type").alias("rel_type"), "weight", "is_outgoing")


def store_edges(spark: SparkSession, edges: DataFrame, root: str, buckets: int = 64) -> KeyedStore:
    """A stored table of weighted edges, each filed under both of its ends, for point reads."""
    kind = edges.schema["src"].dataType.simpleString()
    store = KeyedStore(spark, root, f"id {kind}, other {kind}, is_outgoing boolean, type string, weight double", ["id", "other", "is_outgoing", "type"], bucket_by=["id"], buckets=buckets)
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("is_outgoing"), "type", F.col("weight").cast("double").alias("weight"))
    back = edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("is_outgoing"), "type", F.col("weight").cast("double").alias("weight"))
    store.upsert(out.unionByName(back), ["weight"])
    return store


def ego_stored(vertices: DataFrame, store: KeyedStore, centre) -> DataFrame:
    """As ``ego_entity``, from a table made by ``store_edges``: the files of one bucket are opened."""
    mid = vertices.where(F.col("id") == F.lit(centre)).select(F.col("id").alias("central_id"), F.col("name").alias("central_name"))
    near = store.get(id=centre).select(F.col("other").alias("neighbour"), F.col("type").alias("rel_type"), F.col("weight").cast("long").alias("weight"), "is_outgoing")
    names = vertices.select(F.col("id").alias("neighbour"), F.col("name").alias("neighbour_name"))
    found = near.join(names, "neighbour").withColumn("central_id", F.lit(centre))
    return mid.join(found, "central_id", "left").select("central_id", "central_name", "neighbour", "neighbour_name", "rel_type", "weight", "is_outgoing")


def ego_document(documents: DataFrame, similar: DataFrame, mentions: DataFrame, vertices: DataFrame, centre) -> DataFrame:
    """A document's similar documents and mentioned entities, each side on its own (no product of the two)."""
    near = undirected(similar.select("src", "dst", "weight")).where(F.col("src") == F.lit(centre)).select(F.col("dst").alias("id"), "weight").dropDuplicates(["id"])
    near = near.join(documents.select("id", F.coalesce("title", "url").alias("name")), "id").select("id", "name", F.lit("Document").alias("type"), F.lit("SIMILAR_TO").alias("rel_type"), "weight")
    said = mentions.where(F.col("document") == F.lit(centre)).select(F.col("entity").alias("id")).distinct()
    said = said.join(vertices.select("id", "name", "type"), "id").select("id", "name", "type", F.lit("MENTIONS").alias("rel_type"), F.lit(0.5).alias("weight"))
    return near.unionByName(said)


def document_vertices(chunks: DataFrame, url: str, title: str, keys: list[str]) -> DataFrame:
    """One vertex for each URL, typed by its extension; the smallest title stands."""
    from tessera.functions.text import url_kind

    return chunks.where(F.col(url).isNotNull()).groupBy(*keys, url).agg(F.min(title).alias("title")).withColumn("type", url_kind(F.col(url)))


def mention_edges(raw_entities: DataFrame, raw_links: DataFrame, resolves: DataFrame) -> DataFrame:
    """(document, entity): provenance of entities and of both ends of relationships.

    Links are dealt over all tasks before their ends are resolved, so that no task holds the pairs of
    many link partitions, which are small only while they are shuffled.
    """
    own = raw_entities.where("url IS NOT NULL").select(F.col("url").alias("document"), "raw")
    ends = raw_links.where("url IS NOT NULL").select(F.col("url").alias("document"), F.explode(F.array("src", "dst")).alias("raw"))
    parts = int(raw_links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(ends).repartition(parts, "document", "raw")
    return dealt.join(resolves, "raw").select("document", F.col("canonical").alias("entity")).distinct()


def export_nodes(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("Id"), F.col("name").alias("Label"), F.col("type").alias("EntityType"))


def export_edges(raw: DataFrame, resolves: DataFrame) -> DataFrame:
    out = edge_counts(raw, resolves)
    return out.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.lit("Directed").alias("Type"), F.col("type").alias("Label"), F.col("weight").alias("Weight"))


def write_export(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write nodes and edges as CSV part files with headers."""
    nodes.write.mode("overwrite").csv(f"{folder}/nodes", header=True)
    edges.write.mode("overwrite").csv(f"{folder}/edges", header=True)


def upsert_companies(vertices: DataFrame, found: DataFrame, facts: list[str]) -> DataFrame:
    """Vertices (id, pipeline_id, name, type, facts) with companies' facts merged in.

    A found company (pipeline_id, name, type, facts; one row a name) fills every vertex of
    that name and pipeline whose type is a company type, its facts winning where they are
    not null; one that no such vertex has becomes a new vertex.
    """
    keys, firm = ["pipeline_id", "name"], F.col("type").isin(*COMPANY_TYPES)
    new = found.select(*keys, F.lit(True).alias("__met"), *[F.col(c).alias(f"__{c}") for c in facts])
    merged = vertices.join(new, keys, "left").withColumn("__met", F.coalesce("__met", F.lit(False)) & firm)
    merged = merged.select("id", *keys, "type", *[F.when(F.col("__met"), F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) for c in facts])
    created = found.join(vertices.where(firm).select(*keys).distinct(), keys, "left_anti")
    return merged.unionByName(created.select(stable_id(F.lit("company"), *keys).alias("id"), *keys, "type", *facts))


def highlight_set(edges: DataFrame, centre) -> DataFrame:
    """Ids of a vertex and of its neighbours either way."""
    touching = edges.where((F.col("src") == F.lit(centre)) | (F.col("dst") == F.lit(centre)))
    return touching.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def counts_by_type(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """One row with the number of edges of each listed type."""
    return edges.agg(*[F.count_if(F.col("type") == kind).alias(kind) for kind in kinds])


def edge_evidence(raw: DataFrame, resolves: DataFrame) -> DataFrame:
    """(src, dst, type, place, quote, url): the evidence of each collapsed edge in order, a row a raw relationship.

    Rows are ranked as they are, by a sort that spills, so an edge of much evidence is no row of unbounded size.
    """
    ends = resolve_edges(raw, resolves).where("src <> dst")
    at = F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy("quote", "url")) - 1
    return ends.select("src", "dst", "type", at.alias("place"), "quote", "url")


def evidence_rows(edges: DataFrame) -> DataFrame:
    """(src, dst, type, place, quote, url): each edge's evidence in order, one row a quote with its own url."""
    return edges.select("src", "dst", "type", F.posexplode("evidence").alias("place", "e")).select("src", "dst", "type", "place", "e.quote", "e.url")


def all_properties(vertices: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, properties): all columns of each vertex as one JSON object; nulls are left out."""
    return vertices.select(id_col, F.to_json(F.struct(*vertices.columns)).alias("properties"))


def belongs_to(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """(src, dst, type): membership edges of the communities that have a summary."""
    kept = members.join(summaries.select("community"), "community", "left_semi")
    return kept.select(F.col("id").alias("src"), F.col("community").alias("dst"), F.lit("BELONGS_TO").alias("type"))

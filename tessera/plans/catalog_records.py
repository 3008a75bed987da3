"""Catalogue queries of sinks, mutations, records, events and served shapes, each with its SQL.

Stand-ins as in ``catalog``; these queries are added to its registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import records, text
from tessera.operators import graph, relational, resolve
from tessera.plans import workflow
from tessera.plans.catalog import _COS, _FIRM, _GRAPH, _nation_graph, query
from tessera.sources.connectors import queued_site, table
from tessera.streaming import events as stream

# sinks and mutations


@query("SELECT doc_id, source, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id + 1000000, source || '-new', text FROM documents WHERE doc_id % 3 = 0")
def append_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    new = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("source", F.lit("-new")).alias("source"), "text")
    return relational.append(docs.where("doc_id % 3 <> 0"), new)


@query("SELECT 'site-b' AS site, source, doc_id AS copied_from, length(text) AS size FROM documents WHERE source IN (SELECT 'src' || c_custkey FROM customer) UNION ALL SELECT 'miss', 'src' || c_custkey, NULL, NULL FROM customer WHERE 'src' || c_custkey NOT IN (SELECT source FROM documents)")
def copy_on_hit(spark: SparkSession, d: str) -> DataFrame:
    cached = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").alias("copied_from"), F.length("text").alias("size"))
    wanted = table(spark, d, "customer").select(F.concat(F.lit("src"), "c_custkey").alias("source"))
    copies, misses = relational.copy_on_hit(cached, wanted, "source", "doc_id", site=F.lit("site-b"))
    if copies.select("doc_id").distinct().count() != copies.count():
        raise ValueError("copies share an id")
    return copies.select("site", "source", "copied_from", "size").unionByName(misses.select(F.lit("miss").alias("site"), "source"), allowMissingColumns=True)


@query("SELECT min(n_name) AS name, count(*) AS wanted FROM (SELECT n_name, lower(n_name) AS k FROM nation UNION ALL SELECT upper(n_name), lower(n_name) FROM nation UNION ALL SELECT 'New_' || (c_custkey % 5), 'new_' || (c_custkey % 5) FROM customer) GROUP BY k")
def unique_insert_folding_case(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    new = table(spark, d, "customer").select(F.concat(F.lit("New_"), (F.col("c_custkey") % 5).cast("string")).alias("name"))
    asked = have.select(F.upper("name").alias("name")).unionByName(new)
    made = relational.get_or_create(have, asked, ["name"], fold_case=True)
    counts = have.unionByName(asked).groupBy(F.lower("name").alias("k")).agg(F.count("*").alias("wanted"))
    return made.join(counts, F.lower(made.name) == counts.k).select("name", "wanted")


@query("SELECT bucket, pipeline FROM (SELECT DISTINCT p_brand AS bucket, p_size % 3 AS pipeline FROM part)")
def micro_bucket_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("bucket"), (F.col("p_size") % 3).alias("pipeline"))
    first = relational.get_or_create(relational.emptied(rows), rows.where("pipeline < 2"), ["bucket", "pipeline"])
    return relational.get_or_create(first, rows, ["bucket", "pipeline"])


@query(
    f"""WITH v AS (SELECT p_partkey AS id, p_size % 2 AS pipeline_id, p_name AS name, ['Startup', 'Person', 'Utility'][p_partkey % 3 + 1] AS type, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS stage, CAST(p_size AS VARCHAR) AS size FROM part),
f AS (SELECT p_size % 2 AS pipeline_id, p_name AS name, max(p_type) AS stage FROM part WHERE p_size < 20 GROUP BY 1, 2 UNION ALL SELECT 0, s_name, 'new' FROM supplier)
SELECT v.pipeline_id, v.name, type, CASE WHEN f.name IS NOT NULL AND type IN {_FIRM} THEN coalesce(f.stage, v.stage) ELSE v.stage END AS stage, size FROM v LEFT JOIN f ON v.pipeline_id = f.pipeline_id AND v.name = f.name
UNION ALL SELECT pipeline_id, name, 'Company', stage, NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pipeline_id = f.pipeline_id AND v.name = f.name AND type IN {_FIRM})"""
)
def company_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.element_at(F.array(F.lit("Startup"), F.lit("Person"), F.lit("Utility")), (F.col("p_partkey") % 3 + 1).cast("int"))
    v = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).alias("pipeline_id"), F.col("p_name").alias("name"), kind.alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("stage"), F.col("p_size").cast("string").alias("size"))
    found = p.where("p_size < 20").groupBy((F.col("p_size") % 2).alias("pipeline_id"), F.col("p_name").alias("name")).agg(F.max("p_type").alias("stage"))
    found = found.unionByName(table(spark, d, "supplier").select(F.lit(0).alias("pipeline_id"), F.col("s_name").alias("name"), F.lit("new").alias("stage")))
    found = found.select("pipeline_id", "name", F.lit("Company").alias("type"), "stage", F.lit(None).cast("string").alias("size"))
    return graph.upsert_companies(v, found, ["stage", "size"]).select("pipeline_id", "name", "type", "stage", "size")


_META = "'{\"source_url\":\"' || source || '\"' || CASE WHEN doc_id % 4 = 0 THEN ',\"storage_object\":\"old\"' ELSE '' END || '}'"


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    stored = F.when(F.col("doc_id") % 4 == 0, F.lit(',"storage_object":"old"')).otherwise(F.lit(""))
    return table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit('{"source_url":"'), "source", F.lit('"'), stored, F.lit("}")).alias("meta"))


@query(f"SELECT doc_id, source AS source_url, CASE WHEN source = 'src1' THEN 'obj/src1' WHEN doc_id % 4 = 0 THEN 'old' END AS storage_object FROM (SELECT *, {_META} AS meta FROM documents)")
def json_field_set(spark: SparkSession, d: str) -> DataFrame:
    rows = _metadata(spark, d)
    rows = rows.withColumn("meta", F.when(F.col("source") == "src1", records.set_field(F.col("meta"), "storage_object", F.concat(F.lit("obj/"), "source"))).otherwise(F.col("meta")))
    return rows.select("doc_id", records.metadata_field(F.col("meta"), "source_url").alias("source_url"), records.metadata_field(F.col("meta"), "storage_object").alias("storage_object"))


@query("SELECT doc_id FROM documents WHERE source IS NOT NULL AND doc_id % 4 <> 0")
def json_key_presence(spark: SparkSession, d: str) -> DataFrame:
    rows = _metadata(spark, d)
    return rows.where(records.has_field(F.col("meta"), "source_url") & ~records.has_field(F.col("meta"), "storage_object")).select("doc_id")


@query("SELECT conv_id, arg_min(text, turn) FILTER (WHERE text IS NOT NULL AND turn % 3 <> 0) AS object FROM conversations GROUP BY conv_id")
def first_stored_object(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("object"))
    return relational.first_non_null(rows, ["conv_id"], "object", "turn")


@query("SELECT 'left' AS what, count(*) FILTER (WHERE NOT coalesce(o_totalprice < 60000, false)) AS n FROM orders UNION ALL SELECT 'deleted', count(*) FILTER (WHERE o_totalprice < 60000) FROM orders UNION ALL SELECT 'cleared', count(o_orderpriority) FROM orders UNION ALL SELECT 'emptied', 0")
def mutation_counters(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    kept, deleted = relational.delete_counted(orders, F.col("o_totalprice") < 60000)
    cleared, removed = relational.without_property(orders, "o_orderpriority")
    row = lambda df, what, n: df.select(F.lit(what).alias("what"), F.col(n).alias("n"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    out = row(count(kept), "left", "n").unionByName(row(deleted, "deleted", "deleted")).unionByName(row(removed, "cleared", "removed"))
    return out.unionByName(row(count(relational.emptied(cleared)), "emptied", "n"))


# records


@query("SELECT doc_id, lang || '/' || source || '/' || n_chars AS tags, CAST(doc_id AS VARCHAR) AS id, n_chars AS size, 0 AS pages, '[]' AS parts_json FROM documents")
def flattened_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    record = F.struct(
        F.struct(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("int").alias("pages"), F.col("n_chars").alias("size")).alias("file"),
        F.array("lang", "source", F.col("n_chars").cast("string")).alias("tags"), F.lit(None).cast("array<struct<a:int>>").alias("parts"),
    )
    flat = records.flatten_record(docs.select("doc_id", record.alias("r")), "r")
    return flat.select("doc_id", F.array_join("tags", "/").alias("tags"), F.col("file_id").alias("id"), F.col("file_size").alias("size"), F.col("file_pages").alias("pages"), "parts_json")


@query("SELECT doc_id, source AS plain, source AS quoted, lang AS founder, CAST(n_chars AS DOUBLE) AS score FROM documents")
def metadata_either_way(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    meta = F.to_json(F.struct(F.col("source").alias("source_url")))
    rows = docs.select("doc_id", meta.alias("meta"), F.concat(F.lit('"'), F.replace(meta, F.lit('"'), F.lit('\\"')), F.lit('"')).alias("quoted"), F.to_json(F.array(F.struct(F.col("lang").alias("name")))).alias("founders"), F.to_json(F.create_map(F.lit("s"), F.col("n_chars"))).alias("scores"))
    return rows.select(
        "doc_id", records.metadata_field(F.col("meta"), "source_url").alias("plain"), records.metadata_field(F.col("quoted"), "source_url").alias("quoted"),
        records.parse_founders(F.col("founders"))[0]["name"].alias("founder"), records.parse_scores(F.col("scores"))["s"].alias("score"),
    )


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, substr(o_orderpriority, 1, 3) || '...' AS snippet, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders")
def api_records(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("id"), text.snippet(F.col("o_orderpriority"), 3, always=True).alias("snippet"), records.iso_time(F.col("o_orderdate")).alias("created_at"))


@query("SELECT n_nationkey, list_aggregate(CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'x'] ELSE [n_name, 'x', 'y'] END, 'string_agg', ',') AS items FROM nation")
def set_add(spark: SparkSession, d: str) -> DataFrame:
    items = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.lit("x"))).otherwise(F.array("n_name", F.lit("x"), F.lit("y")))
    again = records.add_once(records.add_once(items, F.col("n_name")), F.lit("x"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(again, ",").alias("items"))


@query("SELECT doc_id, substr(translate(text, chr(10), ' '), 1, 150) AS flat, substr(text, 1, 15000) AS cut, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN text WHEN 2 THEN substr(text, 1, 40) END AS goes_on, CASE doc_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'processing' WHEN 2 THEN 'processing' ELSE 'pending' END AS status, CAST(least(pow(2, doc_id % 9), 60) AS BIGINT) AS wait FROM documents")
def text_cuts_and_routing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    action = F.element_at(F.array(F.lit("skip"), F.lit("extract_all"), F.lit("extract_partial"), F.lit("keep")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(
        "doc_id", text.prefix(text.flat_text(F.col("text")), 150).alias("flat"), text.prefix(F.col("text")).alias("cut"), text.pending_text(action, F.col("text"), F.lit(40)).alias("goes_on"),
        text.pending_status(action).alias("status"), text.backoff_seconds(F.col("doc_id") % 9).alias("wait"),
    )


@query(
    "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'proxy' WHEN page_id % 5 = 0 THEN 'pdf' WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN page_id % 5 = 1 OR lower(url) LIKE '%.docx' THEN 'docx' WHEN page_id % 5 = 2 OR lower(url) LIKE '%.pptx' THEN 'pptx' WHEN page_id % 5 = 3 OR lower(url) LIKE '%.csv' OR lower(url) LIKE '%.xlsx' THEN 'spreadsheet' ELSE 'html' END AS reader FROM pages"
)
def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["application/PDF", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "text/csv", "text/html"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", text.format_of(kind, F.col("url"), F.col("page_id") % 7 == 0).alias("reader"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations")
def chunk_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return resolve.chunk_ordinals(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").withColumn("chunk_index", F.col("chunk_index").cast("long"))


# graph


@query(_GRAPH + "SELECT id, name, type, CASE WHEN type = 'Startup' THEN '#f97316' WHEN type = 'Utility' THEN '#0ea5e9' WHEN type = 'Regulator' THEN '#eab308' WHEN type = 'Contractor' THEN '#eab308' ELSE '#a855f7' END AS colour, 2.0 AS size FROM vert")
def node_styles(spark: SparkSession, d: str) -> DataFrame:
    vertices = _nation_graph(spark, d)[2]
    return vertices.select("id", "name", "type", text.colour(F.col("type")).alias("colour"), text.node_size(F.col("type"), "full").alias("size"))


@query(_GRAPH + "SELECT DISTINCT unnest([src, dst]) AS id FROM col WHERE src = 3 OR dst = 3")
def highlight_set(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    return graph.highlight_set(graph.edge_counts(raw, resolves).where("src <> dst"), 3)


@query(_GRAPH + "SELECT count(*) FILTER (WHERE type = 'A') AS \"A\", count(*) FILTER (WHERE type = 'R') AS \"R\", count(*) FILTER (WHERE type = 'none') AS none FROM col")
def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    return graph.counts_by_type(graph.edge_counts(raw, resolves).where("src <> dst"), ["A", "R", "none"])


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT DISTINCT event_type, 0 FROM events")
def sources_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type")
    chosen = e.where("event_type = 'click'").groupBy("event_type").agg(F.count("*").alias("n"))
    return chosen.unionByName(e.distinct().withColumn("n", F.lit(0).cast("long")))


@query(_GRAPH + "SELECT src, dst, type, CAST(row_number() OVER (PARTITION BY src, dst, type ORDER BY quote, url) - 1 AS INTEGER) AS place, quote, url FROM ends WHERE src <> dst")
def evidence_zip(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    return graph.edge_evidence(raw, resolves)


@query(_GRAPH + "SELECT id, json_extract_string(p, '$.name') AS name, json_extract_string(p, '$.type') AS type FROM (SELECT id, json_object('id', id, 'name', name, 'type', type) AS p FROM vert)")
def vertex_properties(spark: SparkSession, d: str) -> DataFrame:
    held = graph.all_properties(_nation_graph(spark, d)[2])
    return held.select("id", F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.type").alias("type"))


@query(_GRAPH + "SELECT DISTINCT 'p' || o_orderpriority AS document, s_nationkey AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey UNION SELECT DISTINCT 'p' || o_orderpriority, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey UNION SELECT DISTINCT 'q' || s_nationkey % 3, s_nationkey FROM supplier")
def mentions_of_entities_and_ends(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.concat(F.lit("p"), "o_orderpriority").alias("url"))
    own = table(spark, d, "supplier").select(F.concat(F.lit("q"), (F.col("s_nationkey") % 3).cast("string")).alias("url"), F.concat(F.lit("s"), "s_suppkey").alias("raw"))
    return graph.mention_edges(own, links, resolves)


@query("WITH m AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS community FROM customer UNION ALL SELECT s_suppkey, s_name, 100 + s_suppkey % 50 FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY name) AS k, count(*) OVER (PARTITION BY community) AS size FROM m) SELECT community, 'Sector ' || community AS name, size, string_agg(CASE WHEN k <= 50 THEN n.name END, ', ' ORDER BY k) || CASE WHEN size > 50 THEN '...' ELSE '' END AS names, count(*) AS edges FROM n WHERE size >= 3 GROUP BY community, size")
def community_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("community"))
    members = c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (100 + F.col("s_suppkey") % 50).alias("community")))
    summary = resolve.community_summaries(members)
    edges = graph.belongs_to(members, summary).groupBy(F.col("dst").alias("community")).agg(F.count("*").alias("edges"))
    return summary.join(edges, "community")


@query(f"SELECT CAST(least(a.label, b.label) AS VARCHAR) AS src, CAST(greatest(a.label, b.label) AS VARCHAR) AS dst, round(max({_COS}), 6) AS weight FROM embeddings a JOIN embeddings b ON a.label < b.label AND a.vec_id % 4 = b.vec_id % 4 GROUP BY 1, 2 HAVING max({_COS}) > 0.3")
def similar_groups_in_scopes(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.similarity import similar_groups

    e = table(spark, d, "embeddings").withColumn("scope", F.col("vec_id") % 4)
    return similar_groups(e, "label", "embedding", over=0.3, block_rows=100, within="scope").groupBy("src", "dst").agg(F.round(F.max("weight"), 6).alias("weight"))


@query("SELECT DISTINCT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS name, 'Term' AS type, c_nationkey % 2 AS pipeline_id, true AS own FROM customer UNION ALL SELECT DISTINCT 'Target' || chr(97 + c_nationkey % 2), NULL, c_nationkey % 2, false FROM customer")
def facts_with_missing_ends(spark: SparkSession, d: str) -> DataFrame:
    """Entities of extracted facts, and ends of relationships that no entity names."""
    c = table(spark, d, "customer")
    name, end = F.initcap(F.lower("c_mktsegment")), F.concat(F.lit("Target"), F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("c_nationkey") % 2 + 1))
    chunks = c.select((F.col("c_nationkey") % 2).alias("pipeline_id"), F.lit("u").alias("source_url"), F.col("c_custkey").alias("seq"), F.to_json(F.struct(name.alias("n"), end.alias("t"))).alias("raw_text"))

    def extract(raw):
        n, t = F.get_json_object(raw, "$.n"), F.get_json_object(raw, "$.t")
        entity = F.struct(n.alias("name"), F.lit("Term").alias("type"), F.lit("").alias("description"))
        link = F.struct(n.alias("source"), t.alias("target"), F.lit("NEAR").alias("type"), F.lit("q").alias("exact_quote"))
        return F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entity).alias("entities"), F.array(link).alias("relationships"))), F.lit("\n```"))

    entities, _ = workflow.extract_facts(chunks, extract)
    return entities.select("name", "type", "pipeline_id", F.col("type").isNotNull().alias("own"))


# events and orchestration

_NODES = "['searcher', 'scraper', 'bouncer', 'vector_storage', 'other']"


@query(
    f"""WITH e AS (SELECT user_id AS site_id, event_id AS seq, {_NODES}[event_id % 5 + 1] AS node, event_id % 2 = 0 AS relevant, 'u' || event_id % 3 AS url FROM events),
s AS (SELECT site_id, url, seq, CASE WHEN node = 'bouncer' AND NOT relevant THEN 'failed' WHEN node = 'searcher' THEN 'queued' WHEN node = 'scraper' THEN 'extracting' WHEN node = 'bouncer' THEN 'evaluating' WHEN node = 'vector_storage' THEN 'completed' END AS status FROM e)
SELECT site_id, url, arg_max(status, seq) AS status, max(seq) AS seq FROM s WHERE status IS NOT NULL GROUP BY 1, 2"""
)
def node_statuses(spark: SparkSession, d: str) -> DataFrame:
    node = F.element_at(F.array(*[F.lit(n) for n in ("searcher", "scraper", "bouncer", "vector_storage", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("user_id").alias("site_id"), F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("url"), F.col("event_id").alias("seq"), stream.node_status(node, F.col("event_id") % 2 == 0).alias("status"))
    return stream.latest_status(e.where("status IS NOT NULL"), ["site_id", "url"])


_PHASES = "CASE event_id % 11 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Error' WHEN 2 THEN 'Cancelled' ELSE 'Resolving' END"


@query(f"WITH e AS (SELECT user_id, event_id AS seq, {_PHASES} AS phase, CAST(event_id % 50 AS INTEGER) AS done, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 50 END AS total FROM events), l AS (SELECT user_id, arg_max(phase, seq) AS phase, arg_max(done * 100.0 / total, seq) FILTER (WHERE total > 0) AS pct, count(*) AS n_events FROM e GROUP BY user_id) SELECT user_id, phase, CASE WHEN phase = 'Complete' THEN 100 ELSE CAST(coalesce(floor(pct + 0.5), 0) AS INTEGER) END AS percent, CASE phase WHEN 'Complete' THEN 'complete' WHEN 'Error' THEN 'error' WHEN 'Cancelled' THEN 'cancelled' ELSE 'running' END AS state, n_events FROM l")
def progress_to_the_end(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("event_id") % 11
    phase = F.when(at == 0, "Complete").when(at == 1, "Error").when(at == 2, "Cancelled").otherwise("Resolving")
    total = F.when(F.col("event_id") % 3 == 0, 0).otherwise(50)
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), phase.alias("current_phase"), (F.col("event_id") % 50).cast("int").alias("processed_chunks"), total.alias("total_chunks"))
    return stream.progress(e, "user_id")


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS site_id, event_id AS seq, CASE WHEN event_id % 40 < 3 THEN 'queue' ELSE 'queue_update' END AS type, 'u' || event_id % 4 AS url, event_type AS status FROM events),
q AS (SELECT site_id, max(seq) AS from_seq FROM e WHERE type = 'queue' GROUP BY 1),
i AS (SELECT e.site_id, url FROM e JOIN q ON e.site_id = q.site_id AND seq = from_seq WHERE type = 'queue'),
u AS (SELECT e.site_id, url, arg_max(status, seq) AS status FROM e JOIN q ON e.site_id = q.site_id WHERE type = 'queue_update' AND seq > from_seq GROUP BY 1, 2)
SELECT i.site_id, i.url, coalesce(status, 'queued') AS status FROM i LEFT JOIN u ON i.site_id = u.site_id AND i.url = u.url"""
)
def folded_queue(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 40 < 3, "queue").otherwise("queue_update")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("site_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string")).alias("url"), F.col("event_type").alias("status"))
    return stream.fold_queue(e)


_TYPES = "['log', 'queue', 'queue_update', 'status', 'new_chunk', 'large_file_pending', 'graph_progress', 'other']"


@query(
    f"WITH e AS (SELECT user_id AS site_id, event_id, {_TYPES}[event_id % 8 + 1] AS type, event_type AS message, value FROM events) SELECT site_id, count(*) FILTER (WHERE type = 'log') AS logs, arg_max(message, event_id) FILTER (WHERE type = 'status') AS status, count(*) FILTER (WHERE type = 'new_chunk') AS chunks, count(*) FILTER (WHERE type = 'large_file_pending') AS pending, max(event_id) FILTER (WHERE type = 'graph_progress') AS progress_seq, count(*) FILTER (WHERE type IN ('queue', 'queue_update')) AS queue_events, count(*) FILTER (WHERE type = 'other') AS unknown FROM e GROUP BY site_id"
)
def site_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in (*stream.EVENT_TYPES, "other")]), (F.col("event_id") % 8 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("user_id").alias("site_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("message"))
    return stream.site_state(e)


@query("SELECT CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS BIGINT) AS bulk, event_id FROM events")
def sink_bulks(spark: SparkSession, d: str) -> DataFrame:
    return stream.bulks(table(spark, d, "events").select("event_id"), ["event_id"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey DESC LIMIT 1")
def queued_job(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    sites = n.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 2, "queued").otherwise("built").alias("graph_status"), (-F.col("n_nationkey")).alias("created_at"), F.col("n_nationkey").alias("id"))
    return queued_site(sites).select("n_nationkey", "n_name")


@query("SELECT n_nationkey AS site, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY length(n_name) DESC, n_nationkey LIMIT 100")
def sites_newest_first(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "nation").select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("tenant_id"), F.length("n_name").alias("created_at"))
    tenants = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("auth_id"))
    return relational.newest_first(sites, tenants, "ASIA", "created_at", "site").limit(100).select("site", "name")


@query(
    """WITH c AS (SELECT DISTINCT p_brand AS company FROM part),
l AS (SELECT * FROM (VALUES (0, 'site', ' official website'), (1, 'funding', ' funding'), (2, 'founders', ' founders'), (3, 'news', ' news')) t (turn, label, tail)),
f AS (SELECT company, turn, label, rank, 'u' || (rank * (turn + 1)) AS url, company || tail || rank AS snippet FROM c, l, range(1, 4) r (rank)),
o AS (SELECT company, url, arg_min(label, turn * 10 + rank) AS label, min(turn * 10 + rank) AS k, arg_min(snippet, turn * 10 + rank) AS snippet FROM f GROUP BY 1, 2)
SELECT company, string_agg('[' || label || '] ' || url || ': ' || snippet, chr(10) ORDER BY k) AS dossier, CASE WHEN company < 'Brand#3' THEN 'own' ELSE string_agg(url, ',' ORDER BY k) END AS urls FROM o GROUP BY company"""
)
def company_enrichment(spark: SparkSession, d: str) -> DataFrame:
    companies = table(spark, d, "part").select(F.col("p_brand").alias("company")).distinct()

    def search(asked: DataFrame) -> DataFrame:
        rows = asked.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(5))))
        return rows.withColumn("url", F.concat(F.lit("u"), (F.col("rank") * (F.col("turn") + 1)).cast("string"))).withColumn("snippet", F.concat("query", F.col("rank").cast("string")))

    listed = lambda company, _: F.struct(F.when(company < "Brand#3", F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("urls"))
    return workflow.enrich_companies(companies, search, listed).select("company", "dossier", F.array_join("urls", ",").alias("urls"))


@query("SELECT 'page' || page_id AS url, CASE WHEN page_id % 5 = 0 THEN 200 WHEN page_id % 5 = 4 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 5 IN (1, 2) THEN length(substr(repeat(html, 3), 1, 15000)) WHEN page_id % 5 = 4 THEN 0 ELSE length(html) END AS size, page_id % 5 IN (1, 2) AS by_proxy FROM pages")
def fetch_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Denied pages come from the proxy, cut to 15,000 characters; busy ones at a later attempt."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("page"), "page_id").alias("url"), "page_id", "html")

    def fetch(urls: DataFrame) -> DataFrame:
        kind = F.col("page_id") % 5
        status = F.when(kind == 1, 401).when(kind == 2, 403).when((kind == 3) & (F.col("attempt") < 2), 503).when(kind == 4, 404).otherwise(200)
        return urls.join(pages, "url").select("url", status.alias("status"), F.when(status == 200, F.col("html")).otherwise("").alias("text"))

    def proxy(urls: DataFrame) -> DataFrame:
        status = F.when(F.col("attempt") < 1, 429).otherwise(200)
        return urls.join(pages, "url").select("url", status.alias("status"), F.when(status == 200, F.repeat("html", 3)).otherwise("").alias("text"))

    return workflow.with_fallback(pages, fetch, proxy).select("url", "status", F.length("text").alias("size"), "by_proxy")


@query("SELECT 'src' || (page_id % 3) AS url, count(*) AS n FROM pages GROUP BY 1")
def source_urls_of_a_vertex(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 3).cast("string")).alias("url"), "page_id")
    edges = pages.where("page_id % 3 < 2").select(F.lit(7).alias("src"), F.col("page_id").alias("dst"), F.array(F.concat(F.lit(" "), "url"), F.lit("")).alias("source_urls"))
    mentions = pages.select(F.col("url").alias("document"), F.lit(7).alias("entity"))
    found = workflow.relation_urls(edges, mentions, 7)
    return found.join(pages, "url").groupBy("url").agg(F.count("*").alias("n"))

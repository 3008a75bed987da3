"""The query catalogue over the star-schema tables, each query with its SQL.

Stand-ins: regions are pipelines, nations and brands are canonical vertices, suppliers,
customers and parts raw entities, line items raw relationships, orders documents;
``documents`` are chunks, ``events`` progress events, ``embeddings`` vectors whose label
is a source. Every query reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import records, text, vectors
from tessera.operators import graph, relational, resolve, similarity
from tessera.plans import workflow
from tessera.session import Scratch
from tessera.sources.connectors import table
from tessera.streaming import events as stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# relational reads


@query("SELECT s.n_nationkey AS site, s.n_name AS site_name FROM nation s JOIN region t ON s.n_regionkey = t.r_regionkey WHERE t.r_name = 'ASIA'")
def scope_sites_for_tenant(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("tenant_id"))
    tenants = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("auth_id"))
    return relational.scoped(sites, tenants, "ASIA").select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("site_name"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY o_orderkey LIMIT 3")
def fourway_join_limit(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("o_orderkey", "c_name", "n_name", "r_name").orderBy("o_orderkey").limit(3)


@query("SELECT c_custkey, count(o_orderkey) AS n_docs FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def docs_per_site(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.zero_filled_counts(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "n_docs")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 40)")
def semi_join_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(docs.groupBy("source").agg(F.count("*").alias("n")).where("n > 40"), "source", "left_semi").select("doc_id", "source")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join_misses(spark: SparkSession, d: str) -> DataFrame:
    cached = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.hits_and_misses(table(spark, d, "part").select("p_partkey"), cached, "p_partkey")[1]


@query("SELECT DISTINCT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    cached = table(spark, d, "customer").select("c_custkey")
    return relational.hits_and_misses(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), cached, "c_custkey")[0]


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents ORDER BY doc_id DESC LIMIT 50")
def recent_chunks_top50(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet")).orderBy(F.desc("doc_id")).limit(50)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('7', '42')")
def json_path_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(k.isin("7", "42")).select("event_id", k.cast("long").alias("k"))


@query("WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, row_number() OVER (ORDER BY CAST(k AS BIGINT), event_id) AS int_place, row_number() OVER (ORDER BY k, event_id) AS text_place FROM e ORDER BY CAST(k AS BIGINT), event_id LIMIT 200")
def json_int_vs_text_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).withColumn("i", F.col("k").cast("long"))
    first = e.orderBy("i", "event_id").limit(200).withColumn("int_place", F.row_number().over(Window.orderBy("i", "event_id")).cast("long"))
    before = e.groupBy("k").agg(F.count("*").alias("n")).withColumn("lower", F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = e.join(first.select("k").distinct(), "k", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("event_id")))
    return first.join(same.select("event_id", "r"), "event_id").join(before, "k").select("event_id", "int_place", (F.col("lower") + F.col("r")).cast("long").alias("text_place"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_seen_sources(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_first(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")])


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN lower(url) LIKE '%.docx' THEN 'docx' WHEN lower(url) LIKE '%.pptx' THEN 'pptx' WHEN lower(url) LIKE '%.xlsx' OR lower(url) LIKE '%.csv' THEN 'spreadsheet' ELSE 'html' END AS kind FROM pages")
def url_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_kind(F.col("url")).alias("kind"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%D_W%'")
def ilike_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").ilike("%D_W%")).select("p_partkey", "p_name")


@query("SELECT n_nationkey FROM nation WHERE lower(n_name) = lower('NATION_7') OR lower(n_name) = lower('germany')")
def lower_eq(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower("n_name")
    return table(spark, d, "nation").where((name == "nation_7") | (name == "germany")).select("n_nationkey")


_COUNT = "CAST((length(t) - length(replace(t, '{0}', ''))) / {1} AS INTEGER)"


@query(
    "WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), y AS (SELECT doc_id, length(t) AS n, " + " + ".join(_COUNT.format(w, len(w)) for w in ("tion", "elle", "the of")) + " AS hits FROM x) "
    "SELECT doc_id, hits, CASE WHEN n = 0 THEN 'empty' WHEN n < 200 THEN 'short' WHEN hits < 3 THEN 'low density' END AS rejected FROM y"
)
def keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    words = ["tion", "Elle", "the of", " "]
    return table(spark, d, "documents").select("doc_id", text.keyword_hits(F.col("text"), words).alias("hits"), text.keyword_gate(F.col("text"), words).alias("rejected"))


@query("SELECT CASE WHEN length(text) < 200 THEN 'reject' WHEN length(text) > 10000 THEN 'pending' ELSE 'process' END AS route, count(*) AS n FROM documents GROUP BY 1")
def length_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.length_route(F.length("text"), most=10_000).alias("route")).agg(F.count("*").alias("n"))


@query("SELECT page_id, (lower(url) LIKE '%ft.com%' OR lower(url) LIKE '%example.net%') AS blocked FROM pages")
def domain_blocklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.blocked_domain(F.col("url"), ("ft.com", "example.net")).alias("blocked"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def doc_text_concat(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda r: r["text"]), "\n\n").alias("text"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


_RAW = "concat('noise ```json {\"entities\": [{\"name\": \"', source, '\", \"type\": \"', lang, '\"}, {\"name\": ', doc_id, ', \"type\": \"x\"}], \"relationships\": [{\"source\": \"', source, '\", \"target\": \"', lang, '\", \"type\": \"IN\"}]} ```')"


@query("SELECT source AS name, lang AS type, count(*) AS n FROM documents GROUP BY 1, 2")
def clean_and_parse_json_lenient(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    return records.parse_lenient(raw, "doc_id", "raw")[0].groupBy("name", "type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source AS first_name, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS target, CAST(length(text) % 3 + 1 AS INTEGER) AS entities FROM documents WHERE doc_id % 2 = 0 OR lang <> 'en'")
def clean_and_parse_json_strict(spark: SparkSession, d: str) -> DataFrame:
    """Extractions made of each document's own columns; English ones of odd id lack a quote and are dropped whole."""
    docs = table(spark, d, "documents")
    entity = F.transform(F.sequence(F.lit(0), F.length("text") % 3), lambda i: F.struct(F.when(i == 0, F.col("source")).otherwise(F.concat(F.lit("e"), i.cast("string"))).alias("name"), F.col("lang").alias("type")))
    whole, bare = (F.struct(F.col("source").alias("source"), F.col("lang").alias("target"), F.lit("IN").alias("type"), *more) for more in ([F.substring("text", 1, 30).alias("exact_quote")], []))
    links = F.when(F.col("lang") != "en", F.to_json(F.array(whole))).when(F.col("doc_id") % 2 == 0, F.lit("[]")).otherwise(F.to_json(F.array(bare)))
    raw = F.concat(F.lit('```json\n{"entities": '), F.to_json(entity), F.lit(', "relationships": '), links, F.lit("}\n```"))
    parsed = docs.select("doc_id", records.parse_strict(raw).alias("x")).where("x IS NOT NULL")
    return parsed.select("doc_id", F.get("x.entities", F.lit(0))["name"].alias("first_name"), F.get("x.relationships", F.lit(0))["target"].alias("target"), F.size("x.entities").alias("entities"))


# mutation


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1")
def upsert_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_suppkey")
    last = relational.last_write(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT s_suppkey AS key, coalesce(c_name, s_name) AS name, coalesce(c_acctbal, s_acctbal) AS balance FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert_merge_fill(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return relational.upsert(old, new, ["key"], ["name", "balance"], fill=True)


@query("WITH m AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, lower(c_mktsegment)) AS master FROM customer) SELECT master AS c_custkey, count(*) AS n_orders FROM orders JOIN m ON o_custkey = c_custkey GROUP BY 1")
def merge_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    mapping = relational.masters(table(spark, d, "customer"), [F.col("c_nationkey"), F.lower("c_mktsegment")], [F.col("c_custkey")], "c_custkey")
    moved = relational.reassign(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), mapping, "c_custkey", "c_custkey")
    return moved.groupBy("c_custkey").agg(F.count("*").alias("n_orders"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'rejected' ELSE o_orderstatus END AS status FROM orders")
def status_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    return relational.set_status(rows, F.col("o_totalprice") < 50000, "rejected").select("o_orderkey", "status")


@query("SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier UNION SELECT c_custkey FROM customer")
def get_or_create_rows(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return relational.get_or_create(have, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), ["id"])


# graph


def _nation_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw edges supplier -> customer, resolves, nation vertices) with quotes and urls."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    raw = li.join(o, "l_orderkey").select(
        F.concat(F.lit("s"), "l_suppkey").alias("src"),
        F.concat(F.lit("c"), "o_custkey").alias("dst"),
        F.col("l_returnflag").alias("type"),
        F.when(F.col("l_linenumber") > 1, F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).otherwise("").alias("quote"),
        F.col("o_orderpriority").alias("url"),
    )
    raw = raw.groupBy("src", "dst", "type").agg(F.max(F.struct("quote", "url")).alias("q")).select("src", "dst", "type", "q.*")
    resolves = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("raw"), F.col("s_nationkey").alias("canonical"))
    resolves = resolves.unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("raw"), F.col("c_nationkey").alias("canonical")))
    kind = F.element_at(F.array(F.lit("Startup"), F.lit("Regulator"), F.lit("Contractor"), F.lit("Utility"), F.lit("Person")), F.col("n_nationkey") % 5 + 1)
    vertices = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), kind.alias("type"))
    return raw, resolves, vertices


_GRAPH = """WITH raw AS (SELECT 's' || l_suppkey AS src, 'c' || o_custkey AS dst, l_returnflag AS type, max(ROW(CASE WHEN l_linenumber > 1 THEN l_linestatus || l_linenumber ELSE '' END, o_orderpriority)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
res AS (SELECT 's' || s_suppkey AS raw, s_nationkey AS canonical FROM supplier UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer),
vert AS (SELECT n_nationkey AS id, n_name AS name, ['Startup', 'Regulator', 'Contractor', 'Utility', 'Person'][n_nationkey % 5 + 1] AS type FROM nation),
ends AS (SELECT a.canonical AS src, b.canonical AS dst, raw.type, raw.q[1] AS quote, raw.q[2] AS url FROM raw JOIN res a ON raw.src = a.raw JOIN res b ON raw.dst = b.raw),
col AS (SELECT src, dst, type, count(*) AS weight FROM ends WHERE src <> dst GROUP BY 1, 2, 3),
und AS (SELECT src, dst, type, weight FROM col UNION ALL SELECT dst, src, type, weight FROM col),
named AS (SELECT src, dst, e.type AS rel_type, weight, s.name AS source_name, s.type AS source_type, t.name AS target_name, t.type AS target_type FROM und e JOIN vert s ON e.src = s.id JOIN vert t ON e.dst = t.id)
"""


@query(_GRAPH + "SELECT src, dst, type, weight FROM col")
def edge_collapse(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    return graph.collapse_edges(raw, resolves).select("src", "dst", "type", "weight")


@query(_GRAPH + "SELECT src, dst, type, md5(string_agg(quote, ',' ORDER BY quote) FILTER (WHERE quote <> '')) AS quotes, md5(string_agg(url, ',' ORDER BY url) FILTER (WHERE url <> '')) AS urls FROM ends WHERE src <> dst GROUP BY 1, 2, 3")
def edge_collapse_quotes(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    text_of = lambda c: F.when(F.size(c) > 0, F.md5(F.array_join(c, ",")))
    return graph.collapse_edges(raw, resolves).select("src", "dst", "type", text_of("quotes").alias("quotes"), text_of("source_urls").alias("urls"))


@query(_GRAPH + "SELECT id AS \"Id\", name AS \"Label\", type AS \"EntityType\" FROM vert")
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.export_nodes(_nation_graph(spark, d)[2])


@query(_GRAPH + "SELECT src AS \"Source\", dst AS \"Target\", 'Directed' AS \"Type\", type AS \"Label\", count(*) AS \"Weight\" FROM ends GROUP BY src, dst, type")
def export_edges(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    return graph.export_edges(raw, resolves)


_THEME = "SELECT src, dst, rel_type, weight, source_name, target_name FROM named WHERE {} ORDER BY weight DESC, src, dst, rel_type LIMIT 700"
_FIRM = "('Company', 'Startup', 'Incumbent', 'Utility', 'Investor')"
_LAW = "regexp_full_match({}, '(?i).*regul.*|.*law.*|.*gov.*|.*polic.*|.*act.*|.*bill.*')"
_SHOW = ["src", "dst", "rel_type", "weight", "source_name", "target_name"]


@query(_GRAPH + "SELECT src, dst, e.type AS rel_type, weight, s.name AS source_name, t.name AS target_name FROM col e JOIN vert s ON src = s.id JOIN vert t ON dst = t.id ORDER BY weight DESC, src, dst, rel_type LIMIT 700")
def theme_full(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, vertices = _nation_graph(spark, d)
    return graph.theme_full(graph.collapse_edges(raw, resolves).select("src", "dst", "type", "weight"), vertices, 700).select(*_SHOW)


@query(_GRAPH + _THEME.format(f"source_type IN {_FIRM} OR target_type IN {_FIRM}"))
def theme_companies(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, vertices = _nation_graph(spark, d)
    return graph.theme_companies(graph.collapse_edges(raw, resolves).select("src", "dst", "type", "weight"), vertices, 700).select(*_SHOW)


@query(_GRAPH + _THEME.format(f"({_LAW.format('source_type')} AND target_type IN {_FIRM}) OR ({_LAW.format('target_type')} AND source_type IN {_FIRM})"))
def theme_regulatory(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, vertices = _nation_graph(spark, d)
    return graph.theme_regulatory(graph.collapse_edges(raw, resolves).select("src", "dst", "type", "weight"), vertices, 700).select(*_SHOW)


def _document_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, similar, mentions, entities): customers as documents, parts as entities.

    Customers of a segment and nation are similar to the next three by key.
    """
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("title"), F.concat(F.lit("u"), "c_custkey").alias("url"))
    said = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mentions = said.select(F.col("o_custkey").alias("document"), F.col("l_partkey").alias("entity")).distinct()
    place = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    after = table(spark, d, "customer").select("c_custkey", F.array(*[F.lead("c_custkey", i).over(place) for i in (1, 2, 3)]).alias("next"))
    after = after.select("c_custkey", F.explode("next").alias("other")).where("other IS NOT NULL")
    similar = after.select(F.col("c_custkey").alias("src"), F.col("other").alias("dst"), (F.lit(1.0) / (1 + F.col("other") - F.col("c_custkey"))).alias("weight"))
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    return docs, similar, mentions, entities


_DOCS = """WITH docs AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS title, 'u' || c_custkey AS url FROM customer),
ment AS (SELECT DISTINCT o_custkey AS document, l_partkey AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k FROM customer),
sim AS (SELECT a.c_custkey AS src, b.c_custkey AS dst, 1.0 / (1 + b.c_custkey - a.c_custkey)::DOUBLE AS weight FROM ranked a JOIN ranked b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey = b.c_nationkey AND b.k BETWEEN a.k + 1 AND a.k + 3),
twoway AS (SELECT src, dst, weight FROM sim UNION ALL SELECT dst, src, weight FROM sim),
bridge AS (SELECT entity FROM ment GROUP BY entity HAVING count(*) BETWEEN 2 AND 15),
edges AS (SELECT src, dst, coalesce(title, url) AS target_name, 'SIMILAR_TO' AS rel_type, weight FROM twoway JOIN docs ON dst = id UNION ALL SELECT document, entity, p_name, 'MENTIONS', 0.5::DOUBLE FROM ment JOIN bridge USING (entity) JOIN part ON p_partkey = entity)
"""


@query(_DOCS + "SELECT docs.id AS src, coalesce(title, url) AS source_name, dst, target_name, rel_type, round(coalesce(weight, 0.5), 9) AS weight FROM docs LEFT JOIN edges ON docs.id = edges.src ORDER BY coalesce(weight, 0.5) DESC, docs.id, dst NULLS FIRST, rel_type NULLS FIRST LIMIT 2500")
def theme_documents(spark: SparkSession, d: str) -> DataFrame:
    out = graph.theme_documents(*_document_graph(spark, d))
    return out.select("src", "source_name", "dst", "target_name", "rel_type", F.round("weight", 9).alias("weight"))


@query(_DOCS + "SELECT dst AS id, target_name AS name, rel_type, round(weight, 9) AS weight FROM (SELECT src, dst, coalesce(title, url) AS target_name, 'SIMILAR_TO' AS rel_type, weight FROM twoway JOIN docs ON dst = id UNION ALL SELECT document, entity, p_name, 'MENTIONS', 0.5::DOUBLE FROM ment JOIN part ON p_partkey = entity) WHERE src = (SELECT min(src) FROM sim)")
def ego_document(spark: SparkSession, d: str) -> DataFrame:
    docs, similar, mentions, entities = _document_graph(spark, d)
    centre = similar.agg(F.coalesce(F.min("src"), F.lit(-1))).first()[0]
    return graph.ego_document(docs, similar, mentions, entities, centre).select("id", "name", "rel_type", F.round("weight", 9).alias("weight"))


@query(_GRAPH + "SELECT v.id AS central_id, v.name AS central_name, n.id AS neighbour, n.name AS neighbour_name, e.type AS rel_type, weight, is_outgoing FROM vert v LEFT JOIN (SELECT src AS c, dst AS o, type, weight, true AS is_outgoing FROM col UNION ALL SELECT dst, src, type, weight, false FROM col) e ON v.id = e.c LEFT JOIN vert n ON n.id = e.o WHERE v.id = 3")
def ego_entity(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, vertices = _nation_graph(spark, d)
    out = graph.ego_entity(vertices, graph.collapse_edges(raw, resolves), 3)
    return out.select("central_id", "central_name", "neighbour", "neighbour_name", "rel_type", "weight", "is_outgoing")


def _brand_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): suppliers and parts, one edge for each distinct pair of a line item."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("type"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return s.unionByName(p), e


_BRANDS = """WITH v AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'Supplier' AS type FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, p_brand FROM part),
e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
doomed AS (SELECT id FROM v JOIN deg USING (id) WHERE degree > 50 AND type = 'Supplier')
"""


@query(_BRANDS + "SELECT id, name, coalesce(degree, 0) AS degree FROM v LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) > 50")
def degree_supernodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.supernodes(*_brand_graph(spark, d)).select("id", "name", "degree")


@query(_BRANDS + "SELECT 'vertex' AS kind, count(*) AS n FROM v WHERE id NOT IN (SELECT id FROM doomed) UNION ALL SELECT 'edge', count(*) FROM e WHERE src NOT IN (SELECT id FROM doomed) AND dst NOT IN (SELECT id FROM doomed)")
def detach_delete(spark: SparkSession, d: str) -> DataFrame:
    vertices, edges = graph.prune_supernodes(*_brand_graph(spark, d), lambda name, kind: kind == "Supplier")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(vertices, "vertex").unionByName(count(edges, "edge"))


@query("SELECT DISTINCT CAST(o_orderpriority || o_custkey AS VARCHAR) AS document, x AS entity FROM (SELECT o_orderpriority, o_custkey, unnest(['n' || s_nationkey, 'b' || p_brand]) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) UNION SELECT DISTINCT 'x' || s_suppkey % 7, 'n' || s_nationkey FROM supplier")
def mentions_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("url"))
    resolves = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("raw"), F.concat(F.lit("n"), "s_nationkey").alias("canonical"))
    resolves = resolves.unionByName(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("raw"), F.concat(F.lit("b"), "p_brand").alias("canonical")))
    own = table(spark, d, "supplier").select(F.concat(F.lit("x"), (F.col("s_suppkey") % 7).cast("string")).alias("url"), F.concat(F.lit("s"), "s_suppkey").alias("raw"))
    return graph.mention_edges(own, links, resolves)


@query("SELECT source AS url, min(md5(text)) AS title, lang, 'html' AS type FROM documents GROUP BY source, lang")
def document_vertices(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("source").alias("url"), F.md5("text").alias("title"), "lang")
    return graph.document_vertices(chunks, "url", "title", ["lang"])


# vectors and resolution


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id, round(max({_COS}), 6) AS max_similarity FROM embeddings a CROSS JOIN embeddings b WHERE b.vec_id < 10 GROUP BY a.vec_id HAVING max({_COS}) >= 0.35")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    out = similarity.semantic_funnel(e, e.where("vec_id < 10"), "vec_id", "embedding")
    return out.select("vec_id", F.round("max_similarity", 6).alias("max_similarity"))


@query(f"SELECT CAST(least(a.label, b.label) AS VARCHAR) AS src, CAST(greatest(a.label, b.label) AS VARCHAR) AS dst, round(max({_COS}), 6) AS weight FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY 1, 2 HAVING max({_COS}) > 0.35")
def similar_groups(spark: SparkSession, d: str) -> DataFrame:
    out = similarity.similar_groups(table(spark, d, "embeddings"), "label", "embedding", over=0.35)
    return out.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"SELECT a.vec_id, round(1 - {_COS}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = 0 WHERE a.label IN (1, 2, 3) ORDER BY 1 - {_COS}, a.vec_id LIMIT 10")
def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    target = e.where("vec_id = 0").select("embedding").first()[0]
    return similarity.nearest(e.where(F.col("label").isin(1, 2, 3)), target, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


_COMP = f"""WITH RECURSIVE pair AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COS} >= 0.35),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x),
comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)
"""


def _vector_components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    edges = Scratch(spark, "pairs").table(resolve.similarity_links(e, "embedding", 0.35), "edges")
    return resolve.components(e, edges)


@query(_COMP + "SELECT id, component FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    return _vector_components(spark, d)


@query(
    _COMP
    + "SELECT component, arg_min(name, (length(name), id)) AS name, type, arg_max(description, (length(description), -id)) AS description, CAST(members AS BIGINT) AS members FROM (SELECT id, component, repeat('x', CAST(id % 7 AS INTEGER)) || id AS name, repeat('d', CAST(id % 11 AS INTEGER)) AS description, count(*) OVER (PARTITION BY component) AS members FROM comp) JOIN (SELECT component, type FROM (SELECT component, 'T' || label AS type, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, 'T' || label) AS n FROM comp JOIN embeddings ON id = vec_id GROUP BY 1, 2) WHERE n = 1) USING (component) GROUP BY component, type, members"
)
def canonicalise(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.expr("repeat('x', CAST(vec_id % 7 AS INT))"), F.col("vec_id").cast("string")).alias("name"),
        F.concat(F.lit("T"), "label").alias("type"),
        F.expr("repeat('d', CAST(vec_id % 11 AS INT))").alias("description"),
    )
    return resolve.canonicalise(entities, _vector_components(spark, d))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, vertices = _nation_graph(spark, d)
    edges = graph.resolve_edges(raw, resolves).select(F.lit("all").alias("pipeline"), "src", "dst")
    return resolve.louvain(edges, "pipeline")


@query()
def communities_by_labels(spark: SparkSession, d: str) -> DataFrame:
    raw, resolves, _ = _nation_graph(spark, d)
    return resolve.label_propagation(graph.resolve_edges(raw, resolves))


# events, tasks, classification, retrieval


@query("SELECT user_id AS site_id, event_type AS url, arg_max(CAST(value AS VARCHAR), event_id) IS NOT NULL AS known, max(event_id) AS seq FROM events GROUP BY 1, 2")
def event_latest_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("site_id"), F.col("event_type").alias("url"), F.col("event_id").alias("seq"), F.col("value").isNotNull().alias("known"))
    return stream.latest_status(e, ["site_id", "url"], "known")


@query("WITH e AS (SELECT user_id, event_id AS seq, event_type AS phase, CAST(event_id % 50 AS INTEGER) AS done, 50 AS total FROM events), l AS (SELECT user_id, arg_max(phase, seq) AS phase, arg_max(done, seq) AS done, count(*) AS n_events FROM e GROUP BY user_id) SELECT user_id, phase, CAST(floor(done * 100.0 / 50 + 0.5) AS INTEGER) AS percent, 'running' AS state, n_events FROM l")
def event_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("current_phase"), (F.col("event_id") % 50).cast("int").alias("processed_chunks"), F.lit(50).alias("total_chunks"))
    return stream.progress(e, "user_id")


@query("SELECT task, outcome, next_task, count(*) AS n FROM (SELECT task, outcome, unnest(following) AS next_task FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'MARKET_SIZING' WHEN doc_id % 3 = 1 THEN 'EXTRACT_COMPANIES' ELSE 'SCRAPE_URL' END AS task, CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome FROM documents) JOIN (VALUES ('MARKET_SIZING', 'SUCCESS', ['EXTRACT_COMPANIES']), ('MARKET_SIZING', 'FAILED', ['HALT_PIPELINE']), ('EXTRACT_COMPANIES', 'SUCCESS', ['ENRICH_COMPANY', 'PLAN_COMPANY_SEARCH']), ('EXTRACT_COMPANIES', 'FAILED', ['HALT_PIPELINE']), ('SCRAPE_URL', 'SUCCESS', ['BOUNCER_EVALUATION']), ('SCRAPE_URL', 'FAILED', ['MARK_URL_FAILED'])) t (task, outcome, following) USING (task, outcome)) GROUP BY ALL")
def task_fanout(spark: SparkSession, d: str) -> DataFrame:
    task = F.when(F.col("doc_id") % 3 == 0, "MARKET_SIZING").when(F.col("doc_id") % 3 == 1, "EXTRACT_COMPANIES").otherwise("SCRAPE_URL")
    done = table(spark, d, "documents").select(task.alias("task"), F.when(F.col("doc_id") % 5 == 0, "FAILED").otherwise("SUCCESS").alias("outcome"), F.lit(3).alias("retry_count"))
    return workflow.next_tasks(done).groupBy("task", "outcome", "next_task").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%incumbent%' OR lower(p_type) LIKE '%public%' OR lower(p_type) LIKE '%mature%' THEN 'Incumbent' WHEN lower(p_type) LIKE '%utility%' OR lower(p_type) LIKE '%muni%' THEN 'Utility' WHEN lower(p_type) LIKE '%investor%' OR lower(p_type) LIKE '%vc%' OR lower(p_type) LIKE '%pe%' THEN 'Investor' ELSE 'Startup' END AS kind FROM part")
def stage_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.stage_kind(F.col("p_type")).alias("kind"))


@query("SELECT doc_id, CASE WHEN round(n_chars / 5000.0 * 100) < 40 THEN 'red' WHEN round(n_chars / 5000.0 * 100) < 70 THEN 'yellow' WHEN round(n_chars / 5000.0 * 100) >= 90 THEN 'emerald' ELSE 'indigo' END AS band FROM documents")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.score_band(F.col("n_chars") / F.lit(5000.0)).alias("band"))


_NEAR = f"WITH near AS (SELECT a.vec_id, 1 - {_COS} AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = 0 JOIN documents d ON d.doc_id = a.vec_id WHERE d.source IN ('src1', 'src2') ORDER BY dist, a.vec_id LIMIT 10), num AS (SELECT row_number() OVER (ORDER BY dist, vec_id) AS n, vec_id FROM near) "


@query(_NEAR + "SELECT md5(string_agg('--- Chunk ' || n || ' [Source: ' || source || '] ---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)) AS context_md5 FROM num JOIN documents ON doc_id = vec_id")
def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    chunks = docs.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("url"), "text", "embedding")
    urls = spark.createDataFrame([(" src1 ",), ("src2",), ("",), (None,)], "url string")
    target = e.where("vec_id = 0").select("embedding").first()[0]
    return workflow.retrieval_context(chunks, urls, target).select(F.md5("context").alias("context_md5"))


@query("SELECT count(*) AS pairs, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").agg(F.count("*").alias("pairs"), F.round(F.avg(vectors.cosine(F.col("embedding"), F.col("other"))), 6).alias("mean_cosine"))

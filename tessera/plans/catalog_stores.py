"""Catalogue queries of stored tables, streams, vector search and gates, each with its SQL.

Stand-ins as in ``catalog``; these queries are added to its registry. Streams read events that
the query lands in two steps, and are stopped and started again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import keywords
from tessera.operators import graph, main_text, similarity, vector_index
from tessera.plans import workflow
from tessera.plans.catalog import _COS, _GRAPH, _nation_graph, query
from tessera.session import Scratch
from tessera.sources.connectors import hashed_embedding, table
from tessera.sources.keyed_store import KeyedStore
from tessera.streaming import exactly_once, state

# stored tables


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, coalesce(c_name, s_name) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, s_acctbal) AS balance FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def stored_vertex_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Two batches merged into one stored table, a null leaving what is there; both are replayed."""
    store = KeyedStore(spark, Scratch(spark, "vertices").path, "key long, name string, balance double", ["key"], fill=True)
    first = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    second = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"))
    for number, batch in ((0, first), (1, second), (0, first), (1, second)):
        store.upsert(batch, ["name"], writer="build", batch=number)
    return store.read()


@query(
    """SELECT src, dst, type, quote FROM (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS type, l_quantity AS quote, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_orderkey % 2 DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS n FROM lineitem)
WHERE n = 1 AND NOT (src % 10 = 3 AND type = 'R')"""
)
def stored_edge_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Raw relationships merged in two batches, the last write winning; a third deletes some and is replayed."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("quote"), "l_orderkey", "l_linenumber")
    store = KeyedStore(spark, Scratch(spark, "edges").path, "src long, dst long, type string, quote double", ["src", "dst", "type"], bucket_by=["src"])
    order = ["l_orderkey", "l_linenumber", "quote"]
    for number in (0, 1):
        store.upsert(li.where(F.col("l_orderkey") % 2 == number), order, "build", number)
    for _ in range(2):
        store.delete(li.where("src % 10 = 3 AND type = 'R'"), "build", 2)
    return store.read()


@query(_GRAPH + "SELECT v.id AS central_id, v.name AS central_name, n.id AS neighbour, n.name AS neighbour_name, e.type AS rel_type, weight, is_outgoing FROM vert v LEFT JOIN (SELECT src AS c, dst AS o, type, weight, true AS is_outgoing FROM col UNION ALL SELECT dst, src, type, weight, false FROM col) e ON v.id = e.c LEFT JOIN vert n ON n.id = e.o WHERE v.id = 3")
def ego_entity_stored(spark: SparkSession, d: str) -> DataFrame:
    """A vertex's network from a stored edge table: one bucket of it is opened."""
    raw, resolves, vertices = _nation_graph(spark, d)
    return graph.ego_stored(vertices, graph.store_edges(spark, graph.edge_weights(raw, resolves), Scratch(spark, "edges").path), 3)


@query(f"SELECT CAST(least(a.label, b.label) AS VARCHAR) AS src, CAST(greatest(a.label, b.label) AS VARCHAR) AS dst, round(max({_COS}), 6) AS weight FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY 1, 2 HAVING max({_COS}) > 0.35")
def stored_similar_edges(spark: SparkSession, d: str) -> DataFrame:
    """Similarity edges upserted twice: first those of half the vectors, then of all."""
    store = KeyedStore(spark, Scratch(spark, "similar").path, "src string, dst string, weight double", ["src", "dst"], buckets=16)
    e = table(spark, d, "embeddings")
    for number, some in enumerate((e.where("vec_id % 2 = 0"), e)):
        store.upsert(similarity.similar_groups(some, "label", "embedding", over=0.35), ["weight"], "similar", number)
    return store.read().select("src", "dst", F.round("weight", 6).alias("weight"))


# streams

_KINDS = ["log", "queue", "queue_update", "queue_update", "queue_update", "status", "queue_update", "new_chunk"]
_SITE_EVENTS = f"SELECT CAST(user_id % 40 AS VARCHAR) AS site_id, event_id AS seq, {_KINDS!r}[event_id % 7 + 1 + CASE WHEN event_id % 7 = 1 AND event_id % 5 > 0 THEN 1 ELSE 0 END] AS type, 'u' || event_id % 3 AS url, event_type AS status, event_type || event_id AS message FROM events"


def _site_events(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("event_id") % 7 + 1 + F.when((F.col("event_id") % 7 == 1) & (F.col("event_id") % 5 > 0), 1).otherwise(0)
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), place.cast("int"))
    return table(spark, d, "events").select(
        (F.col("user_id") % 40).cast("string").alias("site_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("url"),
        F.col("event_type").alias("status"), F.concat("event_type", F.col("event_id").cast("string")).alias("message"),
    )


@query(
    f"""WITH e AS ({_SITE_EVENTS}), q AS (SELECT site_id, max(seq) AS from_seq FROM e WHERE type = 'queue' GROUP BY 1),
i AS (SELECT e.site_id, url, from_seq FROM e JOIN q ON e.site_id = q.site_id AND seq = from_seq WHERE type = 'queue'),
u AS (SELECT e.site_id, url, arg_max(status, seq) AS status, max(seq) AS last_seq FROM e JOIN q ON e.site_id = q.site_id AND seq > from_seq WHERE type = 'queue_update' GROUP BY 1, 2)
SELECT i.site_id, 'queue' AS kind, i.url AS item, coalesce(last_seq, from_seq) AS seq, coalesce(status, 'queued') AS value FROM i LEFT JOIN u ON i.site_id = u.site_id AND i.url = u.url
UNION ALL SELECT site_id, 'log', CAST(seq AS VARCHAR), seq, message FROM e WHERE type = 'log'
UNION ALL SELECT site_id, 'status', '', max(seq), arg_max(message, seq) FROM e WHERE type = 'status' GROUP BY site_id"""
)
def streamed_site_views(spark: SparkSession, d: str) -> DataFrame:
    """Each site's log, queue and status, folded by a stream that is restarted from its checkpoint midway."""
    scratch = Scratch(spark, "views")
    landed, store = f"{scratch.path}/in", state.view_store(spark, f"{scratch.path}/store")
    e = _site_events(spark, d)
    for half in (0, 1):
        e.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == half).write.mode("append").parquet(landed)
        state.run_site_views(spark.readStream.schema(e.schema).parquet(landed), store, f"{scratch.path}/checkpoint")
    return store.read()


@query("SELECT event_id, user_id, event_type FROM events")
def redelivered_events_once(spark: SparkSession, d: str) -> DataFrame:
    """Events that are delivered again within the hour, and batches that are written again, are there once."""
    scratch = Scratch(spark, "delivered")
    ledger = exactly_once.AppendLedger(spark, f"{scratch.path}/table", "event_id long, user_id long, event_type string")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = e.agg(F.expr("timestamp_micros(CAST((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 AS BIGINT))").alias("m")).first()["m"]
    early = F.col("ts") <= F.lit(middle)
    again = ~early | (F.col("ts") > F.lit(middle) - F.expr("INTERVAL 30 MINUTES"))
    for part in (early, again):
        e.where(part).write.mode("append").parquet(f"{scratch.path}/in")
        stream = exactly_once.once_each(spark.readStream.schema(e.schema).parquet(f"{scratch.path}/in"), ["event_id"], "ts", "1 hour")
        write = ledger.sink("events")

        def twice(rows: DataFrame, batch: int, write=write) -> None:
            write(rows, batch)
            write(rows, batch)

        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger.read()


# vectors


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT 'd' || vec_id % 40 AS doc, v FROM e UNION ALL SELECT 'c' || vec_id % 70, list_concat([v[1] + 0.3], v[2:]) FROM e)
SELECT least(a.doc, b.doc) AS src, greatest(a.doc, b.doc) AS dst, round(max(list_cosine_similarity(a.v, b.v)), 6) AS weight FROM c a JOIN c b ON a.doc < b.doc GROUP BY 1, 2 HAVING max(list_cosine_similarity(a.v, b.v)) > 0.85"""
)
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents over the usual threshold, among vectors and slightly turned copies of them."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    turned = F.transform("v", lambda x, i: F.when(i == 0, x + 0.3).otherwise(x))
    name = lambda letter, n: F.concat(F.lit(letter), (F.col("vec_id") % n).cast("string")).alias("doc")
    chunks = e.select(name("d", 40), "v").unionByName(e.select(name("c", 70), turned.alias("v")))
    return similarity.similar_groups(chunks, "doc", "v").select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(far, 6) AS distance FROM (SELECT b.vec_id AS query, a.vec_id AS neighbour, 1 - {_COS} AS far, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(1 - {_COS}, 12), a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0) WHERE rank <= 10")
def indexed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of all vectors to each whose id is divisible by 100, exact, through the inverted file."""
    e = table(spark, d, "embeddings")
    centroids = vector_index.fit_centroids(e, "embedding", 16)
    index = vector_index.VectorIndex.build(e, "vec_id", "embedding", centroids, f"{Scratch(spark, 'index').path}/lists")
    return index.search(e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "neighbour", "rank", F.round("distance", 6).alias("distance"))


@query("SELECT count(*) AS queries, 10 * count(*) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def indexed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether a search of so few lists that 95 % of a sample's neighbours are found finds 90 % of all queries' neighbours."""
    e, scratch = table(spark, d, "embeddings"), Scratch(spark, "index")
    index = vector_index.VectorIndex.build(e, "vec_id", "embedding", vector_index.fit_centroids(e, "embedding", 16), f"{scratch.path}/lists")
    queries = e.where("vec_id % 100 = 0")
    probes = vector_index.probes_for(index, e, "vec_id", "embedding", least=0.95, most_queries=50)
    found = scratch.table(index.search(queries, "vec_id", "embedding", 10, probes), "found")
    truth = scratch.table(index.search(queries, "vec_id", "embedding", 10), "truth")
    counts = truth.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("neighbours"))
    return counts.withColumn("enough", F.lit(vector_index.recall(found, truth) >= 0.9))


# gates and pages

#: A site for each language, with words of its own; one is listed twice, one is blank.
SITE_WORDS = {"en": ["The", "of the", "tion", "tion", " "], "de": ["sch", "ein", "und"], "fr": ["eau", "elle"], "es": []}
_WORDS = ", ".join(f"('{site}', '{w.lower()}')" for site, words in SITE_WORDS.items() for w in words if w.strip())


@query(
    f"""WITH w(lang, k) AS (VALUES {_WORDS}), t AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents),
h AS (SELECT doc_id, CAST(coalesce(sum((length(t) - length(replace(t, k, ''))) // length(k)), 0) AS INTEGER) AS hits, any_value(length(t)) AS n FROM t LEFT JOIN w USING (lang) GROUP BY doc_id)
SELECT doc_id, hits, CASE WHEN n = 0 THEN 'empty' WHEN n < 200 THEN 'short' WHEN hits < 3 THEN 'low density' END AS rejected FROM h"""
)
def site_keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    sites = spark.createDataFrame(list(SITE_WORDS.items()), "lang string, words array<string>")
    found = keywords.site_keyword_hits(docs, sites, "lang", "text", "words")
    return found.select("doc_id", "hits", keywords.density_verdict(F.col("text"), F.col("hits")).alias("rejected"))


@query()
def main_text_by_density(spark: SparkSession, d: str) -> DataFrame:
    return main_text.main_text(table(spark, d, "pages"), "page_id", "html")


@query(_GRAPH + "SELECT v.id AS id, v.name AS name, count(e.src) > 0 AS related, count(e.src) AS relations FROM vert v LEFT JOIN (SELECT src, dst FROM col UNION ALL SELECT dst, src FROM col) e ON v.id = e.src WHERE v.id = 3 GROUP BY 1, 2")
def answered_question(spark: SparkSession, d: str) -> DataFrame:
    """A vertex's briefing of relations and retrieved text, and the answer that a caller's function makes of it."""
    raw, resolves, vertices = _nation_graph(spark, d)
    ego = graph.ego_entity(vertices, graph.edge_weights(raw, resolves), 3)
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    chunks = docs.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("url"), "text", "embedding")
    out = workflow.answer(ego, chunks, chunks.select("url").distinct(), hashed_embedding, lambda prompt: F.struct(F.size(F.split(prompt, "\n- ")).alias("lines")))
    return out.select(F.col("central_id").alias("id"), F.col("central_name").alias("name"), (F.col("relations") > 0).alias("related"), "relations")

"""Orchestration: graph build, retrieval context, task transitions and the acquisition loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.records import parse_strict
from tessera.operators.graph import collapse_edges, mention_edges, prune_supernodes, resolve_edges, stable_id, upsert_companies
from tessera.operators.relational import last_write
from tessera.operators.resolve import canonicalise, components, louvain, similarity_links
from tessera.session import Scratch
from tessera.sources.keyed_store import KeyedStore

#: Fixed values: (task, outcome) -> next tasks.
TRANSITIONS = (
    ("MARKET_SIZING", "SUCCESS", ("EXTRACT_COMPANIES",)),
    ("MARKET_SIZING", "FAILED", ("HALT_PIPELINE",)),
    ("EXTRACT_COMPANIES", "SUCCESS", ("ENRICH_COMPANY", "PLAN_COMPANY_SEARCH")),
    ("EXTRACT_COMPANIES", "FAILED", ("HALT_PIPELINE",)),
    ("ENRICH_COMPANY", "SUCCESS", ("SAVE_TO_NEO4J",)),
    ("ENRICH_COMPANY", "FAILED", ("LOG_AND_CONTINUE",)),
    ("PLAN_COMPANY_SEARCH", "SUCCESS", ("SCRAPE_URL",)),
    ("PLAN_COMPANY_SEARCH", "FAILED", ("LOG_AND_CONTINUE",)),
    ("SCRAPE_URL", "SUCCESS", ("BOUNCER_EVALUATION",)),
    ("SCRAPE_URL", "FAILED", ("MARK_URL_FAILED",)),
    ("BOUNCER_EVALUATION", "IS_RELEVANT", ("VECTOR_STORAGE",)),
    ("BOUNCER_EVALUATION", "NOT_RELEVANT", ("DISCARD",)),
)


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, o, list(n)) for t, o, n in TRANSITIONS], "task string, outcome string, following array<string>")


def next_tasks(finished: DataFrame, retries: int = 3) -> DataFrame:
    """Tasks that follow finished ones (task, outcome, retry_count); failures run again until retries are spent."""
    again = finished.where((F.col("outcome") == "FAILED") & (F.col("retry_count") < retries)).withColumn("retry_count", F.col("retry_count") + 1).withColumn("next_task", F.col("task"))
    over = finished.where((F.col("outcome") != "FAILED") | (F.col("retry_count") >= retries))
    moved = over.join(F.broadcast(transition_table(finished.sparkSession)), ["task", "outcome"])  # 12 rows
    moved = moved.select(*finished.columns, F.explode("following").alias("next_task")).withColumn("retry_count", F.lit(0).cast(finished.schema["retry_count"].dataType))
    return again.unionByName(moved)


def extract_facts(chunks: DataFrame, extractor: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(raw entities, raw relationships) of chunks (pipeline_id, source_url, seq, raw_text), last write winning.

    Chunks are dealt over all tasks first: a small file may hold many. One without a sound
    extraction has a null there, and no rows below.
    """
    spark = chunks.sparkSession
    scratch = Scratch(spark, "facts")
    named = ["pipeline_id", "source_url", "seq"]
    dealt = chunks.select(*named, "raw_text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *named, "raw_text")
    parsed = scratch.table(dealt.select(*named, parse_strict(extractor(F.col("raw_text"))).alias("x")), "parsed")
    entity = parsed.select("pipeline_id", "source_url", "seq", F.posexplode("x.entities").alias("at", "e")).select("pipeline_id", "source_url", "seq", "at", "e.*")
    link = parsed.select("pipeline_id", "source_url", "seq", F.posexplode("x.relationships").alias("at", "r")).select("pipeline_id", "source_url", "seq", "at", "r.*")
    links = last_write(link, ["pipeline_id", "source", "target", "type"], ["seq", "at"])
    entities = last_write(entity, ["pipeline_id", "name"], ["seq", "at"]).select("pipeline_id", "name", "type", "description", "source_url")
    ends = links.select("pipeline_id", F.explode(F.array("source", "target")).alias("name")).distinct().join(entities, ["pipeline_id", "name"], "left_anti")
    return entities.unionByName(ends, allowMissingColumns=True), links.select("pipeline_id", "source", "target", "type", "exact_quote", "source_url")


def build_graph(chunks: DataFrame, extractor: Callable, embedder: Callable, verdict: Callable) -> dict[str, DataFrame]:
    """The graphs of all pipelines in ``chunks``: vertices with communities, weighted edges, mentions.

    Nothing is merged across pipelines. Steps: extraction, resolution of similar names, edge
    collapse, Louvain communities of each pipeline's raw relationships (a vertex without any is
    its own), pruning of supernodes that ``verdict`` condemns, document mentions. Each lands as a table.
    """
    scratch = Scratch(chunks.sparkSession, "graph")
    entities, links = (scratch.table(t, n) for t, n in zip(extract_facts(chunks, extractor), ("entities", "links")))
    raw = scratch.table(entities.select(stable_id(F.col("pipeline_id"), F.col("name")).alias("id"), "pipeline_id", "name", "type", "description", "source_url", embedder(F.col("name")).alias("vector")), "raw")
    component = scratch.table(components(raw, similarity_links(raw, "vector", within="pipeline_id")), "components")
    pipelines = raw.select(F.col("id").alias("component"), "pipeline_id")
    vertices = scratch.table(canonicalise(raw, component).join(pipelines, "component").withColumnRenamed("component", "id"), "vertices")
    resolves = component.select(F.col("id").alias("raw"), F.col("component").alias("canonical"))
    edges = links.select(stable_id(F.col("pipeline_id"), F.col("source")).alias("src"), stable_id(F.col("pipeline_id"), F.col("target")).alias("dst"), "type", F.col("exact_quote").alias("quote"), F.col("source_url").alias("url"))
    collapsed = scratch.table(collapse_edges(edges, resolves), "edges")
    projected = resolve_edges(edges, resolves).select("src", "dst").join(vertices.select(F.col("id").alias("src"), "pipeline_id"), "src")  # a row a raw relationship
    found = louvain(projected, "pipeline_id").select("id", F.col("community").alias("__community"))
    vertices = vertices.join(found, "id", "left").withColumn("community", F.coalesce("__community", "id")).drop("__community")
    vertices = scratch.table(vertices, "vertices")
    vertices, collapsed = (scratch.table(t, n) for t, n in zip(prune_supernodes(vertices, collapsed, verdict), ("pruned_vertices", "pruned_edges")))
    mentions = mention_edges(raw.select("source_url", "id").select(F.col("source_url").alias("url"), F.col("id").alias("raw")), edges, resolves)
    mentions = mentions.join(vertices.select(F.col("id").alias("entity")), "entity", "left_semi")
    return {"vertices": vertices, "edges": collapsed, "mentions": scratch.table(mentions, "mentions")}


#: Keys of a stored graph's tables, and those that choose a row's bucket.
GRAPH_KEYS = {"vertices": (["id"], ["id"]), "edges": (["src", "dst", "type"], ["src"]), "mentions": (["document", "entity"], ["entity"])}


def store_graph(graph: dict[str, DataFrame], root: str, writer: str = "build", batch: int | None = None, buckets: int = 64) -> dict[str, KeyedStore]:
    """Merge the tables of ``build_graph`` into stored ones below ``root``; rows that are there are replaced by key.

    A build that is run again with the same ``batch`` changes nothing.
    """
    stores = {}
    for name, (keys, bucket_by) in GRAPH_KEYS.items():
        rows = graph[name]
        stores[name] = KeyedStore(rows.sparkSession, f"{root}/{name}", rows.schema, keys, bucket_by, buckets)
        stores[name].upsert(rows, keys, writer, batch)
    return stores


def enrich_store(vertices: KeyedStore, found: DataFrame, facts: list[str], writer: str = "enrichment", batch: int | None = None) -> None:
    """Merge companies' facts into a stored vertex table (id, pipeline_id, name, type, facts, ...).

    Vertices of a company's name and pipeline are filled and companies without one are added, as
    ``upsert_companies`` has it; only these rows are written.
    """
    names = found.select("pipeline_id", "name").distinct()
    near = vertices.read().join(names, ["pipeline_id", "name"], "left_semi")
    merged = upsert_companies(near.select("id", "pipeline_id", "name", "type", *facts), found, facts)
    rest = [f.name for f in vertices.schema if f.name not in merged.columns]
    vertices.upsert(merged.join(near.select("id", *rest), "id", "left"), ["id"], writer, batch)


def retrieval_context(chunks: DataFrame, urls: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """One text of the k chunks nearest to the query among the given sources, numbered from 1."""
    from tessera.operators.similarity import nearest

    wanted = urls.select(F.trim("url").alias("url")).where("url <> ''").distinct()
    near = nearest(chunks.join(wanted, "url", "left_semi"), query, "chunk_id", "embedding", k)  # k rows from here on
    rows = near.join(chunks.select("chunk_id", "url", "text"), "chunk_id").withColumn("n", F.row_number().over(Window.orderBy("distance", "chunk_id")))
    line = F.format_string("--- Chunk %d [Source: %s] ---\n%s\n\n", F.col("n"), F.col("url"), F.col("text"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda r: r["t"]), "").alias("context"))


def with_fallback(urls: DataFrame, fetch: Callable[[DataFrame], DataFrame], proxy: Callable[[DataFrame], DataFrame], retries: int = 3) -> DataFrame:
    """(url, status, text, by_proxy) of each URL: fetched, through the proxy where it is denied.

    Both functions take (url, attempt) and give (url, status, text). Statuses 401 and 403
    go to the proxy, whose text is cut to 15,000 characters; 429 and 5xx are tried again,
    up to ``retries`` times, with ``backoff_seconds`` as the time to wait before each.
    """
    from tessera.functions.text import backoff_seconds, prefix

    scratch = Scratch(urls.sparkSession, "fetch")
    busy = (F.col("status") == 429) | F.col("status").between(500, 599)

    def attempts(call: Callable[[DataFrame], DataFrame], wanted: DataFrame, name: str) -> DataFrame:
        ask = lambda rows, attempt: rows.select("url", F.lit(attempt).alias("attempt"), backoff_seconds(F.lit(attempt)).alias("wait"))
        got = scratch.table(call(ask(wanted, 0)).select("url", "status", "text"), name)
        for attempt in range(1, retries + 1):
            again = got.where(busy)
            if again.isEmpty():
                break
            got = scratch.table(got.where(~busy).unionByName(call(ask(again, attempt)).select("url", "status", "text")), name)
        return got

    direct = attempts(fetch, urls.select("url").distinct(), "direct").withColumn("by_proxy", F.lit(False))
    denied = F.col("status").isin(401, 403)
    proxied = attempts(proxy, direct.where(denied), "proxy").select("url", "status", prefix(F.col("text")).alias("text"), F.lit(True).alias("by_proxy"))
    return direct.where(~denied).unionByName(proxied)


SEARCHES = {"site": "{} official website", "funding": "{} funding", "founders": "{} founders", "news": "{} news"}


def enrich_companies(companies: DataFrame, search: Callable[[DataFrame], DataFrame], synthesise: Callable[[Column, Column], Column], per_search: int = 3) -> DataFrame:
    """(company, dossier, urls): four searches for each company, their distinct results as labelled text, and its synthesis.

    ``search`` takes (company, label, query) and gives these with (rank, url, snippet); the first
    ``per_search`` results of each search count and a URL counts once, where it comes first.
    ``synthesise`` makes struct<urls:array<string>> of company and text; where it lists no
    URL, those that were gathered stand.
    """
    labels = list(SEARCHES)
    asked = companies.select("company", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("turn", "label"))
    asks = F.element_at(F.array(*[F.replace(F.lit(SEARCHES[x]), F.lit("{}"), F.col("company")) for x in labels]), F.col("turn") + 1)
    found = search(asked.withColumn("query", asks)).where(F.col("rank") <= per_search)
    once = found.groupBy("company", "url").agg(F.min(F.struct("turn", "rank", "label", "snippet")).alias("r")).select("company", "url", "r.*")
    line = F.format_string("[%s] %s: %s", F.col("label"), F.col("url"), F.coalesce("snippet", F.lit("")))
    texts = once.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("turn", "rank", "url", line.alias("line")))).alias("rows"))  # at most 4 * per_search
    texts = companies.join(texts, "company", "left").withColumn("rows", F.coalesce("rows", F.array().cast(texts.schema["rows"].dataType)))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    out = texts.select("company", text.alias("dossier"), F.transform("rows", lambda r: r["url"]).alias("gathered")).withColumn("answer", synthesise(F.col("company"), F.col("dossier")))
    return out.select("company", "dossier", F.when(F.size("answer.urls") > 0, F.col("answer.urls")).otherwise(F.col("gathered")).alias("urls"))


def entity_briefing(ego: DataFrame, context: DataFrame) -> DataFrame:
    """(prompt): a vertex's relations, heaviest first, and the retrieved text, as one prompt.

    ``ego`` is one vertex's network as ``ego_entity`` or ``ego_document`` give it, served
    to a reader and so bounded by what is shown: the 50 heaviest relations.
    """
    top = ego.where("name IS NOT NULL").orderBy(F.desc("weight"), "name", "rel_type").limit(50)
    line = F.format_string("- %s %s (weight %s)", F.col("rel_type"), F.col("name"), F.format_number("weight", 2))
    lines = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name", "rel_type", line.alias("t")))), lambda r: r["t"]), "\n").alias("relations"))
    return lines.crossJoin(F.broadcast(context)).select(F.concat(F.lit("Relations:\n"), "relations", F.lit("\n\nSources:\n"), F.coalesce("context", F.lit(""))).alias("prompt"))  # one row each


def answer(ego: DataFrame, chunks: DataFrame, urls: DataFrame, embedder: Callable[[Column], Column], answerer: Callable[[Column], Column], k: int = 10) -> DataFrame:
    """(central_id, central_name, relations, prompt, answer): what a caller's function says about a vertex.

    ``ego`` is the vertex's network as ``ego_entity`` gives it (central_id, central_name, neighbour,
    neighbour_name, rel_type, weight). The question is its name; the ``k`` chunks
    (chunk_id, url, text, embedding) of ``urls`` nearest to the question's embedding are its sources.
    """
    ego = Scratch(ego.sparkSession, "ego").table(ego, "network")  # read for the question, the relations and their number
    centre = ego.select("central_id", "central_name").distinct()  # one row
    question = centre.select(embedder(F.col("central_name")).alias("v")).first()
    context = retrieval_context(chunks, urls, question["v"], k) if question else ego.sparkSession.createDataFrame([("",)], "context string")
    shown = ego.select(F.col("neighbour_name").alias("name"), "rel_type", F.col("weight").cast("double").alias("weight"))
    counted = ego.groupBy("central_id", "central_name").agg(F.count("neighbour").alias("relations"))
    out = counted.crossJoin(F.broadcast(entity_briefing(shown, context)))  # one row each
    return out.withColumn("answer", answerer(F.col("prompt")))


def relation_urls(edges: DataFrame, mentions: DataFrame, centre) -> DataFrame:
    """(url): sources of a vertex, the urls of its edges and the documents that mention it, trimmed, each once."""
    own = edges.where((F.col("src") == F.lit(centre)) | (F.col("dst") == F.lit(centre))).select(F.explode("source_urls").alias("url"))
    said = mentions.where(F.col("entity") == F.lit(centre)).select(F.col("document").alias("url"))
    return own.unionByName(said).select(F.trim("url").alias("url")).where("url <> ''").distinct()


def acquire(
    search: Callable[[int], DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    keywords: list[str],
    least_urls: int = 200,
    most_rounds: int = 5,
    least_relevant: int = 0,
    cancelled: Callable[[], bool] = lambda: False,
) -> DataFrame:
    """Search until enough distinct URLs are known or rounds are spent, then fetch and gate them.

    ``search(round)`` gives (url, rank) and ``fetch(urls)`` (url, text). Blocked domains
    are skipped; the result has the reason why a text was kept out, null if it passed.
    While fewer than ``least_relevant`` texts pass, rounds go on with URLs not yet fetched;
    ``cancelled`` is asked before each round, and what is there by then is returned.
    """
    from tessera.functions.text import blocked_domain, keyword_gate

    scratch, done, attempt = None, None, 0
    while True:
        found, attempt = search(attempt), attempt + 1
        scratch = scratch or Scratch(found.sparkSession, "acquire")
        while attempt < most_rounds and not cancelled() and found.select("url").distinct().count() < least_urls:
            found, attempt = found.unionByName(search(attempt)), attempt + 1
        urls = found.groupBy("url").agg(F.min("rank").alias("rank")).where(~blocked_domain(F.col("url")))
        urls = urls if done is None else urls.join(done.select("url"), "url", "left_anti")
        gated = scratch.table(fetch(urls).withColumn("rejected", keyword_gate(F.col("text"), keywords)), "gated")
        done = gated if done is None else done.unionByName(gated)
        if attempt >= most_rounds or cancelled() or done.where("rejected IS NULL").count() >= least_relevant:
            return done

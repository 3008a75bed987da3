"""Operators on small hand-made tables, with edge cases."""

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import records, text, vectors
from tessera.operators import graph, relational, resolve, similarity
from tessera.plans import workflow
from tessera.sources import connectors
from tessera.streaming import events


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=lambda t: [(v is not None, v if v is not None else 0) for v in t])


def test_collapse_drops_self_loops_and_blank_quotes(spark):
    raw = spark.createDataFrame([("a", "c", "T", "q1", "u"), ("b", "c", "T", "", None), ("a", "b", "T", "x", "u"), ("a", "z", "T", "x", "u")], "src string, dst string, type string, quote string, url string")
    resolves = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "raw string, canonical long")
    out = graph.collapse_edges(raw, resolves, evidence=True).first()
    assert (out.src, out.dst, out.weight, out.quotes, out.source_urls, len(out.evidence)) == (1, 2, 2, ["q1"], ["u"], 2)
    assert rows(graph.edge_counts(raw, resolves), "src", "dst", "weight") == [(1, 1, 1), (1, 2, 2)]


def test_degree_bounds_and_detach(spark):
    v = spark.createDataFrame([(i, str(i), "T") for i in range(60)], "id long, name string, type string")
    e = spark.createDataFrame([(0, i) for i in range(1, 51)] + [(1, 1), (0, 51)], "src long, dst long")
    degree = dict(graph.degrees(v, e).select("id", "degree").collect())
    assert degree[0] == 51 and degree[1] == 2 and degree[59] == 0
    assert rows(graph.supernodes(v, e), "id") == [(0,)]
    assert rows(graph.supernodes(v, e.where("dst <> 51")), "id") == []
    left, kept = graph.detach_delete(v, e, v.where("id = 0"))
    assert left.count() == 59 and rows(kept) == [(1, 1)]


def test_bridges_are_mentioned_by_2_to_15(spark):
    pairs = [(d, n) for n in (1, 2, 15, 16) for d in range(n)]
    mentions = spark.createDataFrame(pairs + [(0, 1)], "document long, entity long")
    assert rows(graph.bridge_entities(mentions)) == [(2,), (15,)]


def test_documents_theme_keeps_isolated(spark):
    docs = spark.createDataFrame([(1, "t", "u1"), (2, None, "u2"), (3, None, "u3")], "id long, title string, url string")
    similar = spark.createDataFrame([(1, 2, 0.9)], "src long, dst long, weight double")
    none = spark.createDataFrame([], "document long, entity long")
    v = spark.createDataFrame([], "id long, name string, type string")
    assert rows(graph.theme_documents(docs, similar, none, v), "src", "dst", "weight") == [(1, 2, 0.9), (2, 1, 0.9), (3, None, 0.5)]


def test_regulatory_needs_a_full_match_on_one_line(spark):
    df = spark.createDataFrame([("Regulator",), ("a\nlaw",), ("Contractor",), ("Bank",)], "type string")
    assert rows(df.where(F.col("type").rlike(graph.REGULATORY))) == [("Contractor",), ("Regulator",)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "k")], "key string, v string, w string")
    new = spark.createDataFrame([("a", "1", None), ("a", "2", "m"), ("c", None, "n")], "key string, v string, w string")
    once = relational.upsert(old, new, ["key"], ["v"])
    assert rows(once) == [("a", "2", "m"), ("b", "y", "k"), ("c", None, "n")]
    assert rows(relational.upsert(once, new, ["key"], ["v"])) == rows(once)
    assert rows(relational.upsert(old, new.where("key = 'c'"), ["key"], ["v"], fill=True)) == [("a", "x", None), ("b", "y", "k"), ("c", None, "n")]


def test_get_or_create_folds_case(spark):
    have, want = spark.createDataFrame([("Space",)], "name string"), spark.createDataFrame([("SPACE",), ("grid",), ("Grid",)], "name string")
    assert relational.get_or_create(have, want, ["name"], fold_case=True).count() == 2


def test_status_whitelist(spark):
    with pytest.raises(ValueError):
        relational.set_status(spark.range(1).withColumn("status", F.lit("idle")), F.lit(True), "unknown")


def test_canonical_vertex_rules(spark):
    e = spark.createDataFrame(
        [(1, "Beta Co", "X", None), (2, "Beta", "Y", "d"), (3, "Bets", "", "dd"), (4, "Solo", None, None), (5, "Beta", "Y", "ee")], "id long, name string, type string, description string"
    )
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 1), (4, 4)], "id long, component long")
    assert rows(resolve.canonicalise(e, c)) == [(1, "Beta", "Y", "dd", 4), (4, "Solo", "Unknown", "", 1)]


def test_components_of_chain_and_shuffled_rows(spark):
    ids = list(range(40))
    nodes = spark.createDataFrame([(i,) for i in ids + [99]], "id long")
    chain = [(i, i + 1) for i in range(39)]
    a = resolve.components(nodes, spark.createDataFrame(chain, "src long, dst long"))
    b = resolve.components(nodes, spark.createDataFrame(chain[::-1], "src long, dst long"))
    assert rows(a) == rows(b) == [(i, 0) for i in ids] + [(99, 99)]


def test_louvain_finds_two_cliques(spark):
    clique = lambda lo: [("p", i, j) for i in range(lo, lo + 5) for j in range(i + 1, lo + 5)]
    out = dict(resolve.louvain(spark.createDataFrame(clique(0) + clique(5) + [("p", 0, 5)], "scope string, src long, dst long"), "scope").select("id", "community").collect())
    assert len({out[i] for i in range(5)}) == 1 and len(set(out.values())) == 2


def test_community_summary_limits(spark):
    members = spark.createDataFrame([(1, f"n{i:02d}") for i in range(51)] + [(2, "a"), (2, "b")], "community long, name string")
    out = resolve.community_summaries(members).collect()
    assert len(out) == 1 and out[0]["names"].endswith("n49...") and out[0]["size"] == 51


def test_similarity_thresholds(spark):
    unit = lambda c: [c, float(np.sqrt(1 - c * c))]
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", unit(0.35)), ("c", unit(0.3)), ("d", None)], "k string, v array<double>")
    assert rows(similarity.semantic_funnel(chunks, chunks.where("k = 'a'"), "k", "v", 0.35 - 1e-12), "k") == [("a",), ("b",)]
    pairs = similarity.similar_groups(chunks, "k", "v", over=0.85, block_rows=1)
    assert rows(pairs, "src", "dst") == [("b", "c")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=3, max_size=3), min_size=1, max_size=4))
def test_cosine_matches_numpy(spark, data):
    df = spark.createDataFrame([(v, [1.0, 2.0, 3.0]) for v in data], "a array<double>, b array<double>")
    for (got,), v in zip(df.select(vectors.cosine(F.col("a"), F.col("b"))).collect(), data):
        size = np.linalg.norm(v) * np.linalg.norm([1, 2, 3])
        if size > 1e-6:
            assert got == pytest.approx(float(np.dot(v, [1, 2, 3]) / size), abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_chunks_are_bounded_and_cover_words(body):
    chunks = text.split_recursive(body, 40, 10)
    assert all(0 < len(c) <= 40 for c in chunks)
    assert set("".join(body.split())) == set("".join("".join(chunks).split()))


def test_gates_and_kinds(spark):
    df = spark.createDataFrame([("https://x/A.PDF", "s" * 199), ("b.xlsx?", "grid " * 60), ("c.csv", ""), (None, None)], "url string, body string")
    out = df.select(text.url_kind(F.col("url")), text.keyword_gate(F.col("body"), ["grid", " "]), text.length_route(F.length("body"))).collect()
    assert [tuple(r) for r in out] == [("pdf", "short", "reject"), ("html", None, "process"), ("spreadsheet", "empty", "reject"), ("html", "empty", "process")]
    sizes = spark.createDataFrame([(199,), (200,), (500000,), (500001,)], "n long")
    assert [r[0] for r in sizes.select(text.length_route(F.col("n"))).collect()] == ["reject", "process", "process", "pending"]
    stages = spark.createDataFrame([("Community round",), ("pending",), ("Seed",), ("Public utility",)], "s string")
    assert [r[0] for r in stages.select(text.stage_kind(F.col("s"))).collect()] == ["Utility", "Investor", "Startup", "Incumbent"]


def test_json_strict_and_lenient(spark):
    good = '```json\n{"entities": [{"name": "a", "type": "b"}], "relationships": []}\n```'
    bad = '{"entities": [{"name": 5, "type": "b"}, {"name": "c", "type": "d"}], "relationships": [{"source": "c", "target": "d", "type": "r"}]}'
    df = spark.createDataFrame([(1, good), (2, bad), (3, '{"entities": ['), (4, None)], "k long, raw string")
    assert [r[0] is not None for r in df.select(records.parse_strict(F.col("raw"))).collect()] == [True, False, False, False]
    entities, links = records.parse_lenient(df, "k", "raw")
    assert rows(entities) == [(1, "a", "b"), (2, "c", "d")] and rows(links) == [(2, "c", "d", "r", "")]


def test_metadata_and_flattening(spark):
    df = spark.createDataFrame([('{"source_url": "u"}',), ('"{\\"source_url\\": \\"w\\"}"',), ("x",)], "m string")
    assert [r[0] for r in df.select(records.metadata_field(F.col("m"), "source_url")).collect()] == ["u", "w", None]
    kind = "id long, c struct<name:string,score:double,tags:array<string>,inner:struct<x:string>,people:array<struct<n:string>>>"
    assert rows(records.flatten_record(spark.createDataFrame([(1, None)], kind), "c")) == [(1, "", 0.0, [], "", "[]")]


def test_office_text():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    assert connectors.office_text(buffer.getvalue(), "docx") == "one two"


def test_transitions_and_retries(spark):
    done = spark.createDataFrame([("EXTRACT_COMPANIES", "SUCCESS", 0), ("SCRAPE_URL", "FAILED", 1), ("SCRAPE_URL", "FAILED", 3)], "task string, outcome string, retry_count int")
    assert rows(workflow.next_tasks(done), "next_task", "retry_count") == [("ENRICH_COMPANY", 0), ("MARK_URL_FAILED", 0), ("PLAN_COMPANY_SEARCH", 0), ("SCRAPE_URL", 2)]


def test_build_graph_with_stand_ins(spark):
    chunks = spark.createDataFrame([("p", "u1", 1, "Alpha buys Beta near Gamma"), ("p", "u2", 2, "Beta sells to Gamma"), ("p", "u3", 3, None)], "pipeline_id string, source_url string, seq long, raw_text string")
    out = workflow.build_graph(chunks, connectors.stub_extractor, connectors.hashed_embedding, lambda name, kind: F.lit(False))
    assert rows(out["vertices"], "name") == [("Alpha",), ("Beta",), ("Gamma",)]
    assert out["mentions"].count() == 4 and out["edges"].count() >= 2


def test_acquire_searches_until_enough(spark):
    search = lambda i: spark.createDataFrame([(f"http://a/{i}", i), ("http://ft.com/x", 0)], "url string, rank int")
    fetch = lambda urls: urls.withColumn("text", F.repeat(F.lit("grid "), 50))
    assert rows(workflow.acquire(search, fetch, ["grid"], least_urls=3), "url", "rejected") == [("http://a/0", None), ("http://a/1", None)]


def test_stream_fold_equals_batch(spark, tmp_path):
    data = [("s", i, "queue_update", f"u{i % 3}", f"st{i}") for i in range(20)]
    df = spark.createDataFrame(data, "site_id string, seq long, type string, url string, status string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.latest_status(source, ["site_id", "url"]).writeStream.outputMode("complete").format("memory").queryName("fold").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("fold")) == rows(events.latest_status(df, ["site_id", "url"]))
    seen = []
    q = events.relay(source, lambda batch, n: seen.append(batch.count()), str(tmp_path / "ck"), None).start()
    q.awaitTermination(60)
    assert sum(seen) == 20


def test_progress_states(spark):
    df = spark.createDataFrame([("a", 1, "Extract", 5, 10), ("a", 2, "Complete", 6, 10), ("b", 1, "Error", 1, 0), ("c", 3, "Extract", 1, 8)], "k string, seq long, current_phase string, processed_chunks int, total_chunks int")
    assert rows(events.progress(df, "k"), "k", "percent", "state") == [("a", 100, "complete"), ("b", 0, "error"), ("c", 13, "running")]


def test_labels_settle_on_swapping_neighbours(spark):
    """A pair and a star, on which labels that all change at once would swap for ever."""
    e = spark.createDataFrame([(1, 2)] + [(10, i) for i in range(11, 16)], "src long, dst long")
    out = {r.id: r.community for r in resolve.label_propagation(e).collect()}
    assert out[1] == out[2] and len({out[i] for i in range(10, 16)}) == 1


def test_louvain_keeps_scopes_apart_and_sums_parallel_edges(spark):
    cliques = [(p, a + k, b + k) for p in ("x", "y") for k in (0, 10, 20) for a in range(4) for b in range(a)]
    bridges = [(p, 0, 10) for p in ("x", "y")] + [(p, 10, 20) for p in ("x", "y")]
    e = spark.createDataFrame(cliques * 3 + bridges, "p string, src long, dst long")
    out = resolve.louvain(e, "p").collect()
    assert len(out) == 24 and {(r.p, r.community) for r in out} == {(p, k) for p in ("x", "y") for k in (0, 10, 20)}
    assert all(r.community == r.id // 10 * 10 for r in out)
    assert resolve.louvain(e.where("false"), "p").count() == 0


def test_graph_of_two_pipelines_is_not_merged(spark):
    chunks = spark.createDataFrame([(p, f"u{p}", i, "Alpha met Beta. Alpha left.") for p in (1, 2) for i in range(2)], "pipeline_id long, source_url string, seq long, raw_text string")
    out = workflow.build_graph(chunks, connectors.stub_extractor, connectors.hashed_embedding, lambda name, kind: F.lit(False))
    assert rows(out["vertices"].groupBy("pipeline_id", "name").count()) == [(p, n, 1) for p in (1, 2) for n in ("Alpha", "Beta", "Left") if n != "Left"]


def test_companies_fill_all_same_name_nodes(spark):
    v = spark.createDataFrame([(1, 7, "Acme", "Startup", None), (2, 7, "Acme", "Investor", "old"), (3, 7, "Acme", "Person", None), (4, 8, "Acme", "Company", None)], "id long, pipeline_id long, name string, type string, stage string")
    found = spark.createDataFrame([(7, "Acme", "Company", "seed"), (7, "New", "Company", None)], "pipeline_id long, name string, type string, stage string")
    out = rows(graph.upsert_companies(v, found, ["stage"]), "pipeline_id", "name", "type", "stage")
    assert sorted(map(str, out)) == sorted(map(str, [(7, "Acme", "Startup", "seed"), (7, "Acme", "Investor", "seed"), (7, "Acme", "Person", None), (8, "Acme", "Company", None), (7, "New", "Company", None)]))


def test_acquire_goes_on_until_enough_are_relevant(spark):
    asked = []

    def search(attempt):
        asked.append(attempt)
        return spark.createDataFrame([(f"https://s.org/{attempt}-{i}", i) for i in range(3)], "url string, rank int")

    fetch = lambda urls: urls.select("url", F.when(F.col("url").contains("/2-"), F.lit("wind power " * 40)).otherwise("none").alias("text"))
    out = workflow.acquire(search, fetch, ["wind"], least_urls=3, most_rounds=5, least_relevant=2)
    assert asked == [0, 1, 2] and out.count() == 9 and out.where("rejected IS NULL").count() == 3
    asked.clear()
    assert workflow.acquire(search, fetch, ["wind"], least_urls=3, least_relevant=2, cancelled=lambda: True).count() == 3 and asked == [0]


def test_sink_writes_in_bulks(spark, tmp_path):
    spark.range(1250).coalesce(1).write.parquet(str(tmp_path / "in"))
    written = []
    sink = events.batching_sink(lambda bulk, number: written.append((number, sorted(r.id for r in bulk.collect()))), ["id"])
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    events.relay(stream, sink, str(tmp_path / "checkpoint"), seconds=None).start().awaitTermination(120)
    assert [len(ids) for _, ids in sorted(written)] == [500, 500, 250] and sum((ids for _, ids in sorted(written)), []) == list(range(1250))


def test_briefing_lists_relations_and_sources(spark):
    ego = spark.createDataFrame([("B", "OWNS", 2.0), ("A", "NEAR", 3.0), (None, None, None)], "name string, rel_type string, weight double")
    prompt = workflow.entity_briefing(ego, spark.createDataFrame([("text",)], "context string")).first().prompt
    assert prompt == "Relations:\n- NEAR A (weight 3.00)\n- OWNS B (weight 2.00)\n\nSources:\ntext"

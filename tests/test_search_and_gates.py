"""Vector search in cells, communities, keyword automata, main text, the archive and database reads."""

import csv
import io
import itertools
import zipfile
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import keywords
from tessera.operators import main_text, relational, resolve, similarity, vector_index
from tessera.sources import archive, connectors


def clustered(rng, n, clusters, width=16, spread=0.15):
    centres = rng.normal(size=(clusters, width))
    return centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))


def brute_groups(groups, vectors, over):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims, best = unit @ unit.T, {}
    for a, b in zip(*np.nonzero(sims > over)):
        if groups[a] < groups[b]:
            best[groups[a], groups[b]] = max(best.get((groups[a], groups[b]), -2), sims[a, b])
    return {k: round(v, 9) for k, v in best.items()}


@pytest.mark.parametrize("over", [0.85, 0.3, -0.2])
def test_similarity_in_cells_is_exact(spark, over):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([clustered(rng, 300, 12), rng.normal(size=(100, 16)), np.repeat(rng.normal(size=(1, 16)), 60, 0)])
    groups = [f"g{i:03d}" for i in rng.integers(0, 150, len(vectors))]
    df = spark.createDataFrame([(g, list(map(float, v))) for g, v in zip(groups, vectors)] + [("g000", None), ("z", []), ("z", [1.0, 2.0]), ("y", [2.0, 4.0])], "g string, v array<double>")
    got = {(r.src, r.dst): round(r.weight, 9) for r in similarity.similar_groups(df, "g", "v", over, block_rows=32).collect()}
    want = brute_groups(groups, vectors, over) | {("y", "z"): 1.0}
    assert {k: v for k, v in got.items()} == pytest.approx(want) and got.keys() == want.keys()


def test_cells_compare_fewer_pairs_than_blocks(spark):
    """2,000 rows in 40 clusters at the usual threshold: how many pairs are multiplied, against all n * n / 2."""
    rng = np.random.default_rng(8)
    n = 2000
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(clustered(rng, n, 40, 32, 0.08))], "g long, v array<double>")
    cells = similarity.compared_pairs(df, "g", "v", 0.85, block_rows=50)
    blocks = similarity.compared_pairs(df, "g", "v", -1.0, block_rows=50)
    print(f"pairs multiplied: {cells} in cells, {blocks} in blocks")
    assert blocks >= n * n / 2 and cells < blocks / 3
    shut = similarity.compared_pairs(df.withColumn("s", F.col("g") % 2), "g", "v", -1.0, block_rows=50, within="s")
    assert shut < blocks * 0.6


def test_copies_of_a_row_do_not_grow_with_its_scope(spark):
    """Random vectors at a low threshold: all meet all, in products whose rows are a bounded number of copies."""
    rng = np.random.default_rng(5)
    copies = []
    for n in (600, 2400):
        df = spark.createDataFrame([(i % 7, list(map(float, v))) for i, v in enumerate(rng.normal(size=(n, 8)))], "g long, v array<double>")
        copies.append(similarity._celled(df, "g", "v", 0.3, 10, None, 1 << 22).count() / n)
    assert max(copies) <= 2 * similarity.SPLIT and copies[1] < 1.5 * copies[0]


@pytest.mark.parametrize("over, block_rows", [(0.85, 32), (0.5, 16), (0.3, 8)])
def test_classes_have_the_components_of_all_pairs(spark, over, block_rows):
    rng = np.random.default_rng(6)
    vectors = np.concatenate([clustered(rng, 200, 9), rng.normal(size=(60, 16)), np.repeat(rng.normal(size=(1, 16)), 40, 0), np.zeros((2, 16))])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "id long, v array<double>")
    links = similarity.similar_classes(df, "id", "v", over, block_rows=block_rows)
    assert links.count() <= 2 * similarity.SPLIT * len(vectors)
    frame = links.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst")])
    got = {r.id: r.component for r in resolve.components(df, frame).collect()}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    near, want = unit @ unit.T > over, np.arange(len(vectors))
    while ((low := np.minimum(want, np.where(near, want[None], len(want)).min(1))) != want).any():
        want = low
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_documents_of_one_site_do_not_meet_in_one_task(spark, most, monkeypatch):
    monkeypatch.setattr(keywords, "BROADCAST_CHARS", most)
    sites = spark.createDataFrame([("en", ["the", "of the"]), ("de", ["ein"]), ("es", [])], "lang string, words array<string>")
    docs = [(i, lang, f"The end of the line {i}") for i, lang in enumerate(["en"] * 400 + ["de", "es", "xx", None])]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = keywords.site_keyword_hits(spark.createDataFrame(docs, "id long, lang string, text string").repartition(4, "id"), sites, "lang", "text", "words")
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.id: r.hits for r in got} == {i: 3 if lang == "en" else 0 for i, lang, _ in docs}
    tasks = [r.task for r in got if r.lang == "en"]
    assert max(map(tasks.count, tasks)) < 300


def test_extractions_are_parsed_once_a_row(spark):
    from tessera.functions import records

    df = spark.createDataFrame([('```json {"entities": [{"name": "a", "type": "b"}], "relationships": []} ```',), ('{"entities": [{"name": "a"}], "relationships": []}',), ("no",), (None,)], "raw string")
    out = df.select(records.parse_strict(F.col("raw")).alias("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r.x and r.x.entities[0].name for r in out.collect()] == ["a", None, None, None]


def test_mentions_are_dealt_before_they_are_resolved(spark):
    from tessera.operators import graph

    links = spark.createDataFrame([(f"s{i}", f"p{i % 3}", f"u{i % 50}") for i in range(300)], "src string, dst string, url string").coalesce(1)
    own = spark.createDataFrame([("u1", "s1"), (None, "s2")], "url string, raw string").coalesce(1)
    resolves = spark.createDataFrame([(f"s{i}", f"n{i % 2}") for i in range(300)] + [(f"p{i}", f"b{i}") for i in range(3)], "raw string, canonical string")
    found = graph.mention_edges(own, links, resolves)
    want = {(f"u{i % 50}", e) for i in range(300) for e in (f"n{i % 2}", f"b{i % 3}")}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_indexed_search_is_exact_or_measured(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([clustered(rng, 1400, 30, 24, 0.7), rng.normal(size=(100, 24)), np.zeros((2, 24))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)] + [(9000, None), (9001, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    centroids = vector_index.fit_centroids(df.where("id < 1500"), "v", 20, sample_rows=600)
    index = vector_index.VectorIndex.build(df, "id", "v", centroids, f"{tmp_path}/lists")
    assert index.rows.count() == 1500
    queries = df.where("id % 100 = 0")
    unit = vectors[:1500] / np.linalg.norm(vectors[:1500], axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 12)
    want = sorted((q, int(i), rank + 1) for q in range(0, 1500, 100) for rank, i in enumerate(np.lexsort((np.arange(1500), far[q]))[:10]))
    assert sorted((r.query, r.neighbour, r["rank"]) for r in index.search(queries, "id", "v").collect()) == want
    truth = spark.createDataFrame([w[:2] for w in want], "query long, neighbour long")
    probes = vector_index.probes_for(index, df, "id", "v", least=0.95, most_queries=50)
    share = vector_index.recall(index.search(queries, "id", "v", probes=probes), truth)
    print(f"recall {share:.3f} with {probes} of {len(centroids)} lists")
    assert share >= 0.9 and 1 < probes < len(centroids)


def modularity(edges, label):
    m, degree = len(edges), {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(label[a] == label[b] for a, b in edges) / m
    return inside - sum((sum(k for v, k in degree.items() if label[v] == c) / (2 * m)) ** 2 for c in set(label.values()))


def best_modularity(edges):
    """Of all partitions of a few vertices."""
    ids = sorted({v for e in edges for v in e})
    return max(modularity(edges, dict(zip(ids, marks))) for marks in itertools.product(range(3), repeat=len(ids)))


def test_louvain_ends_only_without_gains(spark):
    rng = np.random.default_rng(2)
    scopes = {f"pair{i:02d}": [(i, i + 1)] for i in range(1, 41)}
    for n in range(6):
        scopes[f"small{n}"] = [(int(a), int(b)) for a, b in {tuple(sorted(p)) for p in rng.integers(0, 7, (12, 2))} if a != b]
    scopes["large"] = [(int(a), int(b)) for a, b in {tuple(sorted(p)) for p in rng.integers(0, 60, (150, 2))} if a != b]
    rows = [(s, a, b) for s, edges in scopes.items() for a, b in edges]
    frame = lambda r: spark.createDataFrame(r, "scope string, src long, dst long")
    found = {}
    for r in resolve.louvain(frame(rows), "scope").collect():
        found.setdefault(r.scope, {})[r.id] = r.community
    for name, edges in scopes.items():
        assert modularity(edges, found[name]) >= 0 and settled_levels(edges, found[name]), name
        if name.startswith("pair"):
            assert len(set(found[name].values())) == 1, name
        if name.startswith("small"):
            assert modularity(edges, found[name]) >= 0.8 * best_modularity(edges) - 1e-9, name
    alone = {r.id: r.community for r in resolve.louvain(frame([r for r in rows if r[0] == "small3"]), "scope").collect()}
    assert alone == found["small3"]


def settled_levels(edges, label):
    """No community gains by joining a neighbouring one: what the last level has made sure of."""
    base, names = modularity(edges, label), set(label.values())
    return all(modularity(edges, {v: (b if c == a else c) for v, c in label.items()}) <= base + 1e-9 for a in names for b in names if a != b)


def test_masters_and_first_rows_without_windows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, "x"), (5, "b", "x")], "id long, k string, l string")
    assert {r.id: r.master for r in relational.masters(df, [F.col("k"), F.lower("l")], [-F.col("id")], "id").collect()} == {1: 2, 2: 2, 3: 4, 4: 4, 5: 5}
    first = relational.keep_first(df, ["k"], [F.col("l").isNull(), F.col("id")])
    assert first.columns == df.columns and sorted((r.id for r in first.collect())) == [1, 3, 5]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=30), st.lists(st.text("ab ", max_size=3), max_size=5))
def test_automata_count_as_each_word_alone(text, words):
    assert keywords.WordCounter(words).count(text) == sum(text.count(w) for w in words if w.strip())


def test_sites_have_their_own_words(spark):
    docs = spark.createDataFrame([(1, "x", "Solar solar wind" + " " * 200), (2, "y", "solar wind wind WIND" + "." * 200), (3, "z", "solar"), (4, None, "solar"), (5, "x", None), (6, "x", "solar")], "id long, site string, text string")
    sites = spark.createDataFrame([("x", ["solar", None, " "]), ("y", ["Wind", "ind", "wind"]), ("w", [])], "site string, words array<string>")
    found = keywords.site_keyword_hits(docs, sites, "site", "text", "words")
    out = {r.id: (r.hits, r.why) for r in found.withColumn("why", keywords.density_verdict(F.col("text"), F.col("hits"))).collect()}
    assert out == {1: (2, "low density"), 2: (9, None), 3: (0, "short"), 4: (0, "short"), 5: (0, "empty"), 6: (1, "short")} and "__words" not in found.columns


class Tree(HTMLParser):
    """An independent reading for the test: nested lists of (tag, children)."""

    def __init__(self):
        super().__init__()
        self.root = ("root", [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def brute_main_text(page):
    tree = Tree()
    tree.feed(page)
    nodes, blocks = [], []  # block elements in opening order; (ancestors, text, link characters)

    def words(node, linked=False):
        return [(c, linked) if isinstance(c, str) else w for c in node[1] for w in ([(c, linked)] if isinstance(c, str) else words(c, linked or c[0] == "a"))]

    def visit(node, above):
        run = []

        def flush():
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                blocks.append((above, text, sum(len("".join(t.split())) for t, linked in run if linked)))
            run.clear()

        for child in node[1]:
            if isinstance(child, str):
                run.append((child, False))
            elif child[0] in ("a", "b"):
                run.extend(words(("", [child])))
            elif child[0] == "script":
                flush()
            else:
                flush()
                nodes.append(child)
                visit(child, above + (len(nodes) - 1,))
        flush()

    visit(tree.root, ())
    chars = lambda t: len("".join(t.split()))
    score, size, links = {}, {}, {}
    for above, text, linked in blocks:
        for n in above:
            size[n], links[n] = size.get(n, 0) + chars(text), links.get(n, 0) + linked
        if len(text) >= 25 and linked <= 0.5 * chars(text):
            points = 1 + sum(text.count(c) for c in ",;") + min(len(text) // 100, 3)
            for up, share in ((2, 1), (3, 2)):
                if len(above) >= up:
                    score[above[-up]] = score.get(above[-up], 0) + points / share
    if not score:
        return ""
    main = max(score, key=lambda n: (score[n] * (1 - links[n] / size[n]), -n))
    return "\n\n".join(t for above, t, linked in blocks if main in above and linked <= 0.5 * chars(t))


def random_page(rng):
    sentence = lambda: " ".join("word" * int(rng.integers(1, 3)) for _ in range(rng.integers(2, 30))) + str(rng.choice([",", ".", ";", ", and"]))

    def box(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            link = rng.random() < 0.3
            return f"<p>{'<a>' if link else ''}{sentence()}{'</a>' if link else ''} <b>x</b> {sentence() if rng.random() < 0.5 else ''}</p>"
        if kind < 0.55:
            return "<ul>" + "".join(f"<li><a>{sentence()}</a></li>" for _ in range(rng.integers(1, 5))) + "</ul>"
        if kind < 0.6:
            return f"<script>{sentence()}</script>"
        return "<div>" + "".join(box(depth - 1) for _ in range(rng.integers(1, 5))) + (sentence() if rng.random() < 0.2 else "") + "</div>"

    return "<html><body>" + "".join(box(3) for _ in range(rng.integers(1, 5))) + "</body></html>"


def test_main_text_equals_a_reading_of_each_page(spark):
    rng = np.random.default_rng(6)
    pages = [(i, random_page(rng)) for i in range(150)]
    got = {r.id: r.text for r in main_text.main_text(spark.createDataFrame(pages, "id long, html string"), "id", "html").collect()}
    assert sum(bool(t) for t in got.values()) > 100 and got == {i: brute_main_text(p) for i, p in pages}


def test_main_text_of_planted_pages(spark):
    body = ["A first paragraph of the story, which is long enough to score well in any case.", "The second one goes on, with commas, and more words than a menu has."]
    menu = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(30))
    page = f"<html><head><title>T</title></head><body><div><ul>{menu}</ul></div><div class='x7'><h2>Head</h2><p>{body[0]}</p><div class='ad'><a>Buy this wonderful product now, it is cheap, it is good</a></div><p>{body[1]}</p></div><div><p>Imprint.</p></div></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, f"<div><ul>{menu}</ul></div>"), (5, page.replace("</p>", "").replace("</div>", "")), (6, "<p>unclosed <b>&amp; &lt;broken")]
    got = {r.id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "id long, html string"), "id", "html").collect()}
    assert got[1] == "\n\n".join(["Head", *body]) and [got[i] for i in (2, 3, 4)] == ["", "", ""] and all(b in got[5] for b in body) and got[6] == ""
    assert main_text.main_text(spark.createDataFrame([], "id long, html string"), "id", "html").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_joined_checksums(a, b):
    assert archive.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_archive_holds_both_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PART_BYTES", 2000)
    nodes = spark.range(3000).repartition(5).select(F.col("id").alias("Id"), F.concat(F.lit('n,"é\n'), "id").alias("Label"), F.when(F.col("id") % 3 == 0, None).otherwise("T").alias("EntityType"))
    edges = spark.createDataFrame([], "Source long, Target long")
    for _ in range(2):  # the second replaces the first
        archive.write_zip(spark, f"{tmp_path}/graph.zip", {"nodes.csv": nodes, "edges.csv": edges})
    with zipfile.ZipFile(f"{tmp_path}/graph.zip") as z:
        assert z.testzip() is None and z.namelist() == ["nodes.csv", "edges.csv"]
        read = list(csv.reader(io.TextIOWrapper(z.open("nodes.csv"), "utf-8", newline="")))
        assert z.read("edges.csv") == b"Source,Target\r\n"
    assert read[0] == ["Id", "Label", "EntityType"] and sorted(read[1:]) == sorted([str(i), f'n,"é\n{i}', "" if i % 3 == 0 else "T"] for i in range(3000))


def test_database_read_pushes_its_filter(spark, folder, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    customers.write.jdbc(url, "customer", properties={"driver": driver})
    read = connectors.jdbc_table(spark, url, "customer", "c_custkey", 1, 150, 4, driver=driver)
    chosen = read.where("c_nationkey = 7 AND c_acctbal > 1000").select("c_custkey", "c_name")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(C_NATIONKEY,7)" in plan.replace("c_nationkey", "C_NATIONKEY") and "GreaterThan" in plan and read.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, customers.where("c_nationkey = 7 AND c_acctbal > 1000").select("c_custkey", "c_name").collect()))


def brute_chunks(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Chunks as sets of places: pieces first, then for each run of small pieces the windows that a greedy reader sees."""
    sep = next(s for s in separators if s in text)
    finer = separators[separators.index(sep) + 1 :]
    cuts = range(1, len(text)) if sep == "" else sorted(cut_places(text, sep) - {0})
    bounds = [0, *cuts, len(text)]
    pieces = [text[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
    out, run = [], []

    def windows():
        at = 0
        while at < len(run):
            end = at
            while end < len(run) and (end == at or sum(map(len, run[at : end + 1])) <= size):
                end += 1
            out.append("".join(run[at:end]).strip())
            if end == len(run):
                break
            while at < end and (sum(map(len, run[at:end])) > overlap or sum(map(len, run[at : end + 1])) > size):
                at += 1
        run.clear()

    for piece in pieces:
        if len(piece) >= size and finer:
            windows()
            out += brute_chunks(piece, size, overlap, finer)
        else:
            run.append(piece)
    windows()
    return [c for c in out if c]


def cut_places(text, sep):
    """Where a separator starts, from left to right without overlaps."""
    found, at = set(), text.find(sep)
    while at >= 0:
        found.add(at)
        at = text.find(sep, at + len(sep))
    return found


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n", min_size=1, max_size=120), st.integers(4, 20), st.integers(0, 3))
def test_chunks_equal_a_reading_by_windows(text, size, overlap):
    from tessera.functions.text import split_recursive

    got = split_recursive(text, size, overlap)
    assert got == brute_chunks(text, size, overlap) and all(len(c) <= size for c in got)

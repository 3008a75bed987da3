"""Corpus operators against DuckDB SQL, brute force and planted cases."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import _text, decontaminate, html_text, jaccard_join, line_dedup, pipeline, quality, queries, sharding, toxicity
from tessera.session import Scratch


def sql(tables, text):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(text)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.QUERIES[name](spark, folder)
    names = sorted(got.columns)
    con.sql(queries.ORACLE[name]).create("want")
    want = con.sql(f"SELECT {', '.join(names)} FROM want").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


def test_odd_rows_quality(odd):
    out = quality.judge_quality(odd).collect()
    assert len(out) == odd.count()
    assert {r.doc_id for r in out if r.n_words == 0} == {1, 2, 3, None} and all(r.base_failed for r in out if r.n_words < 20)
    assert quality.judge_quality(odd.where("false")).count() == 0


def test_em_recovers_planted_accuracies(spark):
    """Rules of known accuracy: EM finds them, settles, and lets good votes overrule a lone bad one."""
    rng = np.random.default_rng(1)
    n, on_good, on_bad = 40_000, np.array([0.97, 0.92, 0.85, 0.8]), np.array([0.9, 0.85, 0.8, 0.75])
    good = rng.random(n) < 0.7
    right = rng.random((n, 4)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((n, 4)) < 0.8)
    seen, many = np.unique(votes, axis=0, return_counts=True)
    rules = ["a", "b", "c", "d"]
    frame = spark.createDataFrame([(*map(int, v), int(k)) for v, k in zip(seen, many)], ", ".join(f"v_{r} int" for r in rules) + ", n long")
    found = quality.estimate_rates(frame, rules)
    up, down = np.exp(found["up"]), np.exp(found["down"])
    bad = (1 - up) / (down - up)
    assert np.abs(bad - on_bad).max() < 0.03 and np.abs(up * (1 - bad) - on_good).max() < 0.02 and abs(found["prior"] - 0.7) < 0.02
    odds = np.log(found["prior"] / (1 - found["prior"])) + np.where(votes == 1, found["up"], np.where(votes == -1, found["down"], 0.0)).sum(1)
    kept, all_must_pass = odds >= 0, (votes != -1).all(1)
    assert (kept == good).mean() > 0.93 > (all_must_pass == good).mean() + 0.1
    assert (kept & ~all_must_pass & good).sum() > 5000


def test_quality_posterior_overrules_a_lone_vote(spark, docs_of):
    """A clean text with some repeated windows stays; one that is symbols throughout goes."""
    rng = np.random.default_rng(4)
    words = "the of and to in a is river stone window garden paper silver morning yellow carpet mountain letter".split()
    text = lambda n: " ".join(rng.choice(words, n))
    line = text(10)
    rows = [(i, text(80)) for i in range(300)] + [(1000 + i, " ".join(f"{w}x&&&" for w in rng.choice(words[7:], 80))) for i in range(40)] + [(2000, f"{text(40)} {line} {line} {text(40)}")]
    out = {r.doc_id: r for r in quality.judge_quality(docs_of(rows)).collect()}
    assert all(out[i].kept for i in range(300)) and not any(out[1000 + i].kept for i in range(40))
    assert 100 * out[2000].n_repeat_words > 15 * out[2000].n_words and not out[2000].base_failed and out[2000].kept


def test_repeat_words_brute_force(spark, docs_of):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(40)] + ["x " * 30, "a b c d e f g h " * 2]
    for r, text in zip(quality.text_counts(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect(), texts):
        words = text.split()
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        assert r.n_repeat_words == len({p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)})


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((d for d in out[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def test_jaccard_brute_force(docs_of, odd):
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = list(rng.choice(words, rng.integers(5, 80)))
        for _ in range(rng.integers(1, 14)):
            copy = list(text)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = f"n{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "a b c d"), (901, "a b c d"), (902, "a b c d e")] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 5]
    got = jaccard_join.jaccard_components(docs_of(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))
    assert jaccard_join.jaccard_components(odd.where("false")).count() == 0


def test_jaccard_large_near_copy_group(docs_of):
    rng = np.random.default_rng(9)
    text = [f"q{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(text)
        for _ in range(4):
            copy[rng.integers(150)] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    got = jaccard_join.jaccard_components(docs_of(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_decontamination_edges(spark, docs_of, odd):
    item = "the quick brown fox jumps over the lazy dog tonight again"
    bench = spark.createDataFrame([("b", item, 1), ("a", item, 1), ("s", "tiny Item", 1), ("e", "", 1), (None, None, 1), ("c", "x y", 1)], "item_id string, text string, doc_id int")
    docs = [(1, f"He said: {item.upper()}!"), (2, "the quick brown fox jumps over the lazy dog today"), (3, "a tiny, item; tiny item"), (4, None), (5, "quick brown fox jumps over the lazy dog tonight again")]
    out = {r.doc_id: r for r in decontaminate.find_contamination(docs_of(docs), bench).collect()}
    assert (out[1].n_hit, out[1].n_items, out[1].contaminated) == (11, 2, True)
    assert not out[2].contaminated and out[4].n_words == 0 and (out[3].n_hit, out[3].n_items) == (4, 1)
    assert (out[5].n_hit, out[5].n_items) == (10, 2)
    import hashlib

    assert out[1].items_sha256 == hashlib.sha256(b"a,b").hexdigest() and out[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.find_contamination(odd, bench).count() == odd.count()
    assert not decontaminate.find_contamination(odd, bench.where("false")).where("contaminated").count()
    assert decontaminate.find_contamination(odd.where("false"), bench).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=5, max_size=60))
def test_winnowing_guarantee(values):
    grams = np.array(values, np.uint64)
    chosen = set(decontaminate.winnow(grams, np.array([0, len(grams)]), 5).tolist())
    assert all(chosen & set(range(i, i + 5)) for i in range(len(values) - 4))


def test_line_dedup_runs(docs_of, odd):
    long = " ".join(f"a{i}" for i in range(60))
    half = [" ".join(f"b{j}{i}" for i in range(30)) for j in range(3)]
    rows = [(1, f"{long}\nshort line"), (2, f"intro\n{long}\nshort line"), (3, "\n".join(half)), (4, f"{half[0]}\nbreak\n{half[1]}"), (5, f"x\n{half[1]}\n{half[2]}\ny"), (6, f"{long}\n{long}"), (7, long), (7, long)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "intro" and out[2].n_removed == 2
    assert out[3].n_removed == 0 and out[4].n_removed == 0 and out[5].text == "x\ny"
    assert out[6].n_removed == 2 and out[6].text == "" and out[7].text == ""
    same = line_dedup.dedup_lines(odd)
    assert same.count() == odd.count() and same.where("n_removed > 0").count() == 0 and same.where("text IS NULL").count() == 2
    assert same.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "text"]
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4))
def test_line_windows_hold_a_fingerprint(rows):
    kinds = ["", "a b c", "the same ten words stand here in this one line", " ".join(f"x{i}" for i in range(30))]
    _, data, offs = next(_text.blocks(pa.array(["\n".join(kinds[k] for k in one) for one in rows])))
    hashes, words, bounds = line_dedup._lines(data, offs)
    places, _ = line_dedup._fingerprints(hashes, words, bounds)

    def reach(i, until, least):
        return next((e for e in range(i + 1, until + 1) if words[i:e].sum() >= least), 0)

    for a, b in zip(bounds[:-1], bounds[1:]):
        for i in range(a, b):
            end = reach(i, b, line_dedup.RUN_WORDS)
            assert not end or any(i <= p and 0 < reach(p, b, line_dedup.GRAM_WORDS) <= end for p in places)


def test_line_dedup_of_thue_morse_lines_and_words(docs_of):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["\n".join(("a b", "c d")[b ^ flip] for b in bits) for flip in (0, 1)]
    words = [" ".join(f"w{i}" for i in range(60)) + " " + "".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    held = line_dedup._Runs(np.stack([_text.span_hash(np.frombuffer(b"a bc d", np.uint8), np.array([0, 3])[[b ^ f for b in bits]], np.array([3, 6])[[b ^ f for b in bits]], s) for f, s in ((0, 0), (0, 1))]))
    other = line_dedup._Runs(np.stack([_text.span_hash(np.frombuffer(b"a bc d", np.uint8), np.array([0, 3])[[b ^ 1 for b in bits]], np.array([3, 6])[[b ^ 1 for b in bits]], s) for s in (0, 1)]))
    whole = np.array([0]), np.array([1024])
    assert held.keys(*whole, 0) != other.keys(*whole, 0) and held.keys(*whole, 1) != other.keys(*whole, 1)
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs_of(list(enumerate(words)))).collect()}
    assert out == {0: 0, 1: 0} and len(texts[0]) == len(texts[1])


def test_line_dedup_of_ten_megabytes_of_blank_lines():
    import time

    began = time.time()
    text = "\n" * 5_000_000 + " ".join(f"w{i}" for i in range(60)) + "\n" * 5_000_000
    for _, data, offs in _text.blocks(pa.array([text])):
        places, _ = line_dedup._fingerprints(*line_dedup._lines(data, offs))
    assert len(places) and time.time() - began < 20


def test_shards_compact_and_conflict(spark, odd):
    store = sharding.ShardStore(spark, Scratch(spark, "store").path, target_bytes=1 << 20, fanout=3, smallest=1 << 10)
    for i in range(9):
        store.append(spark.range(i * 10, i * 10 + 10))
    before = store.manifest()
    assert len(before["runs"]) == 9 and store.read(3).count() == 30
    store.compact()
    assert len(store.manifest()["runs"]) < 9 and store.read().count() == 90
    with pytest.raises(sharding.CommitConflict):
        store._commit({**store.manifest(), "version": store.manifest()["version"] - 1}, [], before["schema"])
    with pytest.raises(ValueError):
        store.append(spark.range(3).withColumn("other", F.lit(1)))
    many = sharding.ShardStore(spark, Scratch(spark, "store").path)
    many.append_arrivals(odd, "pmod(xxhash64(doc_id), 5)")
    assert sorted(map(repr, many.read().collect())) == sorted(map(repr, odd.collect()))
    none = sharding.ShardStore(spark, Scratch(spark, "store").path)
    none.append(odd.where("false"))
    assert none.read().count() == 0


def test_shards_tiers_sizes_and_retention(spark):
    """Compaction leaves no full tier, files near the target, old versions readable until vacuum, and no orphans after it."""
    store = sharding.ShardStore(spark, Scratch(spark, "store").path, target_bytes=24 << 10, fanout=4, smallest=4 << 10)
    parts = [spark.range(i * 3000, i * 3000 + 3000, numPartitions=1).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).limit(200) for i in range(10)]
    for part in parts:
        store.append(part)
    before = store.manifest()
    assert store.compact() > 0
    after = store.manifest()
    tiers = [store.tier(r) for r in after["runs"]]
    assert max(map(tiers.count, tiers)) < store.fanout and len(after["runs"]) < len(before["runs"])
    merged = [r for r in after["runs"] if len(r["files"]) > 1 or r not in before["runs"]]
    assert merged and all(r["bytes"] / len(r["files"]) < 2 * store.target_bytes for r in merged)
    assert store.read(before["version"]).count() == store.read().count() == 2000
    lost = spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/data/run-lost")
    store._fs.mkdirs(lost)
    store.vacuum()
    assert store._fs.exists(lost) and store.versions() == [after["version"]] and store.read().count() == 2000
    store.vacuum(orphans_after_s=-60)
    assert not store._fs.exists(lost) and store.read().count() == 2000


def test_racing_writers_commit_once(spark):
    """Of writers that commit the same version at once, one wins and the rest are told."""
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.ShardStore(spark, Scratch(spark, "store").path)
    base = store.append(spark.range(3))

    def commit(i):
        try:
            return store._commit(base, [*base["runs"], {"run": f"data/r{i}", "files": [], "bytes": 0}], base["schema"])
        except sharding.CommitConflict:
            return None

    for _ in range(5):
        with ThreadPoolExecutor(6) as pool:
            won = [r for r in pool.map(commit, range(6)) if r]
        assert len(won) == 1 and store.manifest() == won[0]
        base = won[0]


def brute_segments(scores):
    """Maximal scoring subsequences by definition: best first, then left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    n = len(scores)
    value, _, a, b = max((total[j] - total[i], -(j - i), i, j) for i in range(n) for j in range(i + 1, n + 1))
    return brute_segments(scores[:a]) + [(a, b, value)] + [(x + b, y + b, v) for x, y, v in brute_segments(scores[b:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 1.3, 2.7, -0.9, 0.31]), min_size=1, max_size=25))
def test_segments_are_maximal(values):
    places = np.flatnonzero(values)
    got = toxicity.maximal_segments(places, np.array(values)[places])
    want = brute_segments([v - toxicity.WORD_COST for v in values])
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_segments_are_found_in_linear_time():
    """Falling totals between equal words, and a text of two million scoring words."""
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.time()
        assert len(toxicity.maximal_segments(np.arange(2 * n), np.tile([1.0, -1.5], n))) == n
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1
    began = time.time()
    (one,) = toxicity.maximal_segments(np.arange(2_000_000), np.full(2_000_000, 0.5))
    assert one[:2] == (0, 2_000_000) and time.time() - began < 10


def test_toxicity_adds_up_passages(spark):
    """Further significant passages add up; those at chance level add nothing, and a text without any is fine."""
    frame = spark.createDataFrame([(0, 100, [9.0]), (1, 100, [9.0, 8.5]), (2, 100, [9.0, 8.5, 8.0]), (3, 100, [9.0, 0.1]), (4, 100, [])], "i int, __n_words long, score array<double>")
    x = {r.i: r.x for r in frame.select("i", toxicity._further(F.col("score"), 1.0, 0.05).alias("x")).collect()}
    assert x[4] == x[0] == x[3] == 0 < x[1] < x[2]


def test_logistic_weighs_both_features():
    rng = np.random.default_rng(0)
    x, more = rng.normal(size=4000), rng.exponential(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(-1 + 1.5 * x + 0.8 * more)))
    a, b, c = toxicity._logistic(list(zip(x, more, y.astype(int), np.ones(4000, int))), ridge=1e-6)
    assert abs(a + 1) < 0.25 and abs(b - 1.5) < 0.25 and abs(c - 0.8) < 0.25
    assert toxicity._logistic(list(zip(x, -more, y.astype(int), np.ones(4000, int))))[2] == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = toxicity.op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    rows = out.select("predicted", "toxic", "score").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught / sum(r.toxic for r in rows) > 0.7 and caught / sum(r.predicted for r in rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None), (4, 1), (2, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, labels).where("score IS NOT NULL").count() == odd.count()
    assert toxicity.score_toxicity(odd, labels.where("false")).where("predicted = 0").count() == odd.count()
    assert toxicity.score_toxicity(odd.where("false"), labels).count() == 0


def test_toxicity_of_neighbouring_copies(spark):
    texts = ["vile", "vile", "", "vile", "vile vile", "good vile", "vile good"]
    _, data, offs = next(_text.blocks(pa.array(["vile"])))
    token = toxicity.token_family(_text.Words(data, offs, _text.ALNUM, True))[0]
    model = toxicity.TokenScores(token, np.array([2.0]), 1.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    best = {r.doc_id: r["__best"] for r in toxicity.annotate(docs, model).collect()}
    one = 2.0 - toxicity.WORD_COST
    assert [best[i] for i in range(7)] == pytest.approx([one, one, 0, one, one, one, one])


def test_toxicity_beyond_the_broadcast_bound(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame([(-1, None), (-2, "")], docs.schema))
    rows = lambda: sorted(((r.doc_id, r.score, [(x.lo, x.hi) for x in r.segments]) for r in toxicity.score_toxicity(docs, labels).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(toxicity, "MODEL_TOKENS", 8)
    for (i, score, segments), (j, other, found) in zip(whole, rows(), strict=True):
        assert i == j and other == pytest.approx(score, abs=1e-6) and found == segments


PAGES = [
    (1, "http://h/1", "<html><head><title>T</title></head><body><nav><a href='x'>Menu</a></nav><article><header><h1>Head &amp; line</h1></header><p>One  two<br>three<p>Four&nbsp;five</p><div class='share'>Share</div></article><footer>F</footer></body></html>", "Head & line\nOne two three\nFour five"),
    (2, "http://h/2", "<div id='sidebar'>S</div><div class='post-content'><p>Body <b>x</b>y</p><script>var a='</p>';</script></div><div class='comments'><p>c</p></div>", "Body xy"),
    (3, None, None, ""),
    (6, "http://h/6", "<div class='wrap has-sidebar' data-id='menu'><div class=main-nav>M</div><div ID=content>Text &#x41;&eacute;<div class='content-ad'>buy</div></div></div>", "Text Aé"),
    (4, "http://h/4", "", ""),
    (5, "http://h/5", "plain &lt;text&gt; only", "plain <text> only"),
]


def test_pages_by_markup(spark):
    frame = spark.createDataFrame([(i, u, h, "z", "y") for i, u, h, _ in PAGES], "page_id long, url string, html string, host string, text string")
    out = {r.page_id: r for r in html_text.extract_main_text(frame).collect()}
    for i, _, _, want in PAGES:
        assert out[i].text == want and out[i].n_chars == len(want)
    assert html_text.extract_main_text(frame.where("false")).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<a " * 400_000, "<a \"'>" * 100_000, "<p>" + "<b>" * 200_000 + "<p>" * 10, "</b>" * 200_000 + "<i>" * 100_000 + "</b>" * 100_000, "<a " * 300_000 + "<!-- x"])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.time()
    html_text.page_blocks(page)
    assert time.time() - began < 10


def test_pages_by_host_suffixes(spark):
    frame = [(i, f"https://site.org/{i}", f"<body><div>Welcome to the very best site on earth</div><div>{' '.join(f'u{i}w{j}' for j in range(30))}</div><div>All rights are reserved by the owner</div></body>") for i in range(20)]
    frame += [(50, "https://lone.org/", "<body><div>Welcome to the very best site on earth</div></body>")]
    out = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(frame, "page_id long, url string, html string")).collect()}
    assert all(out[i] == " ".join(f"u{i}w{j}" for j in range(30)) for i in range(20))
    assert out[50] == "Welcome to the very best site on earth"


def test_pages_of_a_large_host(spark):
    """A passage on two of very many pages goes, even where a date in it differs."""
    own = lambda i: " ".join(f"u{i}w{j}" for j in range(30))
    twins = {10 * k + day: " ".join(f"s{k}w{j}" for j in range(20)) + f" on day {day}" for k in range(20) for day in (0, 7)}
    texts = [(i, f"<div>{own(i)}</div>" + (f"<div>{twins[i]}</div>" if i in twins else "")) for i in range(768)]
    frame = spark.createDataFrame([(i, f"https://big.org/{i}", t) for i, t in texts] + [(10_000, "https://other.org/", f"<div>{twins[0]}</div>")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_text.extract_main_text(frame).collect()}
    assert len(out) == len(texts) + 1 and out[10_000] == twins[0]
    assert all(out[i] == own(i) for i, _ in texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab ", min_size=1, max_size=12), max_size=3), min_size=1, max_size=4))
def test_counted_strings_cover_as_the_suffix_array(pages):
    pages = [[" ".join(b.split()) for b in one if b.split()] for one in pages]
    n, column = len(pages), pa.array(pages, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([5] * n, pa.int64()), pa.array(range(n), pa.int64()), column], names=["h", "row", "open"])
    keys = next(html_text.string_keys([batch])).to_pandas()
    twice = keys.groupby("key").row.nunique().loc[lambda c: c > 1].index
    repeated = [keys[(keys.row == i) & keys.key.isin(twice)].key.tolist() or None for i in range(n)]
    nothing = pa.nulls(n)
    batch = pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, column, nothing, pa.array([5] * n, pa.int64()), pa.array(repeated, pa.list_(pa.int64()))], names=list("abcdefgh"))
    got = next(html_text.cover_by_keys([batch])).column(6).to_pylist()
    assert got == [(s >= html_text.COVERED).tolist() for s in html_text.covered_blocks(pages)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab ", min_size=1, max_size=12), max_size=3), min_size=1, max_size=4))
def test_suffix_cover_brute_force(pages):
    pages = [[b for b in one if b.split()] for one in pages]
    streams = [[t for b in one for t in [*b.split(), "\n"]] for one in pages]
    for p, (one, shares) in enumerate(zip(pages, html_text.covered_blocks(pages, 3))):
        others = {tuple(s[i : i + 3]) for q, s in enumerate(streams) if q != p for i in range(len(s) - 2)}
        inside = {j for i in range(len(streams[p]) - 2) if tuple(streams[p][i : i + 3]) in others for j in range(i, i + 3)}
        at = 0
        for block, share in zip(one, shares):
            n = len(block.split())
            assert share == pytest.approx(sum(j in inside for j in range(at, at + n)) / n)
            at += n + 1


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch, kept = Scratch(spark, "stages"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, folder), name)
        kept.append(docs)
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    clean, lines, unique, free, packed = kept
    assert len(set(brute_components([(r.doc_id, r.text) for r in lines.collect()]))) and unique.count() == len({c for *_, c in brute_components([(r.doc_id, r.text) for r in lines.collect()])})
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.find_contamination(free, bench).where("contaminated").count() == 0
    assert free.count() == unique.count() - decontaminate.find_contamination(unique, bench).where("contaminated").count()
    assert packed.select("doc_id").distinct().count() == free.count()
    assert sorted(map(tuple, pipeline.run(spark, folder).collect())) == sorted(map(tuple, packed.collect()))


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty texts, repeated rows, ties, clashing columns and empty tables pass every stage."""
    folder = str(tmp_path)
    rows = odd.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit(1), "first": F.lit("f"), "prefix": F.lit("p"), "__segments": F.lit(0)})
    spark.createDataFrame([(2, 1, 1), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("a", None), ("b", ""), ("c", "other words here")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = {"toxicity": 10, "line_dedup": 10, "near_duplicates": 9, "decontamination": 8}
    docs = rows
    for name, stage in pipeline.STAGES[:-1]:
        docs = Scratch(spark, "odd").table(stage(spark, docs, folder), name)
        assert docs.count() == want[name] and docs.columns == pipeline.COLUMNS
        assert docs.where("text IS NULL").count() == 2
    assert pipeline.pack(spark, docs, folder).select("doc_id").count() >= 8
    for _, stage in pipeline.STAGES:
        assert stage(spark, rows.where("false"), folder).count() == 0

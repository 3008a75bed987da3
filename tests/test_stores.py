"""Stored tables and streams that write to them."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.sources.files import CommitConflict
from tessera.sources.keyed_store import KeyedStore
from tessera.streaming import state
from tessera.streaming.exactly_once import AppendLedger, once_each

DDL = "k string, n long, a string, b long"


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_of(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), DDL, ["k", "n"], buckets=16)
    first = spark.createDataFrame([(f"k{i}", i, "old", i, 1) for i in range(100)] + [("k5", 5, "last", 6, 2), (None, None, "null key", 0, 0)], f"{DDL}, at int")
    store.upsert(first, ["at"], "w", 0)
    before, runs = files_of(tmp_path), store.manifest()["runs"]
    assert store.read().count() == 101 and store.get(k="k5", n=5).first().a == "last" and store.get(k=None, n=None).first().a == "null key"
    second = spark.createDataFrame([("k7", 7, None, 70, 1), ("new", 1, "x", 1, 1)], f"{DDL}, at int")
    found = store.upsert(second, ["at"], "w", 1)
    changed = {b for b in found["runs"] if found["runs"][b] != runs.get(b)}
    assert 1 <= len(changed) <= 2 and len(files_of(tmp_path) - before) <= 2 and before <= files_of(tmp_path)
    assert tuple(store.get(k="k7", n=7).first()) == ("k7", 7, None, 70) and store.read().count() == 102
    now = files_of(tmp_path)
    assert store.upsert(second, ["at"], "w", 1)["version"] == 2 and store.upsert(first, ["at"], "w", 0)["version"] == 2 and files_of(tmp_path) == now
    assert store.read(1).count() == 101 and store.read(1).where("k = 'k7'").first().a == "old"


def test_point_read_opens_one_bucket(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "src long, dst long, w double", ["src", "dst"], bucket_by=["src"], buckets=32)
    for turn in range(3):
        store.upsert(spark.range(4000).selectExpr("id % 500 AS src", f"id + {turn} AS dst", "1.0 AS w"), ["w"])
    one = store.get(src=77)
    assert table_of(one.select("dst")) == table_of(store.read().where("src = 77").select("dst")) and one.count() > 8
    assert len(one.inputFiles()) <= store.most_runs < len(store.read().inputFiles()) / 8
    assert store.get(src=-1).count() == 0
    with pytest.raises(ValueError):
        store.get(dst=1)


def test_compaction_versions_and_vacuum(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), DDL, ["k"], buckets=4, most_runs=2)
    for turn in range(5):
        store.upsert(spark.createDataFrame([("a", turn, "x", turn), (f"only{turn}", 0, "y", 0)], DDL), ["n"], "w", turn)
    want = [("a", 4, "x", 4)] + [(f"only{t}", 0, "y", 0) for t in range(5)]
    assert table_of(store.read()) == sorted(want, key=repr) and max(map(len, store.manifest()["runs"].values())) <= 2
    store.delete(spark.createDataFrame([("a",), ("unknown",)], "k string"))
    assert store.read().where("k = 'a'").count() == 0
    store.compact(0)
    assert all(len(r) == 1 for r in store.manifest()["runs"].values()) and table_of(store.read()) == sorted(want[1:], key=repr)
    store.vacuum()
    named = {r for runs in store.manifest()["runs"].values() for r in runs}
    assert set(os.listdir(f"{tmp_path}/data")) == named and len(store.versions()) == 1 and table_of(store.read()) == sorted(want[1:], key=repr)
    store.upsert(spark.createDataFrame([("a", 9, "back", None)], DDL), ["n"])
    assert store.read().where("k = 'a'").first().a == "back"


def test_a_conflict_is_tried_again(spark, tmp_path):
    one, other = (KeyedStore(spark, str(tmp_path), DDL, ["k"], buckets=2) for _ in range(2))
    one.upsert(spark.createDataFrame([("a", 1, "one", 1)], DDL), ["n"])
    stale = other.manifest()
    one.upsert(spark.createDataFrame([("a", 2, "two", 2), ("b", 1, "b", 1)], DDL), ["n"])
    real, seen = other.manifest, []
    other.manifest = lambda version=None: seen.append(1) or (stale if len(seen) == 1 else real(version))
    other.upsert(spark.createDataFrame([("a", 3, "three", 3)], DDL), ["n"])
    assert len(seen) > 1 and table_of(one.read().select("k", "a")) == [("a", "three"), ("b", "b")]
    with pytest.raises(CommitConflict):
        one.files.publish(f"versions/v{1:010d}.json", {})


ROWS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9), st.sampled_from([None, "x", "y"]), st.sampled_from([None, 1, 2]), st.booleans()), min_size=1, max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROWS, min_size=1, max_size=3), st.booleans())
def test_any_batches_equal_a_dictionary(spark, tmp_path_factory, batches, fill):
    store = KeyedStore(spark, str(tmp_path_factory.mktemp("store")), "k string, a string, b long", ["k"], buckets=2, fill=fill, most_runs=1)
    want = {}
    for number, batch in enumerate(batches):
        gone = {k for k, _, _, _, g in batch if g} if fill else set()
        for at, (k, _, a, b, g) in enumerate(batch):
            old = want.get(k, (None, None))
            want[k] = (a if a is not None else old[0], b if b is not None else old[1]) if fill else None if g else (a, b)
        frame = spark.createDataFrame([(k, a, b, at, g) for at, (k, _, a, b, g) in enumerate(batch)], "k string, a string, b long, at int, g boolean")
        store.upsert(frame, ["at"], "w", number, gone=None if fill else "g")
        if gone:
            store.delete(frame.where("g").select("k"), "d", number)
            want = {k: v for k, v in want.items() if k not in gone}
        want = {k: v for k, v in want.items() if v is not None}
    assert table_of(store.read()) == sorted([(k, *v) for k, v in want.items()], key=repr)


EVENTS = "site_id string, seq long, type string, url string, status string, message string"


def random_events(rng, n):
    kinds = ["log", "queue", "queue_update", "queue_update", "status", "new_chunk"]
    return [(f"s{rng.integers(4)}", i // 2, kinds[rng.integers(len(kinds))], None if rng.random() < 0.05 else f"u{rng.integers(5)}", f"st{rng.integers(4)}", f"m{i}") for i in range(n)]


def distinct_order(rows):
    """Without updates, logs and statuses of equal number on one site, whose order nothing tells; queue rows of one number stay."""
    seen, out = set(), []
    for r in rows:
        key = (r[0], r[1], r[2], r[3] if r[2] == "queue_update" else "")
        if r[2] == "queue" or key not in seen:
            seen.add(key)
            out.append(r)
    return out


def test_stream_state_restarts_and_equals_the_batch(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = distinct_order(random_events(rng, 600))
    rng.shuffle(rows)
    rows = [(a, int(b), c, d, e, f) for a, b, c, d, e, f in rows]
    frame = lambda r: spark.createDataFrame(r, EVENTS)
    store = state.view_store(spark, f"{tmp_path}/store", buckets=4)
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (rows[:250], rows[250:260], rows[260:]):
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state.run_site_views(stream(), store, f"{tmp_path}/checkpoint")
    assert table_of(store.read()) == table_of(state.views_of(frame(rows)))
    log = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "log").load()
    assert log.count() == sum(r[2] == "log" for r in rows)
    version = store.manifest()["version"]
    state.run_site_views(stream(), store, f"{tmp_path}/checkpoint")
    assert store.manifest()["version"] == version


def test_a_failed_and_replayed_batch_is_there_once(spark, tmp_path):
    ledger = AppendLedger(spark, f"{tmp_path}/table", "id long, bulk long")
    spark.range(1200).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    write, calls = ledger.bulk_sink("w", ["id"]), []

    def fails_after_writing(batch, number):
        write(batch, number)
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost after the entry was published")

    run = lambda: source().writeStream.foreachBatch(fails_after_writing).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception):
        run()
    run()
    assert calls == [0, 0] and table_of(ledger.read().select("id")) == [(i,) for i in sorted(range(1200), key=lambda i: repr((i,)))]
    assert sorted(r["count"] for r in ledger.read().groupBy("bulk").count().collect()) == [200, 500, 500]
    real = ledger.files.publish
    ledger.files.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the entry was published"))
    with pytest.raises(RuntimeError):
        ledger.append(spark.range(5).selectExpr("id", "0L AS bulk"), "w", 1)
    ledger.files.publish = real
    assert ledger.read().count() == 1200 and ledger.append(spark.range(5).selectExpr("id", "0L AS bulk"), "w", 1) and ledger.read().count() == 1205
    assert not ledger.append(spark.range(9).selectExpr("id", "0L AS bulk"), "w", 1) and ledger.append(spark.range(1).selectExpr("id", "0L AS bulk"), "x", 1)


def test_redelivered_events_are_dropped(spark, tmp_path):
    events = spark.range(300).selectExpr("id", "timestamp_seconds(1700000000 + id) AS ts")
    ledger = AppendLedger(spark, f"{tmp_path}/table", "id long, ts timestamp")
    for part in (events.where("id < 200"), events.where("id BETWEEN 150 AND 299"), events.where("id > 290")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = once_each(spark.readStream.schema("id long, ts timestamp").parquet(f"{tmp_path}/in"), ["id"], "ts", "5 minutes")
        stream.writeStream.foreachBatch(ledger.sink("w")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in ledger.read().collect()) == list(range(300))
    assert F.col("ts") is not None


def test_a_built_graph_is_merged_into_a_stored_one(spark, tmp_path):
    from tessera.plans import workflow
    from tessera.sources import connectors

    chunks = lambda texts: spark.createDataFrame([(7, f"u{i}", i, t) for i, t in texts], "pipeline_id long, source_url string, seq long, raw_text string")
    build = lambda texts: workflow.build_graph(chunks(texts), connectors.stub_extractor, connectors.hashed_embedding, lambda name, kind: F.lit(False))
    first = build([(0, "Alpha met Beta."), (1, "Beta met Gamma.")])
    stores = workflow.store_graph(first, str(tmp_path), batch=0, buckets=4)
    names = lambda: sorted(r.name for r in stores["vertices"].read().collect())
    assert names() == ["Alpha", "Beta", "Gamma"] and stores["edges"].read().count() == 2 and stores["mentions"].read().count() == 4
    stores = workflow.store_graph(build([(1, "Beta met Gamma."), (2, "Beta met Delta.")]), str(tmp_path), batch=1, buckets=4)
    assert names() == ["Alpha", "Beta", "Delta", "Gamma"] and stores["edges"].read().count() == 3
    version = {n: s.manifest()["version"] for n, s in stores.items()}
    stores = workflow.store_graph(first, str(tmp_path), batch=1, buckets=4)
    assert version == {n: s.manifest()["version"] for n, s in stores.items()}
    beta = stores["vertices"].read().where("name = 'Beta'").first()
    assert {r.dst for r in stores["edges"].get(src=beta.id).collect()} == {r.id for r in stores["vertices"].read().where("name IN ('Gamma', 'Delta')").collect()}


def test_companies_are_written_and_read_back(spark, tmp_path):
    """A company is enriched into a stored graph, then read back by name."""
    from tessera.plans import workflow

    ddl = "id long, pipeline_id string, name string, type string, community long, stage_estimate string, total_raised double"
    store = KeyedStore(spark, str(tmp_path), ddl, ["id"], buckets=4)
    store.upsert(spark.createDataFrame([(1, "p", "Fischer", "Company", 5, None, 1.0), (2, "p", "Fischer", "Person", 5, None, None), (3, "q", "Fischer", "Startup", 6, None, None), (4, "p", "Other", "Company", 5, "seed", None)], ddl), ["id"])
    found = spark.createDataFrame([("p", "Fischer", "Startup", "series a", None), ("p", "Fresh", "Startup", "seed", 2.0)], "pipeline_id string, name string, type string, stage_estimate string, total_raised double")
    for _ in range(2):
        workflow.enrich_store(store, found, ["stage_estimate", "total_raised"], batch=0)
    out = {(r.id if r.id < 10 and r.id > 0 else "new", r.name): (r.type, r.community, r.stage_estimate, r.total_raised) for r in store.read().collect()}
    assert out == {
        (1, "Fischer"): ("Company", 5, "series a", 1.0), (2, "Fischer"): ("Person", 5, None, None), (3, "Fischer"): ("Startup", 6, None, None),
        (4, "Other"): ("Company", 5, "seed", None), ("new", "Fresh"): ("Startup", None, "seed", 2.0),
    }
    assert store.manifest()["version"] == 2

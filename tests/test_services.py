"""Services as sources, in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources.service_source import JsonFeed, PagedService, register_service


def land(folder, numbers):
    folder.mkdir(exist_ok=True)
    for n in numbers:
        (folder / f"{n:04d}.jsonl").write_text("\n".join([json.dumps({"id": 10 * n + i, "title": f"t{n}"}) for i in range(3)] + ["not json", "[1]", json.dumps({"title": None})]) + "\n")


def test_feed_in_batch_and_as_a_stream(spark, tmp_path):
    register_service(spark, "feed", "id long, title string", JsonFeed(["id", "title"]))
    land(tmp_path / "feed", range(7))
    read = spark.read.format("feed").option("path", f"{tmp_path}/feed").option("batch", 2).load()
    assert read.rdd.getNumPartitions() == 4 and read.count() == 28 and read.where("id IS NULL").count() == 7
    assert sorted(r.id for r in read.where("id IS NOT NULL").collect()) == [10 * n + i for n in range(7) for i in range(3)]

    def run():
        stream = spark.readStream.format("feed").option("path", f"{tmp_path}/feed").option("batch", 2).load().where("id IS NOT NULL")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long, title string").parquet(f"{tmp_path}/out").collect())

    assert run() == [10 * n + i for n in range(7) for i in range(3)]
    land(tmp_path / "feed", range(7, 9))
    assert run() == [10 * n + i for n in range(9) for i in range(3)]  # the first seven are not read again
    assert run() == [10 * n + i for n in range(9) for i in range(3)]


def test_calls_take_batches_of_requests(spark):
    class Search(PagedService):
        """Answers each of ``n`` queries with its number and the size of the call it came in."""

        def size(self, options):
            return int(options["n"])

        def answer(self, options, low, high):
            return ((q, high - low) for q in range(low, high))

    register_service(spark, "search", "query long, call_size long", Search())
    read = lambda n: spark.read.format("search").option("n", n).load()
    sizes = read(1234).groupBy("call_size").agg(F.count("*").alias("rows")).collect()
    assert {(r.call_size, r.rows) for r in sizes} == {(500, 1000), (234, 234)}
    assert read(0).count() == 0
    with pytest.raises(Exception):
        spark.read.format("search").option("n", 3).option("batch", 0).load().count()


def test_sweeping_takes_old_scratch_only(spark):
    import os

    from tessera.session import Scratch, shared_root, sweep_scratch

    scratch, root = Scratch(spark, "swept"), shared_root(spark).removeprefix("file://")
    scratch.table(spark.range(3), "rows")
    for name in ("old-0123456789ab", "kept by another"):
        os.makedirs(f"{root}/{name}/x", exist_ok=True)
        os.utime(f"{root}/{name}", (1e9, 1e9))
    swept = sweep_scratch(spark, 3600)
    assert "old-0123456789ab" in swept and scratch.path.rpartition("/")[2] not in swept and os.path.isdir(f"{root}/kept by another") and not os.path.exists(f"{root}/old-0123456789ab")
    assert spark.read.parquet(f"{scratch.path}/001-rows").count() == 3


def test_objects_are_listed_and_read_by_format(spark, tmp_path):
    from tessera.sources import connectors

    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/prices.csv").write_text("name,price\nx,1\ny,2.5\n")
    (tmp_path / "a/b/page.html").write_text("<html><nav>menu</nav><p>Body &amp; more</p></html>")
    (tmp_path / "a/b/broken.docx").write_bytes(b"no zip")
    found = connectors.objects(spark, str(tmp_path))
    assert sorted((r.path.rpartition("/")[2], r.length) for r in found.collect()) == [("broken.docx", 6), ("page.html", 50), ("prices.csv", 21)]
    out = {r.path.rpartition("/")[2]: r for r in connectors.read_text(found).collect()}
    assert out["prices.csv"].text.split() == ["name", "price", "0", "x", "1.0", "1", "y", "2.5"] and out["page.html"].text == "Body & more"
    assert out["broken.docx"].text is None and "BadZipFile" in out["broken.docx"].error


def test_service_calls_are_bounded_by_workers(spark):
    from tessera.sources import connectors

    def call(pdf):
        import os

        return pdf.assign(rows=len(pdf), worker=os.getpid())

    rows = spark.range(1000).repartition(7)
    found = connectors.apply_service(rows, call, "id long, rows long, worker long", workers=3)
    assert found.rdd.getNumPartitions() == 3 and sorted(r.id for r in found.collect()) == list(range(1000))
    assert connectors.apply_service(rows.where("false"), call, "id long, rows long, worker long", workers=3).count() == 0

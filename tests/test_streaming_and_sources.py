"""Streams against their batch twins; readers and sinks on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from augury.operators import monitoring as M
from augury.sources import readers, sinks
from augury.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def replay(spark, folder, rows):
    """One file a batch, in the order of rows."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in{i}")
    return f"{folder}/in*"


def at(minute, day=1):
    return dt.datetime(2024, 1, day, minute // 60, minute % 60)


def test_tumbling_stream_equals_batch(spark, tmp_path):
    parts = [[(1, at(1), 1, "view", 2.0), (2, at(61), 1, "view", 4.0)], [(3, at(30), 2, "view", 1.0), (4, at(300), 1, "view", 0.0)], [(5, at(5, 3), 1, "view", 0.0)]]
    path, schema = replay(spark, str(tmp_path), parts), spark.createDataFrame([], SCHEMA).schema
    aggs = [F.count("*").alias("n"), F.sum("value").alias("v")]
    stream = jobs.tumbling(jobs.events(spark, path, schema, files=100), "1 hour", ["event_type"], aggs)
    q = jobs.sink_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("start", "event_type", "n", "v").collect()}
    batch = {tuple(r) for r in M.buckets(spark.read.schema(schema).parquet(path), "ts", "1 hour", ["event_type"], aggs).collect()}
    assert got and got <= batch and len(batch) - len(got) <= 1  # the newest window stays open


def test_pairing_stream(spark, tmp_path):
    parts = [[(1, at(1), 7, "start", 0.0), (2, at(3), 7, "end", 0.0), (3, at(4), 8, "start", 0.0)], [(4, at(10), 9, "other", 0.0)]]
    path, schema = replay(spark, str(tmp_path), parts), spark.createDataFrame([], SCHEMA).schema
    q = jobs.sink_once(jobs.paired(jobs.events(spark, path, schema, files=100), "user_id", "start", "end", 60_000), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert (7, at(1), at(3)) in {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "started", "ended").collect()}


def test_leases_stream_and_batch(spark, tmp_path):
    """Two claimants of an item, an expiry after 20 minutes, an item that is done; replayed a batch at a time and all at once."""
    from augury.operators import queue

    parts = [[(1, at(0), 7, "ann", 0.0), (2, at(1), 7, "bob", 0.0), (3, at(1), 8, "bob", 0.0), (4, at(1), 8, "ann", 0.0)],
             [(5, at(19), 7, "bob", 0.0), (6, at(20), 7, "cyd", 0.0), (7, at(5), 8, "", 1.0), (8, at(6), 9, "ann", 0.0)],
             [(9, at(39), 7, "ann", 0.0), (10, at(40), 7, "bob", 0.0), (11, at(90), 8, "ann", 0.0), (12, at(26), 9, "ann", 0.0)]]
    want = {(7, "ann", at(0)), (7, "cyd", at(20)), (7, "bob", at(40)), (8, "ann", at(1)), (9, "ann", at(6)), (9, "ann", at(26))}
    path, schema = replay(spark, str(tmp_path), parts), spark.createDataFrame([], SCHEMA).schema
    done = F.col("value") > 0
    batch = queue.grants(spark.read.schema(schema).parquet(path), "user_id", "event_type", "ts", done, 1200)
    assert {tuple(r) for r in batch.collect()} == want
    for i in range(3):  # a run a batch, the state carried by the checkpoint
        spark.createDataFrame(parts[i], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log/part={i}")
        stream = jobs.leased(jobs.events(spark, f"{tmp_path}/log/*", schema, files=100), "user_id", "event_type", done, 1200)
        jobs.sink_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("item", "worker", "ts").collect()]
    assert len(got) == len(want) and set(got) == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x\ny"\n2,z\n')
    assert [r["name"] for r in readers.delimited(spark, str(tmp_path / "a.csv"), "id int, name string").orderBy("id").collect()] == ["x\ny", "z"]
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}], "next": None}))
    assert readers.json_pages(spark, str(tmp_path / "p.json"), "results", "struct<id:int>").count() == 2
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://a.example/1</link><description>&lt;p&gt;hi&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>no link</title></item></channel></rss>")
    got = readers.feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["url"], r["title"], r["excerpt"], r["published"]) for r in got] == [("http://a.example/1", "A", "hi", dt.datetime(2024, 1, 1, 10))]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a.example/x</loc><lastmod>2024-02-01T00:00:00Z</lastmod></url><url><loc>http://a.example/y</loc><lastmod>2020-02-01</lastmod></url></urlset>")
    assert [r["url"] for r in readers.sitemap(spark, str(tmp_path / "s.xml"), "2024-01-01", "2024-12-31").collect()] == ["http://a.example/x"]


def test_url_repair_and_inverted_text(spark):
    df = spark.createDataFrame([("/a/b",), ("//c.example/d",), ("https://undefined/x",), ("https://e.example/f",), ("junk",)], "u string")
    assert [r["x"] for r in df.select(readers.repaired_url("u", F.lit("https://feed.example/rss")).alias("x")).collect()] == ["https://feed.example/a/b", "https://c.example/d", None, "https://e.example/f", None]
    index = spark.createDataFrame([({"the": [0, 2], "cat": [1]},)], "i map<string,array<int>>")
    assert index.select(readers.inverted_text(F.col("i")).alias("x")).first()["x"] == "the cat the"


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, "y"), (2, "y"), (1, "z")], "k int, v string")
    sinks.snapshot(a, f"{tmp_path}/s", "r1")
    sinks.snapshot(b, f"{tmp_path}/s", "r2")
    sinks.snapshot(b, f"{tmp_path}/s", "r2")
    assert sinks.latest_snapshot(spark, f"{tmp_path}/s").count() == 3
    assert sinks.append_new(a, f"{tmp_path}/t", "k", False) == 1 and sinks.append_new(b, f"{tmp_path}/t", "k", True) == 1
    assert sinks.publish(a, "published", f"{tmp_path}/p").count() == spark.table("published").count() == 1
    sinks.append_json(a, f"{tmp_path}/j", "kind")
    assert json.loads(spark.read.parquet(f"{tmp_path}/j").first()["payload"]) == {"k": 1, "v": "x"}

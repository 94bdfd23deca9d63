import datetime
import json

from pyspark.sql import functions as F

from tidemark.operators.ranks import running
from tidemark.sources import landing, tables
from tidemark.streaming import feeds

D = datetime.date


def test_landed_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("series_id,date,value\ns,2024-01-01,1.5\ns,2024-01-02,.\ns,bad,2\n")
    assert [(r.date, r.value) for r in landing.observations_csv(spark, str(tmp_path / "o.csv")).orderBy("date").collect()] == [(D(2024, 1, 1), 1.5), (D(2024, 1, 2), None)]
    (tmp_path / "p.csv").write_text("ticker,date,close\nA,2024-01-01,1.5\nA,2024-01-02,x\n,2024-01-03,2\n")
    assert landing.prices_csv(spark, str(tmp_path / "p.csv")).count() == 1
    item = {"title": "T", "body": "B", "source": " S ", "source_url": "u", "published_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "n.json").write_text(json.dumps({"items": [item, item | {"title": "", "body": None}]}))
    (tmp_path / "m.json").write_text(json.dumps([item | {"published_at": "20240101T000000Z"}]))
    (tmp_path / "n.csv").write_text('title,body,source,source_url,published_at\nT,"B",S,u,2024-01-01T00:00:00Z\nT,B,S,u,never\n')
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>T</title><link>u</link><description>&lt;p&gt;A &amp;amp; B&lt;/p&gt;</description><pubDate>Mon, 1 Jan 2024 00:00:00 +0000</pubDate></item></channel></rss>")
    j, m, c, r = (f(spark, str(tmp_path / p)).collect() for f, p in ((landing.news_json, "n.json"), (landing.news_json, "m.json"), (landing.news_csv, "n.csv"), (landing.news_rss, "r.xml")))
    assert len(j) == 1 and j[0].content_hash == m[0].content_hash == c[0].content_hash and j[0].news_id.startswith("news_")
    assert c[1].published_at is None and r[0].body == "A & B" and r[0].published_at is not None


def test_retention_and_rewrite(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", datetime.datetime(2024, 1, 1)), (2, "b", datetime.datetime(2025, 1, 1)), (3, "c", None)], "k int, x string, t timestamp").write.parquet(at)
    tables.rewrite(tables.retained(spark.read.parquet(at), "x", "t", "2024-06-01"), at)
    assert {r.k: r.x for r in spark.read.parquet(at).collect()} == {1: None, 2: "b", 3: "c"}


def test_keep_first(spark):
    d = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a"), ("g", 3, "c")], "h string, n int, v string")
    assert {(r.h, r.v) for r in landing.keep_first(d, "h", "n").collect()} == {("h", "a"), ("g", "c")}


def test_running_ranks_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 101, i) for i in range(900)] + [(None, 1, 1000), (None, 2, 1001)]
    d = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: (r._rank, r._cum) for r in running(d, ["g"], [F.col("v"), F.col("i")], F.col("v"), parts=5).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        cum = 0
        for k, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            cum += v
            want[i] = (k, float(cum))
    assert got == want


def run(q):
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    at = str(tmp_path / "in")
    schema = "key string, date date, raw_state string, confidence double, t timestamp, v double"
    rows = [("k", D(2024, m, 1), s, c, datetime.datetime(2024, m, 1), 1.0) for m, s, c in ((1, "G", 0.3), (2, "T", 0.1), (3, None, None), (4, "T", 0.1))]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)
    src = lambda: feeds.landed(spark, at, schema)
    run(feeds.held_states(src(), 0.02, 2).writeStream.format("memory").queryName("held").outputMode("append").start())
    assert [r.reason for r in spark.sql("select * from held order by date").collect()] == ["initial_state", "awaiting_confirmation", "invalid", "switch_confirmed"]
    run(feeds.windowed_scores(src(), "t", "key", "v", "70 days").writeStream.format("memory").queryName("win").outputMode("complete").start())
    assert sum(r.n for r in spark.sql("select * from win").collect()) == 4
    run(feeds.first_seen(src(), "t", "key", "400 days").writeStream.format("memory").queryName("seen").outputMode("append").start())
    assert spark.sql("select * from seen").count() == 1
    seen = []
    feeds.by_batch(src(), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 4

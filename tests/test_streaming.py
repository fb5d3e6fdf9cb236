import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora import streaming as ST
from mnemora.operators import documents as D
from mnemora.operators import history as HI
from mnemora.operators import index as I
from mnemora.operators import search as S
from mnemora.rules import Rules

T0 = dt.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp, received_at timestamp, url string, title string, query string"


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(i % 7, T0, T0 + dt.timedelta(hours=i), f"u{i % 7 % 3}", "t", "q" if i % 7 != 3 else None) for i in range(20)]
    for k in range(4):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5], CLICKS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    schema = spark.createDataFrame([], CLICKS).schema
    s = ST.read(spark, str(tmp_path / "in"), schema, per_trigger=1)
    ST.click_counts(s, str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination()
    batch = HI.counts(HI.deduplicated(spark.createDataFrame(rows, CLICKS)))
    assert {tuple(r) for r in ST.latest_counts(spark, str(tmp_path / "out")).select("query", "url", "count").collect()} == {tuple(r) for r in batch.select("query", "url", "count").collect()}


def test_ingest_keeps_the_last_version_and_can_run_again(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "text", "html", "favicon")] + [T.StructField("captured_at", T.TimestampType())])
    for k, text in enumerate(("one", "two")):
        spark.createDataFrame([("http://a/x#f", "t", text, None, None, T0 + dt.timedelta(k)), ("bad", "t", "x", None, None, T0)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ST.ingest(ST.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c"), Rules()).awaitTermination()
    ST.ingest(ST.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c"), Rules()).awaitTermination()
    got = ST.current(spark, str(tmp_path / "out")).collect()
    assert [(r.url, r.text, r.favicon) for r in got] == [("http://a/x", "two", "http://a/favicon.ico")]


def test_stream_changes_equal_batch(spark, tmp_path):
    schema = "key string, at timestamp, id long, content long, forced boolean"
    rows = [(f"k{i % 2}", T0 + dt.timedelta(minutes=i // 2), i, 2**53 + i // 4 if i % 7 else None, i == 9) for i in range(32)]
    for k in range(2):
        spark.createDataFrame(rows[k * 16 : k * 16 + 16] + [(None, T0, 99, 1, True)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = ST.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_trigger=1)
    ST.run_to_folder(ST.changes(source), str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = D.changed(spark.createDataFrame(rows, schema), "key", "content", "at", "id", force="forced")
    assert {tuple(r) for r in out.select("key", "at", "id", "content").collect()} == {tuple(r) for r in batch.select("key", "at", "id", "content").collect()}
    assert batch.agg(F.count("*")).first()[0] > 8


def test_stream_of_queries_equals_single_searches(spark, tmp_path):
    docs = spark.createDataFrame([("u1", "Red fox", "a fox runs"), ("u2", "Hen", "a hen and a fox"), ("u3", "Hen", "alone")], "url string, title string, text string")
    posts = I.postings(docs)
    texts = {1: "fox", 2: "hen -fox", 3: "/[/", 4: "fo* title:hen", 5: "-fox"}
    for q in texts.items():
        spark.createDataFrame([q], "query_id long, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = ST.read(spark, str(tmp_path / "in"), spark.createDataFrame([], "query_id long, text string").schema, per_trigger=3)
    ST.answers(source, posts, docs, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.query_id, r["rank"], r.url, r.relevance) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(i, k, r.url, r.relevance) for i, t in texts.items() for k, r in enumerate(S.top(posts, docs, t).collect(), 1)}

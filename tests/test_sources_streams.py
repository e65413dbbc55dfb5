"""HTML, files, streams."""

import pytest
from pyspark.sql import functions as F

from veilmark.operators import telemetry
from veilmark.sources import files, html
from veilmark.streaming import streams

PAGE = """<html><head><title>T &amp; U</title><script>var t = "</p>";</script></head><body><nav><a href="/a">A</a><a href="/b">B</a></nav>
<h1>Head</h1><p>One <b>bold</b><p>Two<br>lines<ul><li>x<li>y</ul><form><label for="u">User</label><input id="u" type="text" placeholder="name"><input type="checkbox" checked><div style="display: none"><p>gone</p></div></form>
<table><tr><th>M<th>N<tr><td>1<td>2</table><img src="i.png" alt="pic"></body></html>"""


def test_tokenizer():
    rows = html.tokenize(PAGE)
    by = {}
    for r in rows:
        by.setdefault(r["tag"], []).append(r)
    assert by["title"][0]["text"] == "T & U"
    assert [r["text"] for r in by["p"][:2]] == ["One bold", "Two lines"]
    assert [r["text"] for r in by["li"]] == ["x", "y"] and [r["text"] for r in by["td"]] == ["1", "2"] and [r["text"] for r in by["th"]] == ["M", "N"]
    assert by["a"][1]["xpath"].endswith("nav[1]/a[2]") and by["img"][0]["alt"] == "pic"
    assert by["p"][2]["hidden"] is True and by["p"][0]["hidden"] is False
    assert [r["checked"] for r in by["input"]] == [None, True]
    assert [r["ord"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("bad", ["", None, "<", "<p", "</p></p>", "text only", "<p>" * 300])
def test_tokenizer_on_odd_input(bad):
    html.tokenize(bad)


def test_elements_and_labels(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", None), ("c", "")], "page_id string, html string")
    e = html.with_labels(html.elements(df))
    got = e.filter("html_id = 'u'").first()
    assert got["label"] == "User" and got["page_id"] == "a"
    assert e.select("page_id").distinct().count() == 1


def test_data_urls(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),), (None,)], "c binary").select(files.data_url(F.col("c")).alias("u"))
    got = [r["u"] for r in df.collect()]
    assert got[0] == "data:image/png;base64,YWJj" and got[1] == got[2] == "data:image/png;base64," + files.EMPTY_PNG
    assert bytes(df.select(files.from_data_url(F.col("u")).alias("b")).first()["b"]) == b"abc"


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_results(df, str(tmp_path / "one"), str(tmp_path / "two"))
    assert files.read_results(spark, str(tmp_path / "two"), "a int, b string").collect() == df.collect()


@pytest.fixture
def events(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    path = str(tmp_path / "events")
    e.repartition(3).write.parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp")), streams.read_events(spark, path, e.schema)


def test_windows_equal_batch(spark, events, tmp_path):
    batch, stream = events
    got = streams.collect_available(stream.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")), "win")
    want = batch.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tumbling_reaches_parquet(spark, events, tmp_path):
    batch, stream = events
    streams.run_available(streams.tumbling(stream, late="400 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    # nothing is closed before the watermark passes; nothing is late either
    assert spark.read.schema("event_type string, start timestamp, n long").parquet(str(tmp_path / "out")).count() == 0


def test_running_counts(spark, events):
    batch, stream = events
    got = {r["event_type"]: r["n"] for r in streams.collect_available(streams.running_counts(stream), "run").collect()}
    assert got == {r["event_type"]: r["count"] for r in batch.groupBy("event_type").count().collect()}


def test_each_event_once(spark, events, data, tmp_path):
    batch, _ = events
    path = str(tmp_path / "twice")
    raw = spark.read.parquet(f"{data}/events.parquet")
    raw.unionByName(raw).repartition(1).write.parquet(path)
    s = streams.once(streams.read_events(spark, path, raw.schema), late="400 days")
    assert streams.collect_available(s, "once", "append").count() == batch.count()


def test_liveness_stream(spark, tmp_path):
    path = str(tmp_path / "beats")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:05")]
    spark.createDataFrame(rows, "agent string, ts string").select("agent", F.col("ts").cast("timestamp").alias("ts")).repartition(1).write.parquet(path)
    s = spark.readStream.schema("agent string, ts timestamp").parquet(path)
    got = {(r["agent"], r["state"], str(r["at"])) for r in streams.collect_available(streams.liveness(s, "agent"), "live", "append").collect()}
    assert {("a", "connected", "2024-01-01 00:00:00"), ("a", "disconnected", "2024-01-01 00:00:40"), ("a", "connected", "2024-01-01 00:01:00"), ("b", "connected", "2024-01-01 00:00:05")} <= got


def test_safe_split(spark, tmp_path):
    schema = "page_id string, element_id string, ord int, tag string, text string, label string, placeholder string, alt string, input_type string, autocomplete string, selected_value string, href string, src string"
    rows = [("ok", "e", 1, "p", "fine") + (None,) * 8, ("bad", "e", 1, "p", "a@b.example") + (None,) * 8]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.split_safe(s, str(tmp_path / "safe"), str(tmp_path / "held"), str(tmp_path / "cp")).awaitTermination()
    assert [r["page_id"] for r in spark.read.parquet(str(tmp_path / "safe")).collect()] == ["ok"]
    assert [r["page_id"] for r in spark.read.parquet(str(tmp_path / "held")).collect()] == ["bad"]


def test_batch_liveness(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:40")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["k"]: r["connected"] for r in telemetry.liveness(df, "k", "ts", F.lit("2024-01-01 00:00:45").cast("timestamp")).collect()}
    assert got == {"a": False, "b": True}


def test_safe_split_of_a_page_in_two_batches(spark, tmp_path):
    """A page whose second half is refused is not released, nor what follows of it."""
    schema = "page_id string, element_id string, ord int, tag string, text string, label string, placeholder string, alt string, input_type string, autocomplete string, selected_value string, href string, src string"
    paths = [str(tmp_path / x) for x in ("in", "safe", "held", "cp")]
    for i, text in enumerate(("fine", "a@b.example", "fine again")):
        rows = [("late", f"e{i}", i, "p", text) + (None,) * 8, ("ok", f"e{i}", i, "p", "fine") + (None,) * 8]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])
        streams.split_safe(spark.readStream.schema(schema).parquet(paths[0]), *paths[1:]).awaitTermination()
    got = sorted((r["page_id"], r["element_id"]) for r in streams.released(spark, paths[1], paths[2]).collect())
    assert got == [("ok", "e0"), ("ok", "e1"), ("ok", "e2")]
    assert sorted(r["element_id"] for r in spark.read.parquet(paths[2]).collect()) == ["e1", "e2"]

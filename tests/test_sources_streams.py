from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.sources.readers import csv, files, html_links, import_key, merge_by_key, recorded_json, sitemap_links, write_batch
from inkwell.streaming.events import delivered, once, read_events, run, windowed


def test_files_by_size_and_magic(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"x" * 1000)
    got = files(spark, str(tmp_path), 100, "*.pdf", b"%PDF-").select("path").collect()
    assert [r[0].rsplit("/", 1)[1] for r in got] == ["a.pdf"]


def test_recorded_answers_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"record_id": 1, "page": 2, "answer": "[]"}\nkaputt\n')
    assert sorted((r[0] or 0, r[1] or 0) for r in recorded_json(spark, str(tmp_path / "a.json")).collect()) == [(0, 0), (1, 2)]
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,\n")
    assert [tuple(r) for r in csv(spark, str(tmp_path / "a.csv"), "id int, name string").collect()] == [(1, "x"), (2, None)]


def test_links(spark):
    page = spark.createDataFrame([("https://a.example/x/i.html", '<a href="b.pdf"><a href="/c.PDF?1"><a href="d.txt">')], "base string, html string")
    assert {r["link"] for r in html_links(page, "html", "base", ".pdf").collect()} == {"https://a.example/x/b.pdf", "https://a.example/c.PDF?1"}
    maps = spark.createDataFrame([("<urlset><url><loc>u</loc></url></urlset>",), ("<urlset><url>",), (None,)], "xml string")
    assert [(r["loc"], r["is_index"]) for r in sitemap_links(maps, "xml").collect()] == [("u", False)]


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 9)], "k string, rank int, v int")
    new = spark.createDataFrame([("a", 2, 6), ("b", 1, 1), ("c", 0, 3)], "k string, rank int, v int")
    order = [F.col("rank"), F.col("is_new")]
    first = merge_by_key(old, new, "k", order)
    assert sorted(map(tuple, first.collect())) == [("a", 2, 6), ("b", 2, 9), ("c", 0, 3)]
    assert sorted(map(tuple, merge_by_key(first, new, "k", order).collect())) == sorted(map(tuple, first.collect()))
    keys = old.select(import_key("v", "rank").alias("x")).union(old.select(import_key("rank", "v"))).distinct().count()
    assert keys == 2


def test_batch_written_twice_stays_once(spark, tmp_path):
    df, sink = spark.range(3), write_batch(str(tmp_path / "out"))
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 7, f"2025-01-01 00:{i:02d}:00", "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    s = read_events(spark, str(tmp_path), files_per_batch=1)
    assert run(once(s, "event_id")).count() == 7
    assert run(once(s, "event_id", "ts")).count() == 7
    got = run(windowed(s, "ts", ["event_type"], "10 minutes", "1 hour", F.sum("value").alias("v")), "complete")
    expected = df.groupBy(F.window(F.col("ts").cast("timestamp"), "10 minutes"), "event_type").agg(F.sum("value").alias("v"))
    assert sorted((r[0][0], r[1], r[2]) for r in got.collect()) == sorted((r[0][0], r[1], r[2]) for r in expected.collect())


def test_attempts(spark):
    r = lambda *a: tuple(spark.range(1).select(delivered(F.array(*map(F.lit, a)), 3).alias("d")).head()["d"])
    assert r(False, True, True) == (2, "delivered")
    assert r(False, False, False, True) == (3, "dead")
    assert r(False) == (1, "pending")

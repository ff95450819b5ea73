import json

import pytest
from pyspark.sql import functions as F

from tidewire.sources import feeds, sinks


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>One &amp; &lt;b&gt;two&lt;/b&gt;</title><link>https://E.org/a/?utm_source=x</link><description>text</description><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item></channel></rss>")
    rows = feeds.rss(spark, str(tmp_path)).collect()
    assert [(r["title"], r["url"], r["description"]) for r in rows] == [("One & two", "https://e.org/a", "text")]


def test_json_feeds(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"articles": [{"title": "t", "url": "http://e.org/", "source": {"name": "S"}}]}))
    assert [(r["title"], r["url"], r["source"]) for r in feeds.news_json(spark, str(tmp_path)).collect()] == [("t", "http://e.org/", "S")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/e.json").write_text(json.dumps({"features": [{"geometry": {"coordinates": [1.5, 2.5]}, "properties": {"id": "x", "title": "fire", "categories": []}}]}))
    assert [tuple(r) for r in feeds.natural_events(spark, str(tmp_path / "g")).collect()] == [("x", "fire", "unknown", 1.5, 2.5)]


def test_fires(spark, tmp_path):
    head = "latitude,longitude,bright,scan,track,acq_date,acq_time,satellite,confidence,version,bright2,frp,daynight\n"
    row = "{},{},1,1,1,2024-01-01,100,N,{},2,1,{},D\n"
    (tmp_path / "f.csv").write_text(head + row.format(1, 2, "nominal", 20) + row.format(1, 2, "low", 20) + row.format(1, 2, "high", "x") + row.format("bad", 2, "high", 50))
    assert [(r["lat"], r["power"]) for r in feeds.fires(spark, str(tmp_path)).collect()] == [(1.0, 20.0)]


def test_messages_and_posts(spark):
    html = '<div class="message x"><p>A message long enough</p><a href="https://e/1">l</a><time datetime="2024-01-01"></time></div><div class="message">short</div>'
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [(r["text"], r["url"], r["posted"]) for r in feeds.messages(pages).collect()] == [("A message long enough l", "https://e/1", "2024-01-01")]
    island = '<script type="application/json">{"entries": [{"id": "7", "text": "hello", "created_at": "now"}]}</script>'
    assert [r["status_id"] for r in feeds.timeline_posts(spark.createDataFrame([(1, island)], "page_id int, html string")).collect()] == ["7"]


def test_fallback_strategies(spark):
    frame = lambda rows: spark.createDataFrame(rows, "source string, v int")
    got = feeds.first_non_empty(frame([("a", 1)]), frame([("a", 2), ("b", 3)]), frame([("b", 4), ("c", 5)]))
    assert sorted((r["source"], r["v"]) for r in got.collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_imports(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p])
    closed, open_, far = ring((0, 0), (1, 0), (1, 1), (0, 0)), ring((0, 0), (1, 0), (1, 1), (2, 2)), ring((0, 0), (200, 0), (1, 1), (0, 0))
    row = spark.range(1).select(*[feeds.valid_import(F.array(r)).alias(n) for n, r in (("closed", closed), ("open", open_), ("far", far))]).first()
    assert row.asDict() == {"closed": True, "open": False, "far": False}


def test_geonames(spark, tmp_path):
    fields = ["5", "Sankt", "Sankt", "San,Saint X", "1.5", "2.5", "P", "PPL", "DE", "", "01", "", "", "", "900", "", "", "", ""]
    (tmp_path / "c.tsv").write_text("\t".join(fields) + "\n")
    r = feeds.geonames(spark, str(tmp_path)).first()
    assert (r["id"], r["alternates"], r["country"], r["region"], r["population"]) == (5, ["San", "Saint X"], "DE", "01", 900)


@pytest.mark.parametrize("version", ["v1"])
def test_commit_writes_the_next_version(spark, tmp_path, version):
    path = str(tmp_path / "stories")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").write.parquet(path)
    patch = spark.createDataFrame([(2, None, True)], "id int, t string, t_set boolean")
    new = sinks.commit(spark, path, spark.createDataFrame([(3, "c")], "id int, t string"), patch, version)
    again = sinks.commit(spark, path, spark.createDataFrame([(3, "c")], "id int, t string"), patch, version)
    assert new == again and sorted(map(tuple, spark.read.parquet(new).collect())) == [(1, "a"), (2, None), (3, "c")]

"""Source and sink queries: rows of the tables land as files of each form in the shared folder, and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import ingest
from ..operators.shared import new_folder
from ..sources import feeds, sinks
from ..sources.replies import FeedReplies
from .base import HOUR_MS, NOW_MS, query, table

MS = "(epoch_us(ts) // 1000)"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


def landed(spark: SparkSession, name: str, lines: DataFrame, suffix: str = "") -> str:
    """A new folder with ``lines`` as text files; with a ``feed``, each line is a file of its own in that feed's folder."""
    path = new_folder(spark, name)
    writer = lines.write.option("lineSep", "\n")
    (writer.partitionBy("feed").option("maxRecordsPerFile", 1) if "feed" in lines.columns else writer).text(path)
    return path


def iso(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _items(spark: SparkSession, sf_dir: str, form: str) -> str:
    """Files of two thousand items or fewer for each of seven feeds."""
    e = table(spark, sf_dir, "events").select(F.format_string(form, "event_type", "event_id", "event_id", iso()).alias("item"), (F.col("user_id") % 7).alias("feed"), F.floor(F.col("event_id") / 2000).alias("part"))
    whole = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>"))
    return landed(spark, "feed", e.groupBy("feed", "part").agg(whole.alias("value")).select("feed", "value"))


ITEM = "<item><title>%s &amp;amp; report %d</title><link>https://News.example/%d/?utm_source=f#top</link><description><![CDATA[<p>one<br>two</p>]]></description><pubDate>%s</pubDate></item>"
ENTRY = "<entry><title>%s report %d</title><link>https://news.example/%d</link><updated>%s</updated></entry>"


@query("SELECT 'https://news.example/' || CAST(event_id AS VARCHAR) AS url, event_type || ' & report ' || CAST(event_id AS VARCHAR) AS title, 'one two' AS description, " + MS + " // 1000 AS at_s FROM events")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of RSS files, cleaned, with canonical addresses and times."""
    rows = feeds.rss(spark, _items(spark, sf_dir, ITEM) + "/*")
    at = scores.safe_time(F.col("published"), F.lit("2030-01-01").cast("timestamp"))
    return rows.select("url", "title", "description", F.unix_timestamp(F.to_utc_timestamp(at, F.current_timezone())).alias("at_s"))


#: Replies of seven feeds, one for each two thousand events: some not modified, one broken, some refused.
_REPLIES = f"""e AS (SELECT user_id % 7 AS feed, event_id // 2000 AS part, event_id, {MS} // 1000 AS s FROM events),
  r AS (SELECT feed, part, CASE (feed + part) % 5 WHEN 1 THEN 304 WHEN 2 THEN 503 ELSE 200 END AS status, (feed + part) % 5 = 3 AS broken, max(s) AS last_s, count(*) AS held, count(*) FILTER (s * 1000 >= {NOW_MS - 240 * HOUR_MS}) AS fresh, max(s) FILTER (s * 1000 >= {NOW_MS - 240 * HOUR_MS}) AS fresh_s FROM e GROUP BY 1, 2)"""


def _replies(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.format_string(ITEM, "event_type", "event_id", "event_id", iso()).alias("item"), (F.col("user_id") % 7).alias("feed"), F.floor(F.col("event_id") / 2000).alias("part"), F.unix_seconds(F.to_utc_timestamp(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.current_timezone())).alias("s"))
    whole = e.groupBy("feed", "part").agg(F.array_join(F.collect_list("item"), "").alias("items"), F.max("s").alias("s"))
    kind = (F.col("feed") + F.col("part")) % 5
    body = F.concat(F.lit("<rss><channel>"), "items", F.when(kind == 3, "</rss>").otherwise("</channel></rss>"))
    known = F.when(F.col("part") % 2 == 0, F.col("s") * 1000)
    source = F.concat(F.lit("feed "), F.col("feed").cast("string"), F.lit("/"), F.col("part").cast("string"))
    status = F.when(kind == 1, 304).when(kind == 2, 503).otherwise(200)
    path = new_folder(spark, "replies")
    whole.select("feed", source.alias("source"), F.lit("https://feed.example/").alias("url"), status.alias("status"), F.concat(F.lit("v"), F.col("part").cast("string")).alias("etag"), body.alias("body"), F.lit("news").alias("category"), F.lit("NO").alias("country"), known.alias("known_ms")).write.partitionBy("feed").json(path)
    spark.dataSource.register(FeedReplies)
    return spark.read.format("feed_replies").options(path=path, rows=rows, now_ms=NOW_MS, age_ms=240 * HOUR_MS).load()


@query(f"""WITH {_REPLIES} SELECT 'feed ' || CAST(feed AS VARCHAR) || '/' || CAST(part AS VARCHAR) AS source, CAST(status AS INTEGER) AS status,
  CASE WHEN status = 503 THEN 'provider_error' WHEN status = 304 THEN CASE WHEN part % 2 = 1 THEN 'empty' WHEN last_s * 1000 >= {NOW_MS - 240 * HOUR_MS} THEN 'healthy' ELSE 'stale' END WHEN broken THEN 'parse_error' WHEN fresh > 0 THEN 'healthy' ELSE 'empty' END AS outcome,
  CASE WHEN status = 503 THEN 'http_503' WHEN status = 304 AND part % 2 = 1 THEN 'freshness_unknown' WHEN status = 200 AND broken THEN 'invalid_xml' END AS error_code,
  CAST(CASE WHEN status = 200 AND NOT broken THEN held ELSE 0 END AS INTEGER) AS fetched, CAST(CASE WHEN status = 200 AND NOT broken THEN fresh ELSE 0 END AS INTEGER) AS accepted,
  CASE WHEN status = 304 AND part % 2 = 0 THEN last_s * 1000 WHEN status = 200 AND NOT broken THEN fresh_s * 1000 END AS latest_ms, 'v' || CAST(part AS VARCHAR) AS etag FROM r""")
def feed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt row for each landed reply, by a data source; one that was not modified is judged by what was known."""
    return _replies(spark, sf_dir, "attempts").select("source", "status", "outcome", "error_code", "fetched", "accepted", "latest_ms", "etag")


@query(f"""WITH {_REPLIES} SELECT 'feed ' || CAST(e.feed AS VARCHAR) || '/' || CAST(e.part AS VARCHAR) AS source, 'https://news.example/' || CAST(event_id AS VARCHAR) AS url, s * 1000 AS published_ms, 'news' AS category, 'NO' AS country
  FROM e JOIN r ON e.feed = r.feed AND e.part = r.part WHERE status = 200 AND NOT broken AND s * 1000 >= {NOW_MS - 240 * HOUR_MS}""")
def feed_reply_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fresh items of landed replies with their sources' category and country; 304 and errors have none."""
    return _replies(spark, sf_dir, "items").select("source", text.canonical_url(F.col("url")).alias("url"), "published_ms", "category", "country")


@query(f"""WITH f AS (SELECT user_id % 7 AS feed, event_id, {MS} // 1000 * 1000 AS ms FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ms DESC, 'https://news.example/' || CAST(event_id AS VARCHAR)) AS k FROM f WHERE ms BETWEEN {NOW_MS - 72 * HOUR_MS} AND {NOW_MS + 300000})
  SELECT feed, 'https://news.example/' || CAST(event_id AS VARCHAR) AS url FROM r WHERE k <= 5""")
def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five entries of each Atom feed, recent ones alone."""
    rows = feeds.rss(spark, _items(spark, sf_dir, ENTRY) + "/*", "entry")
    at = scores.safe_time(F.col("published"), F.lit("2030-01-01").cast("timestamp"))
    rows = rows.withColumns({"published_ms": F.unix_millis(F.to_utc_timestamp(at, F.current_timezone())), "feed": F.regexp_extract("source", "feed=([0-9]+)", 1).cast("bigint")})
    return feeds.newest(rows, "feed", NOW_MS, 72 * HOUR_MS, 5).select("feed", "url")


@query(f"""SELECT event_id, user_id AS channel, event_type || ' number ' || CAST(event_id AS VARCHAR) AS text, 'https://t.example/' || CAST(event_id AS VARCHAR) AS url, {ISO} AS posted,
  CASE event_id % 3 WHEN 0 THEN 'https://t.example/' || CAST(event_id AS VARCHAR) ELSE 'https://t.example/' || CAST(event_id AS VARCHAR) || ' https://other.example/' END AS links,
  CASE WHEN event_id % 4 < 3 THEN 'https://img.example/' || CAST(event_id AS VARCHAR) || '.jpg' END AS image FROM events""")
def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of channel pages, one page for each channel, with their links and pictures."""
    i = F.col("event_id")
    more = F.when(i % 3 == 1, '<a href="tg://resolve?domain=x">open</a><a href="https://other.example/">').when(i % 3 == 2, '<a href="https://other.example/">').otherwise('<a href="TG:join">')
    address = F.concat(F.lit("https://img.example/"), i.cast("string"), F.lit(".jpg"))
    style = F.when(i % 4 == 0, F.concat(F.lit("width:1px;background-image:url('"), address, F.lit("')"))).when(i % 4 == 1, F.concat(F.lit("background-image: url("), address, F.lit(")"))).when(i % 4 == 2, F.concat(F.lit("background-image:url(&quot;"), address, F.lit("&quot;)"))).otherwise("background-image:url('data:image/png;base64,xx')")
    block = F.format_string('<div class="tg message js"><i style="%s"></i><p>%s number %d</p><a href="https://t.example/%d"></a><span>%s</a></span><time datetime="%s"></time></div><div class="message">no</div>', style, "event_type", "event_id", "event_id", F.regexp_replace(more, "open", ""), iso())
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("channel")).agg(F.array_join(F.collect_list(block), "").alias("html"))
    m = feeds.messages(pages)
    return m.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint").alias("event_id"), "channel", "text", "url", "posted", F.array_join("links", " ").alias("links"), "image")


@query("""WITH f AS (SELECT user_id % 11 AS source, event_id % 3 AS strategy, event_id FROM events WHERE NOT (event_id % 3 = 0 AND user_id % 2 = 0)), b AS (SELECT source, min(strategy) AS strategy FROM f GROUP BY source)
  SELECT source, CAST(event_id AS VARCHAR) AS status_id FROM f JOIN b USING (source, strategy)""")
def timeline_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in the JSON of timeline pages, of the first strategy that has any for a source."""
    e = table(spark, sf_dir, "events").where("not (event_id % 3 = 0 and user_id % 2 = 0)").select((F.col("user_id") % 11).alias("source"), (F.col("event_id") % 3).alias("strategy"), F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("text"), iso().alias("created_at")).alias("e"))
    island = F.concat(F.lit('<html><script id="data" type="application/json">'), F.to_json(F.struct(F.collect_list("e").alias("entries"))), F.lit("</script></html>"))
    pages = e.groupBy("source", "strategy").agg(island.alias("html"))
    parts = [feeds.timeline_posts(pages.where(F.col("strategy") == i).drop("strategy")) for i in range(3)]
    return feeds.first_non_empty(*parts).select("source", "status_id")


@query("SELECT 'https://e.example/' || CAST(doc_id AS VARCHAR) AS url, source, lang AS title, CASE WHEN doc_id % 3 = 0 THEN 'rate_limited' WHEN doc_id % 3 = 1 THEN 'success' ELSE 'provider_error' END AS outcome FROM documents")
def news_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a news interface's JSON, and what the replies' status says."""
    i = F.col("doc_id")
    article = F.struct(F.col("lang").alias("title"), F.format_string("https://E.example/%d?fbclid=1", "doc_id").alias("url"), F.struct(F.col("source").alias("name")).alias("source"))
    d = table(spark, sf_dir, "documents").select((i % 9).alias("feed"), article.alias("a"))
    path = landed(spark, "news", d.groupBy("feed").agg(F.to_json(F.struct(F.collect_list("a").alias("articles"))).alias("value")))
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint")
    status = F.when(number % 6 == 0, 403).when(number % 6 == 3, 429).when(number % 3 == 1, 200).otherwise(500)
    return feeds.news_json(spark, path + "/*").select("url", "source", "title", scores.http_outcome(status).alias("outcome"))


@query("SELECT CAST(event_id % 90 AS DOUBLE) AS lat, CAST(user_id % 180 AS DOUBLE) AS lon, CAST(event_id % 40 AS DOUBLE) AS power FROM events WHERE event_id % 40 >= 10 AND event_id % 3 <> 0")
def active_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire detections in CSV, none of low confidence or power."""
    i = F.col("event_id")
    line = F.format_string("%d,%d,300,1,1,2024-01-01,100,N,%s,2,290,%s,D", i % 90, F.col("user_id") % 180, F.when(i % 3 == 0, "Low").otherwise("nominal"), F.when(i % 40 == 0, "none").otherwise((i % 40).cast("string")))
    path = landed(spark, "fires", table(spark, sf_dir, "events").select(line.alias("value")))
    return feeds.fires(spark, path, header=False).select("lat", "lon", "power")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'cat' || CAST(event_id % 4 AS VARCHAR) END AS category, CAST(user_id AS DOUBLE) AS lon, CAST(event_id % 80 AS DOUBLE) AS lat FROM events")
def natural_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of GeoJSON files, the first category or unknown."""
    i = F.col("event_id")
    cats = F.when(i % 4 == 0, F.array().cast("array<struct<id: string>>")).otherwise(F.array(F.struct(F.concat(F.lit("cat"), (i % 4).cast("string")).alias("id")), F.struct(F.lit("second").alias("id"))))
    props = F.struct(i.cast("string").alias("id"), F.col("event_type").alias("title"), cats.alias("categories"))
    f = F.struct(F.struct(F.array(F.col("user_id").cast("double"), (i % 80).cast("double")).alias("coordinates")).alias("geometry"), props.alias("properties"))
    e = table(spark, sf_dir, "events").select((i % 5).alias("feed"), f.alias("f"))
    path = landed(spark, "natural", e.groupBy("feed").agg(F.to_json(F.struct(F.collect_list("f").alias("features"))).alias("value")))
    return feeds.natural_events(spark, path + "/*")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, 'C' || CAST(c_nationkey AS VARCHAR) AS country, CAST(c_custkey % 7 AS VARCHAR) AS region, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 10 END AS population, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS alternates FROM customer")
def gazetteer_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities of a dump in tab-separated text."""
    i = F.col("c_custkey")
    cells = [i.cast("string"), F.col("c_name"), F.col("c_name"), F.when(i % 2 == 0, "a,b").otherwise(""), F.lit("1.5"), F.lit("2.5"), F.lit("P"), F.lit("PPL"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")), F.lit(""), (i % 7).cast("string"), F.lit(""), F.lit(""), F.lit(""), F.when(i % 5 == 0, "").otherwise((i * 10).cast("string"))]
    path = landed(spark, "gazetteer", table(spark, sf_dir, "customer").select(F.concat_ws("\t", *cells).alias("value")))
    return feeds.geonames(spark, path).select("id", "name", "country", "region", "population", F.size("alternates").alias("alternates"))


@query("SELECT o_orderkey AS id, o_orderkey % 4 = 0 OR o_orderkey % 4 = 3 AS valid FROM orders")
def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rings in GeoJSON text: closed, in range, not too many."""
    i = F.col("o_orderkey")
    ring = F.when(i % 4 == 1, "[[0,0],[1,0],[1,1],[2,2]]").when(i % 4 == 2, "[[0,0],[200,0],[1,1],[0,0]]").otherwise("[[0,0],[1,0],[1,1],[0,0]]")
    feature = F.concat(F.lit('{"geometry":{"type":"Polygon","coordinates":['), ring, F.lit("]}}"))
    text = F.concat(F.lit('{"features":['), feature, F.when(i % 4 == 3, F.concat(F.lit(","), feature)).otherwise(""), F.lit("]}"))
    return table(spark, sf_dir, "orders").select(i.alias("id"), feeds.valid_import(feeds.imported_rings(text)).alias("valid"))


@query("SELECT source, count(*) AS items, 2 AS runs FROM documents GROUP BY source")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that two runs append to, and each source's attempts in it."""
    path = new_folder(spark, "ledger")
    row = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("items"))
    for _ in range(2):
        sinks.append_ledger(row, path)
    return spark.read.parquet(path).groupBy("source").agg(F.max("items").alias("items"), F.count("*").cast("int").alias("runs"))


@query("SELECT 'v' || CAST(c_custkey AS VARCHAR) AS source, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS etag FROM customer")
def feed_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validators kept for each source, those of the last fetch in place of older ones."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("source"), "c_custkey")
    path = new_folder(spark, "validators")
    c.select("source", F.lit("old").alias("etag")).write.parquet(f"{path}/v")
    new = c.where("c_custkey % 3 = 0").select("source", F.lit("new").alias("etag"))
    return spark.read.parquet(sinks.commit(spark, f"{path}/v", new, None, "2", key="source"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON and read back."""
    path = new_folder(spark, "report")
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    sinks.report(made, path)
    return spark.read.schema("status string, n bigint, total double").json(path)


@query("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS expected, false AS blind FROM events UNION ALL SELECT event_id, NULL, true FROM events")
def benchmark_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items with what was predicted of them, and a blind copy without it."""
    path = new_folder(spark, "snapshot")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("expected"))
    sinks.snapshot(rows, ["expected"], path)
    read = lambda name: spark.read.schema("id bigint, title string, expected string").json(f"{path}/{name}")
    return read("full").withColumn("blind", F.lit(False)).unionByName(read("blind").withColumn("blind", F.lit(True))).select("id", "expected", "blind")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND source NOT IN ('src1', 'src4') GROUP BY source")
def due_open_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the sources that are due and whose circuit is not open."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("rss").alias("source_type"), F.col("source").alias("source_name"))
    failed = spark.createDataFrame([("rss", s, "provider_error", "http_503", NOW_MS - i, i) for s in ("src1", "src4") for i in range(3)], "source_type string, source_name string, outcome string, error_code string, at_ms bigint, seq int")
    open_ = ingest.without_open(d.where("doc_id % 2 = 0"), ingest.open_circuits(failed, NOW_MS))
    return open_.groupBy(F.col("source_name").alias("source")).agg(F.count("*").alias("n"))

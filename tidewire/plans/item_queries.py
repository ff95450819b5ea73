"""Queries over items and stories: their forms, source lists, pictures, geometry, parameters and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scores, text
from ..operators import feed, geocode, items, resolution
from ..operators import stories as st
from ..operators.feed import FeedQuery
from .base import HOUR_MS, NOW_MS, STORIES, query, stories, table
from .ingest_queries import FP, TITLE

MS = "(epoch_us(ts) // 1000)"


def _later() -> Column:
    return F.lit("2030-01-01").cast("timestamp")


@query("""SELECT event_id AS n, event_type || ' report' AS title, 'https://n.example/' || CAST(event_id AS VARCHAR) AS url, CASE WHEN user_id % 9 < 3 THEN CAST(1 + user_id % 9 AS INTEGER) ELSE 3 END AS credibility_tier, 3.5 - CASE WHEN user_id % 9 < 3 THEN 1 + user_id % 9 ELSE 3 END AS impact_score,
  CASE WHEN event_id % 4 = 0 THEN 'https://i.example/p.png' END AS image_url, CASE WHEN event_id % 4 = 0 THEN 'https://n.example/' || CAST(event_id AS VARCHAR) END AS image_source_url, event_id % 2 = 1 AND user_id % 9 NOT IN (0, 1) AND event_type <> 'error' AND event_id % 3 = 0 AS expires FROM events WHERE event_id % 11 <> 0 AND event_id % 50 <> 7""")
def new_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New stories of items; those without a title or coordinates go."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.when(i % 11 == 0, " ").otherwise(F.concat("event_type", F.lit(" <b>report</b>"))).alias("title"),
        F.when(i % 3 == 0, "an analysis").otherwise("plain words").alias("description"),
        F.format_string("https://N.example/%d?utm_campaign=z", "event_id").alias("url"),
        F.concat(F.lit("src"), (F.col("user_id") % 9).cast("string")).alias("source"),
        F.when(i % 2 == 1, "social").otherwise("rss").alias("source_type"), F.lit("general").alias("category"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published"), F.when(i % 50 != 7, 1.5).alias("lat"), F.lit(2.5).alias("lon"), F.lit(" ").alias("location_name"),
        F.when(i % 4 == 0, "https://i.example/p.png").alias("image_url"), F.lit(None).cast("string").alias("image_source_url"), F.lit(None).cast("string").alias("image_published"), F.lit(None).cast("string").alias("image_origin"),
    )
    # one event type is a term of an event, so that its items stay
    rows = rows.withColumn("description", F.when(F.col("title").startswith("error"), F.concat("description", F.lit(" of an attack"))).otherwise(F.col("description")))
    registry = spark.createDataFrame([("src0", 1), ("src1", 2), ("src2", 3)], "name string, credibility_tier int")
    made = items.to_stories(rows, registry, _later())
    return made.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint").alias("n"), "title", "url", "credibility_tier", "impact_score", "image_url", "image_source_url", F.col("expires_at").isNotNull().alias("expires"))


@query(f"WITH {STORIES} SELECT id, source_type AS \"sourceType\", coalesce(CASE WHEN tier = 1 THEN 7.5 END, lat) AS latitude, lon AS longitude, CAST(volume AS BIGINT) AS \"sourcesCount\" FROM stories")
def reader_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: stories under the names of the reader's interface, a cluster's centre first."""
    s = stories(spark, sf_dir).withColumns({"url": F.col("id"), "source_count": F.col("volume"), "center_lat": F.when(F.col("tier") == 1, 7.5)})
    return items.to_items(s).select("id", "sourceType", "latitude", "longitude", "sourcesCount")


LISTS = "r AS (SELECT l_orderkey AS id, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS n, 'https://s' || CAST(l_suppkey % 4 AS VARCHAR) || '.example/a' AS url, l_partkey AS at_ms FROM lineitem)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.format_string("https://S%d.example/a/?utm_source=%d", F.col("l_suppkey") % 4, F.col("l_partkey"))
    seq = F.col("l_linenumber") * F.lit(100_000_000_000) + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    one = F.struct(seq.alias("n"), F.lit("s").alias("name"), link.alias("url"), F.lit("rss").alias("source_type"), F.col("l_partkey").alias("at_ms"))
    listed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("l"))
    return listed.select("id", F.lit("https://s1.example/a").alias("url"), F.expr("transform(l, x -> struct(x.name, x.url, x.source_type, x.at_ms))").alias("sources"))


@query(f"WITH {LISTS}, f AS (SELECT *, row_number() OVER (PARTITION BY id, url ORDER BY n) AS k FROM r) SELECT id, coalesce(string_agg(CASE WHEN url <> 'https://s1.example/a' THEN url || ' ' || CAST(at_ms AS VARCHAR) END, ',' ORDER BY n), '') AS sources, max(CASE WHEN url = 'https://s1.example/a' THEN at_ms END) AS self_ms FROM f WHERE k = 1 GROUP BY id")
def normal_source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lists with canonical addresses once each, without the story's own, whose first time is kept."""
    listed, at = items.normal_sources(F.col("url"), F.col("sources"))
    return _lists(spark, sf_dir).select("id", F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["url"], x["at_ms"].cast("string"))), ",").alias("sources"), at.alias("self_ms"))


@query(f"WITH {LISTS}, f AS (SELECT *, row_number() OVER (PARTITION BY id, url ORDER BY n) AS k FROM r) SELECT id, count(*) FILTER (url <> 'https://s1.example/a') AS others FROM f WHERE k = 1 GROUP BY id")
def corroborator_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story's sources once for each report, without its own."""
    return _lists(spark, sf_dir).select("id", F.size(items.corroborators(F.col("url"), F.col("sources"))).cast("bigint").alias("others"))


@query("WITH r AS (SELECT conv_id, turn, role FROM conversations), f AS (SELECT conv_id, role, min(turn) AS turn FROM r GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC) AS roles FROM f GROUP BY conv_id")
def timeline_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline's entries once for each address, oldest first, the primary one kept of equals."""
    one = F.struct("turn", F.col("role").alias("url"), (-F.col("turn")).alias("at_ms"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    shown = items.timeline_sources(F.element_at("l", 1), F.slice("l", F.lit(2), F.size("l")))
    return c.select("conv_id", F.array_join(F.transform(shown, lambda x: x["url"]), ",").alias("roles"))


@query("SELECT o_orderkey AS id, CAST(greatest(o_orderkey % 5, n, 1) AS BIGINT) AS event_count, greatest(o_orderkey * 1000, latest) AS latest_ms, greatest(0, n - 2) AS hidden, latest AS shown_ms FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_partkey * 10000) AS latest FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a story, its latest one, and how many a restricted list hides."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct((F.col("l_partkey") * 10000).alias("at_ms"))).alias("sources"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(s, "id")
    at = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    found = F.transform("sources", lambda x: at(x["at_ms"]))
    none = F.lit(None).cast("timestamp_ntz")
    return o.select(
        "id", scores.event_count(F.col("id") % 5, F.col("sources")).alias("event_count"), scores.latest_ms(at(F.col("id") * 1000), none, found).alias("latest_ms"),
        items.hidden_sources(F.size("sources"), F.lit(2)).cast("bigint").alias("hidden"), items.display_ms(F.col("sources"), F.lit(None).cast("bigint"), F.lit(0).cast("bigint")).alias("shown_ms"),
    )


@query(f"""WITH {STORIES} SELECT id, CASE WHEN lat IS NULL THEN false ELSE sqrt(pow(greatest(0, abs(lon) - 30) * cos(radians(lat)), 2) + lat * lat) * 111194.92664455873 < greatest(5, 4 * 156543.03392 * cos(radians(lat)) / 8 * 2.5) END AS on_line,
  CASE WHEN lat IS NULL THEN false ELSE 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2))) < greatest(10, 9 * 6 * 156543.03392 * cos(radians(lat)) / 8) END AS on_point FROM stories""")
def drawing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a drawn line and point is met at a zoom."""
    end = lambda x: F.struct(F.lit(0.0).alias("lat"), F.lit(x).alias("lon"))
    lat, lon, zoom = F.col("lat"), F.col("lon"), F.lit(3.0)
    line = geo.on_line(lat, lon, F.array(end(-30.0), end(0.0), end(30.0)), zoom, F.lit(None).cast("double"))
    point = geo.on_point(lat, lon, F.lit(10.0), F.lit(20.0), zoom, F.lit(9.0))
    return stories(spark, sf_dir).select("id", F.coalesce(line, F.lit(False)).alias("on_line"), F.coalesce(point, F.lit(False)).alias("on_point"))


@query("SELECT c_custkey AS id, round(2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(c_custkey % 90) / 2), 2)))), 6) AS km FROM customer")
def arc_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances by the arc sine."""
    y, zero = (F.col("c_custkey") % 90).cast("double"), F.lit(0.0)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(geo.haversine_asin_km(zero, zero, y, zero), 6).alias("km"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M') ELSE '' END AS shown FROM events")
def local_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as a reader's local time; text without a zone stays."""
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise("not a dateZ")
    return table(spark, sf_dir, "events").select("event_id", scores.local_input(raw, "Asia/Tokyo").alias("shown"))


@query(f"SELECT event_id, CASE event_id % 5 WHEN 4 THEN 1893456000 ELSE {MS} // 1000 END AS at_s FROM events")
def safe_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in several forms; what can't be read, or is ahead, is now."""
    i = F.col("event_id")
    forms = [F.date_format("ts", p) for p in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss 'GMT'")]
    raw = F.when(i % 5 == 0, forms[0]).when(i % 5 == 1, forms[1]).when(i % 5 == 2, F.concat(F.lit("Tue, "), forms[2])).when(i % 5 == 3, forms[2]).otherwise("rubbish")
    at = scores.safe_time(raw, _later())
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.to_utc_timestamp(at, F.current_timezone())).alias("at_s"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN s_suppkey % 256 < 224 AND s_suppkey % 256 NOT IN (0, 10, 127) WHEN 5 THEN false WHEN 6 THEN true ELSE false END AS public FROM supplier")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses of versions 4 and 6 that are public."""
    i = F.col("s_suppkey")
    part = F.lower(F.hex(i))
    forms = [F.concat(F.lit("fe80::"), part), F.concat(F.lit("[2001:db9::"), part, F.lit("]")), F.concat(F.lit("fd00:"), part, F.lit("::1")), F.concat(F.lit("ff02::"), part), F.concat(F.lit("::ffff:"), (i % 256).cast("string"), F.lit(".1.2.3")), F.lit("::1"), F.concat(F.lit("1:2:3:4:5:6:7:"), part), F.concat(F.lit("1::2::"), part)]
    ip = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        ip = F.when(i % 8 == k, form).otherwise(ip)
    return table(spark, sf_dir, "supplier").select(i.alias("id"), geo.public_address(ip).alias("public"))


@query(f"WITH d AS (SELECT doc_id, source, {FP.format(TITLE)} AS fp FROM documents) SELECT doc_id, doc_id % 3 <> 0 AND length(fp) > 0 AND length(trim(regexp_replace('report for ' || fp, '\\s+', ' ', 'g'))) >= 12 AS recurring FROM d")
def recurring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: dated editions of one series, and pairs that are not."""
    i = F.col("doc_id")
    bare = text.fingerprint(text.clean_title(F.substring_index("text", "\n", 1)))
    d = table(spark, sf_dir, "documents").select(i, bare.alias("fp"))
    second = F.when(i % 3 == 0, F.concat(F.lit("Report for Monday "), "fp")).otherwise(F.concat(F.lit("Report for Friday "), "fp"))
    pair = text.recurring_pair(F.concat(F.lit("Report for Monday "), "fp"), second)
    return d.select("doc_id", (pair & (F.col("fp") != "")).alias("recurring"))


@query(f"WITH {STORIES} SELECT id FROM stories WHERE lat BETWEEN 9.99999 AND 30.00001 AND lon BETWEEN -20.00001 AND 40.00001 AND lat IS NOT NULL")
def widened_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window widened a little; the world itself is no window, and a request without a time is not touched."""
    box = geo.BBox(10, 30, -20, 40, 5).widened()
    rows = stories(spark, sf_dir)
    whole = geo.BBox(-90, 90, -180, 180, 5)
    found = rows if whole.is_global() and not box.is_global() else rows.limit(0)
    return feed.feed(found, FeedQuery(0)).where(geo.within(F.col("lat"), F.col("lon"), box)).select("id")


REQUESTS = [
    (1, {"query": " quake ", "time_range": "1w", "limit": "5000"}, "guest"),
    (2, {"minLat": "1", "maxLat": "2"}, "pro"),
    (3, {"minLat": "-91", "maxLat": "2", "minLng": "0", "maxLng": "1"}, "pro"),
    (4, {"credibility": "1,4"}, "pro"),
    (5, {"sources": "news,x"}, "guest"),
    (6, {"time_range": "custom", "since": "2024-01-02T00:00:00Z", "until": "2024-01-01"}, "analyst"),
    (7, {"min_reports": "3"}, "free"),
    (8, {"time_range": "1w"}, "free"),
    (9, {"minLat": "1", "maxLat": "2", "minLng": "350", "maxLng": "355", "zoom": "7", "sort": "new"}, "free"),
    (10, {"min_reports": "1.5"}, "pro"),
    (11, {"time_range": "custom", "since": "2024-01-01T00:00:00Z"}, "analyst"),
    (12, {"zoom": "x"}, "pro"),
]


@query("SELECT * FROM (VALUES (1, 'search'), (2, 'invalid'), (3, 'invalid'), (4, 'invalid'), (5, 'filters'), (6, 'invalid'), (7, 'filters'), (8, 'range'), (9, 'ok'), (10, 'invalid'), (11, 'ok'), (12, 'invalid')) r(id, outcome)")
def judged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in text judged before anything is read: invalid, beyond a tier's rights, or fine."""

    def outcome(params: dict[str, str], tier: str) -> str:
        try:
            return feed.gate(feed.parse(params, NOW_MS), tier) or "ok"
        except ValueError:
            return "invalid"

    return spark.createDataFrame([(i, outcome(p, t)) for i, p, t in REQUESTS], "id int, outcome string")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://m.example/a.jpg' WHEN 1 THEN 'https://e.example/' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'https://h.example/x.png' END AS image FROM pages")
def feed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed item's picture by preference, icons and other files left out."""
    i = F.col("page_id")
    media = F.when(i % 4 == 0, F.array(F.lit("https://m.example/favicon.ico"), F.lit("https://m.example/a.jpg"))).otherwise(F.array(F.lit("ftp://m/x")))
    enclosure = F.when(i % 4 == 1, F.array(F.struct(F.lit("https://e.example/v").alias("url"), F.lit("video/mp4").alias("type")), F.struct(F.format_string("https://e.example/%d", i).alias("url"), F.lit("image/png").alias("type"))))
    html = F.when(i % 4 == 2, "<p><img alt='' src='https://h.example/icons/y.png'><img src=\"https://h.example/x.png\"></p>").otherwise("<p>none</p>")
    return table(spark, sf_dir, "pages").select("page_id", text.feed_image(media, enclosure, html).alias("image"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'one two' WHEN 1 THEN 'kept' WHEN 2 THEN 'x y' ELSE '' END AS description, CASE WHEN doc_id % 2 = 0 THEN 'Long words of ' || source ELSE 'Long words of ' || source || ' ----- at rainbet.com now' END AS message, CASE WHEN doc_id % 3 = 0 THEN 'a post that says enough ' || source END AS post FROM documents")
def feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions by snippet or markup, messages without advertisements, posts that say something."""
    i = F.col("doc_id")
    content = F.when(i % 4 == 0, "<style>p{}</style><p>one</p><p>two</p>").when(i % 4 == 1, "<p>other</p>").when(i % 4 == 2, "<div>x</div>y")
    snippet = F.when(i % 4 == 0, "p{} one two").when(i % 4 == 1, "kept")
    body = F.concat(F.lit("Long words of "), "source", F.lit(" ----- at rainbet.com now"))
    post = F.when(i % 3 == 0, F.concat(F.lit(" a post \n that says enough "), "source")).when(i % 3 == 1, "R to @somebody: read more https://x.example/1").otherwise("short")
    channel = F.when(i % 2 == 0, text.AD_SOURCE).otherwise("Other")
    return table(spark, sf_dir, "documents").select("doc_id", text.feed_description(content, snippet).alias("description"), text.channel_text(channel, body).alias("message"), text.meaningful_post(post).alias("post"))


@query("WITH t AS (SELECT user_id AS story, event_id % 3 * 2 AS priority, epoch_us(ts) // 1000 AS ms, CAST(event_id AS VARCHAR) AS url, CAST(1 + event_id % 3 AS INTEGER) AS tier FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY priority, ms DESC, url) AS k FROM t) SELECT story, url FROM b WHERE k = 1 ORDER BY priority, ms DESC, tier, story LIMIT 8")
def image_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target for each story, the eight most urgent of them."""
    i = F.col("event_id")
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("story"), (i % 3 * 2).alias("priority"), scores.epoch_ms(F.col("ts")).alias("published_ms"), i.cast("string").alias("url"), (1 + i % 3).cast("int").alias("tier"))
    return items.image_targets(t).select("story", "url")


APPLIED = f"""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'old' END AS image, o_orderkey % 100 * 3600000 AS ms FROM orders),
  f AS (SELECT l_orderkey AS id, max('u' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0')) AS url FROM lineitem GROUP BY 1)
  SELECT id, CASE WHEN url IS NOT NULL AND (image IS NULL OR 180000000 >= ms + 43200000) THEN url ELSE image END AS image_url FROM s LEFT JOIN f USING (id)"""


@query(APPLIED)
def applied_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures found for stories, taken by those that may."""
    o = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(o.alias("id"), F.when(o % 3 != 0, "old").alias("image_url"), (o % 100 * 3_600_000).alias("image_ms"), F.lit(None).cast("bigint").alias("image_updated_ms"), F.lit(0).cast("bigint").alias("published_ms"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.format_string("u%03d", "l_linenumber").alias("url"), F.lit(180_000_000).cast("bigint").alias("at_ms"))
    return items.apply_images(s, found, NOW_MS)[0].select("id", "image_url")


@query("WITH r AS (SELECT l_orderkey AS id, 'u' || CAST(l_linenumber AS VARCHAR) AS url, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_linenumber) AS k FROM lineitem WHERE l_linenumber > 1) SELECT id, CAST(k AS INTEGER) AS place, url FROM r WHERE k <= 2 UNION ALL SELECT o_orderkey, 0, 'u1' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def backfill_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to look for a story's picture: its own address and its newest two others."""
    one = F.struct(F.format_string("u%d", "l_linenumber").alias("url"), F.col("l_partkey").alias("at_ms"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).alias("sources"))
    return items.backfill_links(s.withColumn("url", F.lit("u1")))


@query(f"WITH {STORIES} SELECT CAST(floor(lat / 30) AS BIGINT) AS cell_y, CAST(floor(lon / 30) AS BIGINT) AS cell_x, CAST(sum(CASE WHEN tier = 2 THEN 1 ELSE volume END) AS BIGINT) AS story_count, bool_or(tier = 1) AS is_top_hot FROM stories WHERE lat IS NOT NULL GROUP BY 1, 2")
def cluster_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of rows that stand for several stories, far out in a window."""
    s = stories(spark, sf_dir).withColumns({"story_count": F.when(F.col("tier") != 2, F.col("volume")), "is_top_hot": F.when(F.col("tier") == 1, True)})
    asked = feed.clusters_apply(3.0, geo.BBox(-60, 60, -150, 150, 3)) and not feed.clusters_apply(7.0, geo.BBox(0, 1, 0, 1, 7))
    return feed.clusters(s if asked else s.limit(0), 3, 30.0).select("cell_y", "cell_x", "story_count", "is_top_hot")


@query("SELECT greatest(0, 1000 - count(*) FILTER (event_id % 3 = 0) - count(*) FILTER (event_id % 3 = 1 AND user_id % 2 = 0)) AS free FROM events")
def free_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that active and reserved ones leave."""
    return items.free_places(1000, table(spark, sf_dir, "events"), F.col("event_id") % 3 == 0, (F.col("event_id") % 3 != 2) & (F.col("user_id") % 2 == 0))


@query(f"WITH {STORIES} SELECT id, source FROM stories WHERE original_id = '000000000006' OR id = '000000000006' ORDER BY id = '000000000006' DESC, id LIMIT 1")
def story_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: one story by its id."""
    return feed.detail(stories(spark, sf_dir), "000000000006").select("id", "source")


@query("WITH a AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag = 'R' AS hot, l_linestatus AS s FROM lineitem WHERE l_orderkey % 2 = 0) SELECT id, max(n) AS n, bool_or(hot) AS hot, min(s) AS s FROM a GROUP BY id")
def visible_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came in merged into a store, the visible part of it."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("hot"), F.col("l_linestatus").alias("s"))
    visible = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    return items.merge_store(rows.where("n <= 2"), rows.where("n > 2"), "id", visible, ["n"], ["hot"], ["s"])


NEAR = """WITH v AS (SELECT vec_id, embedding, CASE WHEN vec_id % 10 < 3 THEN 'a report of subject number ' || CAST(vec_id % 40 AS VARCHAR) ELSE 'title ' || CAST(vec_id AS VARCHAR) END AS title FROM embeddings),
  i AS (SELECT * FROM v WHERE vec_id % 3 = 0), o AS (SELECT * FROM v WHERE vec_id % 3 <> 0),
  e AS (SELECT i.vec_id AS seq, min(o.vec_id) AS story, CAST(2 AS DOUBLE) AS score FROM i JOIN o ON i.title = o.title AND length(i.title) >= 24 GROUP BY 1),
  s AS (SELECT i.vec_id AS seq, o.vec_id AS story, round(list_dot_product(i.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS score FROM i CROSS JOIN o WHERE i.vec_id NOT IN (SELECT seq FROM e)),
  b AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, story) AS r FROM s WHERE score >= 0.6)"""


@query(NEAR + " SELECT seq, story, score FROM e UNION ALL SELECT seq, story, score FROM b WHERE r = 1")
def story_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored story of each report by equal title, else by the nearest vector at a shared place."""
    i = F.col("vec_id")
    title = F.when(i % 10 < 3, F.concat(F.lit("a report of subject number "), (i % 40).cast("string"))).otherwise(F.concat(F.lit("title "), i.cast("string")))
    v = table(spark, sf_dir, "embeddings").select(i.alias("id"), title.alias("title"), F.lit("").alias("description"), F.format_string("https://e.example/%d", i).alias("url"), F.lit(NOW_MS).alias("at_ms"), F.lit(NOW_MS).alias("published_ms"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit(True).alias("precise"), "embedding")
    st.checkpoint_dir(spark)
    e = st.evidence(v).checkpoint()
    return resolution.assignments(e.where("id % 3 = 0"), e.where("id % 3 <> 0"), NOW_MS)


@query("SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0 AND round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3")
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors that are near enough to those asked for, without an index."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return st.similar(v.where("id % 100 = 0"), v, 0.3)


@query()
def resolved_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports, resolved into stories; the fold depends on its own state, so tests hold it to
    plain Python."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        i.alias("seq"), text.clean_title(F.substring_index("text", "\n", 1)).alias("title"), text.clean_description(F.col("text")).alias("description"), F.format_string("https://s%d.example/%d", i % 50, i).alias("url"), "source", F.lit("rss").alias("source_type"),
        (1 + i % 3).cast("int").alias("tier"), (F.lit(NOW_MS) - i % 40 * HOUR_MS).alias("published_ms"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("string").alias("location_name"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("bigint").alias("image_ms"), F.lit(None).cast("bigint").alias("expires_ms"),
    )
    none = {c.split(": ")[0].split()[0]: F.expr(f"cast(null as {c.split(' ', 1)[1]})") for c in resolution.STORED.split(", ", 5)[:5]}
    stored = d.where("seq % 4 = 0").withColumnRenamed("seq", "id").withColumns(none).withColumn("sources", F.expr(f"cast(array() as {resolution.STORED.split(' sources ')[-1].split('sources ')[-1]})"))
    made = resolution.resolve_stories(d.where("seq % 4 <> 0"), stored, geocode.seed(spark), NOW_MS)
    return made.select("id", "first_seq", "title", "tier", "published_ms", "event_count", "independent", "impact")

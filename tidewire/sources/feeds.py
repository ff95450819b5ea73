"""Feeds as tables: XML, JSON, CSV, GeoJSON, TSV and pages with messages, read from landed files by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scores, text

# Fixed values
MESSAGE_LEAST, MESSAGE_MOST = 10, 500
POST_LEAST, POST_AGE_MS, POSTS = 20, 72 * scores.HOUR_MS, 10
FIRE_POWER = 10.0
IMPORT_FEATURES, IMPORT_POINTS = 1000, 50_000


def rss(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """(source, seq, title, url, description, published): the items of RSS files, or Atom with ``row_tag='entry'``.

    ``source`` is the file, and ``seq`` an item's place in it: by where its block of the file begins, then by its row
    there, so it follows the file however the read is partitioned.
    """
    schema = "title string, link string, description string, summary string, pubDate string, published string, updated string, guid string"
    raw = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    raw = raw.withColumns({"source": F.input_file_name(), "_block": F.input_file_block_start(), "_row": F.monotonically_increasing_id()})
    seq = F.row_number().over(Window.partitionBy("source").orderBy("_block", "_row"))
    return raw.select("source", seq.cast("bigint").alias("seq"), text.clean_title(text.html_text(F.col("title"))).alias("title"), text.canonical_url(F.coalesce("link", "guid")).alias("url"), text.html_text(F.coalesce("description", "summary")).alias("description"), F.coalesce("pubDate", "published", "updated").alias("published"))


def news_json(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, description, image, source, published) of files with an ``articles`` array."""
    schema = "articles array<struct<title: string, description: string, url: string, image: string, publishedAt: string, source: struct<name: string, url: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("articles").alias("a"))
    return rows.select("a.title", text.canonical_url(F.col("a.url")).alias("url"), "a.description", "a.image", F.col("a.source.name").alias("source"), F.col("a.publishedAt").alias("published"))


def messages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns.., seq, text, url, posted, links, image): the messages of channel pages, ten characters at least and 500 at most.

    ``links`` are all addresses in a message but those that only open the messenger (tg:), ``url`` the first on the web,
    and ``image`` is the picture or preview that stands behind it, if that is on the web.
    """
    every = F.split(F.col(html), r"(?i)<div[^>]+class=\"[^\"]*\bmessage\b[^\"]*\"[^>]*>")
    blocks = F.slice(every, F.lit(2), F.size(every))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(blocks).alias("seq", "_m"))
    body = F.substring(text.html_text(F.col("_m")), 1, MESSAGE_MOST)
    link = F.regexp_extract("_m", r"(?i)href=\"(https?://[^\"]+)\"", 1)
    links = F.filter(F.regexp_extract_all("_m", F.lit(r"(?i)href=\"([^\"]+)\""), F.lit(1)), lambda x: ~F.lower(x).startswith("tg:"))
    image = F.regexp_extract("_m", r"(?i)background-image:\s*url\(\s*(?:&quot;|['\"])?(https?://[^'\")&\s]+)", 1)
    return rows.withColumns({"links": links, "image": F.nullif(image, F.lit("")), "text": body, "url": F.nullif(link, F.lit("")), "posted": F.nullif(F.regexp_extract("_m", r"datetime=\"([^\"]+)\"", 1), F.lit(""))}).where(F.length("text") >= MESSAGE_LEAST).drop("_m")


def timeline_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns.., status_id, text, created_at) from the JSON that a timeline page carries."""
    island = F.regexp_extract(html, r"(?is)<script[^>]+type=\"application/json\"[^>]*>(.*?)</script>", 1)
    kind = "struct<entries: array<struct<id: string, text: string, created_at: string>>>"
    rows = pages.withColumn("_e", F.explode(F.from_json(island, kind)["entries"]))
    return rows.select(*[c for c in pages.columns if c != html], F.col("_e.id").alias("status_id"), F.col("_e.text").alias("text"), F.col("_e.created_at").alias("created_at"))


def newest(items: DataFrame, key: str, now_ms: int, age_ms: int, limit: int) -> DataFrame:
    """The newest items (key, published_ms, url) of each feed that are neither too old nor over five minutes ahead."""
    fits = items.where(F.col("published_ms").between(now_ms - age_ms, now_ms + scores.FUTURE_SKEW_MS))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("published_ms").desc(), "url"))
    return fits.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def normalise_posts(posts: DataFrame, now_ms: int) -> DataFrame:
    """The newest ten posts of each account (account, status_id, text, at_ms): dated, fresh, long enough, once each."""
    fits = posts.where((F.col("at_ms") > 0) & F.col("at_ms").between(now_ms - POST_AGE_MS, now_ms + scores.FUTURE_SKEW_MS) & (F.length("text") >= POST_LEAST))
    once = fits.dropDuplicates(["account", "status_id"])
    rank = F.row_number().over(Window.partitionBy("account").orderBy(F.col("at_ms").desc(), "status_id"))
    return once.withColumn("_r", rank).where(F.col("_r") <= POSTS).drop("_r")


def first_non_empty(*parts: DataFrame) -> DataFrame:
    """For each source the rows of the first part that has any (source, ..): strategies by falling preference."""
    ranked = parts[0].withColumn("_p", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        ranked = ranked.unionByName(part.withColumn("_p", F.lit(i)), allowMissingColumns=True)
    best = ranked.groupBy("source").agg(F.min("_p").alias("_p"))
    return ranked.join(best, ["source", "_p"]).drop("_p")


def fires(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(lat, lon, power, confidence, acquired) of fire detections in CSV: 13 columns, none of low confidence or power."""
    names = ["latitude", "longitude", "bright", "scan", "track", "acq_date", "acq_time", "satellite", "confidence", "version", "bright2", "frp", "daynight"]
    rows = spark.read.option("header", header).schema(", ".join(f"{n} string" for n in names)).csv(path)
    power = F.coalesce(F.expr("try_cast(frp as double)"), F.lit(0.0))
    out = rows.select(F.expr("try_cast(latitude as double)").alias("lat"), F.expr("try_cast(longitude as double)").alias("lon"), power.alias("power"), F.lower("confidence").alias("confidence"), F.concat_ws(" ", "acq_date", "acq_time").alias("acquired"), "daynight")
    return out.where(geo.usable(F.col("lat"), F.col("lon")) & (F.col("confidence") != "low") & (F.col("power") >= FIRE_POWER) & F.col("daynight").isNotNull()).drop("daynight")


def natural_events(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, category, lon, lat) of GeoJSON features; the first category's id, else unknown."""
    kind = "features array<struct<id: string, geometry: struct<coordinates: array<double>>, properties: struct<id: string, title: string, categories: array<struct<id: string>>>>>"
    f = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.coalesce("f.properties.id", "f.id").alias("id"), F.col("f.properties.title").alias("title"), F.coalesce(F.get("f.properties.categories", F.lit(0))["id"], F.lit("unknown")).alias("category"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def flights(rows: DataFrame) -> DataFrame:
    """(label, lat, lon, track, altitude, speed, cell) of aircraft with coordinates: flight, registration or UNKNOWN."""
    label = F.coalesce(F.nullif(F.trim("flight"), F.lit("")), F.nullif(F.trim("registration"), F.lit("")), F.lit("UNKNOWN"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    cell = F.format_string("%.2f,%.2f", "lat", "lon")
    return rows.where(geo.usable(F.col("lat"), F.col("lon"))).select(label.alias("label"), "lat", "lon", zero("track"), zero("altitude"), zero("speed"), cell.alias("cell"))


def imported_rings(geojson: Column) -> Column:
    """The outer rings of a GeoJSON text's polygons, array<array<struct<lon, lat>>>; null if it can't be read."""
    kind = "struct<features: array<struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>>>>"
    polygons = F.filter(F.from_json(geojson, kind)["features"], lambda f: f["geometry"]["type"] == "Polygon")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    return F.transform(polygons, lambda f: F.transform(F.get(f["geometry"]["coordinates"], F.lit(0)), point))


def valid_import(features: Column) -> Column:
    """Whether imported rings, array<array<struct<lon, lat>>>, are few and short enough, in range, and closed."""
    in_range = lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90)
    closed = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, in_range)
    points = F.aggregate(features, F.lit(0), lambda n, r: n + F.size(r))
    return F.coalesce((F.size(features) <= IMPORT_FEATURES) & (points <= IMPORT_POINTS) & F.forall(features, closed), F.lit(False))


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """Cities of a GeoNames dump: (id, name, ascii_name, alternates, lat, lon, country, region, population)."""
    n = spark.read.option("sep", "\t").option("quote", "\u0000").csv(path)
    c = lambda i: F.col(f"_c{i}")
    return n.select(c(0).cast("bigint").alias("id"), c(1).alias("name"), c(2).alias("ascii_name"), F.array_remove(F.split(F.coalesce(c(3), F.lit("")), ","), "").alias("alternates"), c(4).cast("double").alias("lat"), c(5).cast("double").alias("lon"), c(8).alias("country"), c(10).alias("region"), F.coalesce(c(14).cast("bigint"), F.lit(0)).alias("population"))


def recent(stories: DataFrame, since_ms: int, with_vector: bool = False) -> DataFrame:
    """Stories published since a time, optionally those with a vector: a plain filter, which the scan takes."""
    rows = stories.where(F.col("published_ms") >= since_ms)
    return rows.where("embedding is not null") if with_vector else rows


def attempts(fetches: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """(source, items, latest_ms, outcome): one telemetry row for each source of fetched items."""
    rows = fetches.groupBy("source").agg(F.count("published_ms").alias("items"), F.max("published_ms").alias("latest_ms"))
    return rows.withColumn("outcome", scores.freshness(F.col("latest_ms"), F.col("items"), F.lit(now_ms), F.lit(max_age_ms)))

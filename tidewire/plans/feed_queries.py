"""Feed queries: filters, ranking, clusters, flags and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import feed, items
from ..operators.feed import FeedQuery
from .base import HOUR_MS, NOW_MS, STORIES, query, stories, table

SHOWN = ["canonical_id", "id", "impact", "latest_ms", "tier"]
HOT = "impact DESC, latest_ms DESC, canonical_id ASC"
NEW = "latest_ms DESC, canonical_id ASC"


def feed_sql(where: str, order: str = HOT, limit: int = 50) -> str:
    return f"""WITH {STORIES}, kept AS (SELECT * FROM stories WHERE lat IS NOT NULL AND lon IS NOT NULL AND {where}),
      best AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY {order}, id) AS r FROM kept)
      SELECT canonical_id, id, impact, latest_ms, tier FROM best WHERE r = 1 ORDER BY {order} LIMIT {limit}"""


def run(spark: SparkSession, sf_dir: str, **asked) -> DataFrame:
    return feed.feed(stories(spark, sf_dir), FeedQuery(NOW_MS, limit=50, **asked)).select(*SHOWN)


@query(feed_sql("true"))
def feed_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty hottest stories."""
    return run(spark, sf_dir)


@query(feed_sql("true", NEW))
def feed_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest stories."""
    return run(spark, sf_dir, sort="new")


@query(feed_sql("lat BETWEEN -40 AND 60 AND (lon >= 150 OR lon <= -120) AND tier IN (1, 2)"))
def feed_bbox_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hot feed in a window over the antimeridian."""
    return run(spark, sf_dir, bbox=geo.BBox(-40, 60, 150, 240, 5), tiers=(1, 2))


@query(feed_sql("lat BETWEEN -30 AND 50"))
def feed_bbox_low_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """below zoom 3 a window bounds the latitude alone."""
    return run(spark, sf_dir, bbox=geo.BBox(-30, 50, 0, 10, 2))


@query(feed_sql("lat BETWEEN 40 AND 60 AND lon BETWEEN -10 AND 20"))
def feed_bbox_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a window snapped outwards to the ten-degree grid of zoom 5."""
    return run(spark, sf_dir, bbox=geo.BBox(43, 57.5, -8, 11, 5.2).snapped())


@query(feed_sql("(contains(lower(title), 'error report') OR contains(lower(description), 'error report') OR contains(lower(location_name), 'error report'))"))
def feed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: stories whose title, description or place holds a text."""
    return run(spark, sf_dir, search="Error REPORT")


@query(feed_sql("coalesce(category, 'general') IN ('error', 'general')"))
def feed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chosen categories; none is general."""
    return run(spark, sf_dir, categories=("error", "general"))


@query(feed_sql("(source_type = 'rss' OR (source_type = 'social' AND (contains(lower(source), '(x)') OR contains(lower(source), 'twitter') OR contains(lower(source), 'telegram'))))"))
def feed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feeds and two social platforms."""
    return run(spark, sf_dir, sources=("news", "x", "telegram"))


@query(feed_sql(f"{NOW_MS} - latest_ms <= 3 * 86400000", NEW))
def feed_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last three days."""
    return run(spark, sf_dir, time_range="3d", sort="new")


@query(feed_sql(f"latest_ms >= {NOW_MS - 20 * 24 * HOUR_MS} AND latest_ms <= {NOW_MS - 10 * 24 * HOUR_MS}"))
def feed_custom_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a range of one's own, both ends included."""
    return run(spark, sf_dir, time_range="custom", since_ms=NOW_MS - 20 * 24 * HOUR_MS, until_ms=NOW_MS - 10 * 24 * HOUR_MS)


@query(feed_sql("volume >= 4 AND tier IN (2, 3)"))
def feed_volume_and_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large stories of the lower tiers."""
    return run(spark, sf_dir, min_volume=4, tiers=(2, 3))


@query(feed_sql("(volume >= 6 AND category = 'error' OR id = '000000000005')", HOT, 5000))
def feed_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a shared story stays in view though the filters would drop it."""
    return feed.feed(stories(spark, sf_dir), FeedQuery(NOW_MS, limit=5000, min_volume=6, categories=("error",), pinned="000000000005")).select(*SHOWN)


@query(f"""WITH {STORIES}, kept AS (SELECT * FROM stories WHERE lat IS NOT NULL AND tier = 1), best AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY {HOT}, id) AS r FROM kept)
  SELECT canonical_id, CAST(row_number() OVER (ORDER BY {HOT}) AS BIGINT) AS place, (SELECT count(*) FROM best WHERE r = 1) > 25 AS is_capped FROM best WHERE r = 1 ORDER BY {HOT} LIMIT 25""")
def feed_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limited feed and whether there was more."""
    rows = feed.feed(stories(spark, sf_dir), FeedQuery(NOW_MS, tiers=(1,)))
    return feed.with_cap(rows, "hot", 25).select("canonical_id", F.col("place").cast("bigint").alias("place"), "is_capped")


@query(f"""WITH {STORIES}, c AS (SELECT CAST(floor(lat / 20) AS BIGINT) AS cell_y, CAST(floor(lon / 20) AS BIGINT) AS cell_x, * FROM stories WHERE lat IS NOT NULL)
  SELECT cell_y, cell_x, count(*) AS story_count, round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon, max(impact) AS max_impact,
  first(id ORDER BY impact DESC, latest_ms DESC, id DESC) AS top_id FROM c GROUP BY 1, 2""")
def cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories in cells of twenty degrees."""
    c = feed.clusters(stories(spark, sf_dir), 4, 20.0)
    return c.select("cell_y", "cell_x", "story_count", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"), "max_impact", "top_id")


@query(f"""WITH {STORIES}, c AS (SELECT count(*) AS n, avg(lat) AS y, avg(lon) AS x FROM stories WHERE lat IS NOT NULL GROUP BY floor(lat / 45), floor(lon / 45))
  SELECT printf('cluster-z3-%.4f-%.4f-%d', y, x, n) AS cluster_id FROM c""")
def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster ids of zoom, centre and count."""
    return feed.clusters(stories(spark, sf_dir), 3, 45.0).select("cluster_id")


@query(f"""WITH {STORIES}, best AS (SELECT canonical_id, impact, latest_ms, row_number() OVER (PARTITION BY canonical_id ORDER BY {HOT}, id) AS r FROM stories),
  top AS (SELECT canonical_id FROM best WHERE r = 1 ORDER BY {HOT} LIMIT 3) SELECT id, canonical_id IN (SELECT canonical_id FROM top) AS is_top_hot FROM stories""")
def hot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the three hottest stories are flagged."""
    return feed.hot_flags(stories(spark, sf_dir)).select("id", "is_top_hot")


@query(f"""WITH {STORIES}, o AS (SELECT id, row_number() OVER (ORDER BY latest_ms DESC, id) AS place FROM stories)
  SELECT id, CAST(least(place, 10) AS BIGINT) AS place FROM o WHERE place < 10 OR id = '000000000003'""")
def pinned_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows, the last place given to a pinned one beyond them."""
    rows = feed.pinned_limit(stories(spark, sf_dir), [F.col("latest_ms").desc(), F.col("id")], 10, "000000000003")
    return rows.select("id", F.col("place").cast("bigint").alias("place"))


def _spiral(sign: str) -> str:
    return f"""WITH {STORIES}, s AS (SELECT id, lat, lon, CAST(row_number() OVER (PARTITION BY floor(lat * 1e5 + 0.5), floor(lon * 1e5 + 0.5) ORDER BY id) - 1 AS DOUBLE) AS i FROM stories WHERE lat IS NOT NULL),
      m AS (SELECT *, least(6.0, sqrt(i) * 0.9 * 1.2) AS rad, radians(i * 137.5) AS a FROM s),
      p AS (SELECT *, CASE WHEN i > 0 THEN least(85.0, greatest(-85.0, lat + rad * cos(a) / 111.32)) ELSE lat END AS y, lon + rad * sin(a) / (111.32 * greatest(0.2, cos(radians(lat)))) AS x FROM m)
      SELECT id, round(y, 6) AS map_lat, round(CASE WHEN i > 0 THEN (x + 180) - 360 * floor((x + 180) / 360) - 180 ELSE lon END, 6) AS map_lon FROM p{sign}"""


@query(_spiral(""))
def spread_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories on one spot laid out on a spiral."""
    return feed.spread_overlaps(stories(spark, sf_dir).where("lat is not null")).select("id", F.round("map_lat", 6).alias("map_lat"), F.round("map_lon", 6).alias("map_lon"))


@query(f"""WITH {STORIES} SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']}},"properties":{{"id":"' || id || '","canonicalId":"' || canonical_id || '","category":"' || coalesce(category, 'general')
  || '","storyCount":' || CAST(volume AS VARCHAR) || ',"isTopHot":false}}}}' AS feature FROM stories WHERE lat IS NOT NULL""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories as GeoJSON features."""
    return feed.geojson(stories(spark, sf_dir).where("lat is not null").withColumns({"story_count": F.col("volume"), "is_top_hot": F.lit(None).cast("boolean")}))


@query(f"WITH {STORIES} SELECT CAST(sum(CASE WHEN volume = 1 THEN 1 ELSE volume END) AS BIGINT) AS stories, max(latest_ms) AS newest_ms FROM stories")
def headline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories in all and the newest activity."""
    return feed.headline_stats(stories(spark, sf_dir).withColumn("story_count", F.nullif("volume", F.lit(1))))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id, turn, n > 3 AS is_restricted FROM r WHERE turn = 0 OR r <= 2""")
def timeline_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first report and the newest two others of each story."""
    rows = table(spark, sf_dir, "conversations").withColumn("is_primary", F.col("turn") == 0)
    return feed.timeline(rows, "conv_id", F.col("turn"), 3).select("conv_id", "turn", "is_restricted")


@query(f"""WITH {STORIES} SELECT coalesce(category, 'general') AS category, source_type, count(*) AS n, CAST(sum(CASE WHEN tier = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first_tier, greatest(0, count(*) - 40) AS hidden
  FROM stories GROUP BY 1, 2""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts by category."""
    rows = stories(spark, sf_dir).groupBy(F.coalesce("category", F.lit("general")).alias("category"), "source_type")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("tier") == 1).alias("first_tier")).withColumn("hidden", F.greatest(F.lit(0), F.col("n") - 40))


@query(f"""WITH {STORIES}, o AS (SELECT *, row_number() OVER (ORDER BY id = '000000000009' DESC, latest_ms DESC, id) AS place FROM stories) SELECT id, CAST(place AS BIGINT) AS place FROM o ORDER BY place LIMIT 20""")
def selected_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected story first, the others in order."""
    rows = stories(spark, sf_dir).select("id", "latest_ms")
    return items.selected_first(rows, "000000000009", F.col("latest_ms").desc(), F.col("id"), limit=20).select("id", "place")


@query(f"""WITH {STORIES} SELECT id, round(lon * 111319.49079327358, 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 3) AS y FROM stories WHERE lat IS NOT NULL""")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories in Web Mercator metres."""
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    return stories(spark, sf_dir).where("lat is not null").select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {STORIES} SELECT id, CASE WHEN lat IS NULL THEN false ELSE lat > -20.5 AND lat < 40.5 AND lon > -30.5 AND lon < 69.5 END AS inside FROM stories""")
def polygon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a drawn ring, by ray casting (here a rectangle, which SQL can check)."""
    ring = F.array(*[F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in ((-20.5, -30.5), (-20.5, 69.5), (40.5, 69.5), (40.5, -30.5))])
    inside = geo.in_polygon(F.col("lat"), F.col("lon"), ring)
    return stories(spark, sf_dir).select("id", F.when(F.col("lat").isNull(), False).otherwise(inside).alias("inside"))

"""Items and stories: from one form to the other, their source lists, and views of stored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scores, text
from .shared import sized
from .stories import image_wins

# Fixed values
IMAGE_TARGETS, STORE_ROWS, OTHER_LINKS = 8, 5000, 2
LATENCY_BANDS = [(15_000, "over 15 s"), (10_000, "over 10 s"), (5_000, "over 5 s")]
SOURCES = "array<struct<name: string, url: string, source_type: string, at_ms: bigint>>"


def first_of(items: Column, key: Callable[[Column], Column]) -> Column:
    """The elements of an array of which no earlier one has the same key; null keys are one key."""
    pairs = F.transform(items, lambda x: F.struct(F.coalesce(key(x), F.lit("")).alias("k"), x.alias("v")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.slice(items, 1, 0).alias("kept"))
    more = lambda s, p: F.struct(F.concat(s["seen"], F.array(p["k"])).alias("seen"), F.concat(s["kept"], F.array(p["v"])).alias("kept"))
    return F.aggregate(pairs, start, lambda s, p: F.when(F.array_contains(s["seen"], p["k"]), s).otherwise(more(s, p)), lambda s: s["kept"])


def corroborators(primary_url: Column, sources: Column) -> Column:
    """A story's sources once for each report identity, the first of each, without the primary report."""
    keyed = F.transform(sources, lambda x: F.struct(text.report_identity(x["url"], listed=True).alias("k"), x.alias("v")))
    others = lambda own: F.filter(first_of(keyed, lambda x: x["k"]), lambda x: ~x["k"].eqNullSafe(own))
    return F.transform(text.bound(text.report_identity(primary_url), others), lambda x: x["v"])


def timeline_sources(primary: Column, sources: Column) -> Column:
    """The primary report and a story's sources, once for each address, oldest first."""
    every = first_of(F.concat(F.array(primary), sources), lambda x: x["url"])
    return F.array_sort(every, lambda a, b: (F.coalesce(a["at_ms"], F.lit(0)) - F.coalesce(b["at_ms"], F.lit(0))).cast("int"))


def normal_sources(url: Column, sources: Column) -> tuple[Column, Column]:
    """(sources, at_ms): canonical addresses once each, without the story's own, and the first time of that one, if any."""
    clean = F.filter(F.transform(F.coalesce(sources, F.array().cast(SOURCES)), lambda x: x.withField("url", text.canonical_url(x["url"], listed=True))), lambda x: x["url"] != "")
    # the own address and the clean list are each found once
    told = F.struct(text.canonical_url(url).alias("own"), clean.alias("l"))
    both = text.bound(told, lambda t: F.struct(first_of(F.filter(t["l"], lambda x: x["url"] != t["own"]), lambda x: x["url"]).alias("rest"), F.get(F.filter(t["l"], lambda x: x["url"] == t["own"]), F.lit(0))["at_ms"].alias("at")))
    return both["rest"], both["at"]


def to_stories(items: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """New stories of items (title, description, url, source, source_type, category, published, lat, lon, location_name,
    image_url, image_source_url, image_published, image_origin).

    Items without an http(s) address, a title or usable coordinates go.  Tiers come from ``registry`` (name,
    credibility_tier), 3 where it has none; fields of a picture are null without one; items that say little expire.
    """
    title, url = text.html_text(text.clean_title(F.col("title"))), text.canonical_url(F.col("url"))
    kept = items.withColumns({"title": title, "url": url}).where("title <> '' and url <> ''").where(geo.usable(F.col("lat"), F.col("lon")))
    tiers = registry.select(F.col("name").alias("source"), F.col("credibility_tier").alias("_tier")).dropDuplicates(["source"])
    rows = kept.join(sized(tiers), "source", "left").withColumns({"tier": F.coalesce("_tier", F.lit(3)), "published_at": scores.safe_time(F.col("published"), now)})
    lasting = text.low_signal(F.col("title"), F.col("description"), F.col("source_type"), F.col("tier"))
    pictured = lambda c: F.when(F.coalesce("image_url", F.lit("")) != "", c)
    return rows.select(
        "title",
        text.html_text(F.col("description")).alias("description"),
        "url", "source", "source_type", "category",
        pictured(F.col("image_url")).alias("image_url"),
        pictured(F.coalesce("image_source_url", "url")).alias("image_source_url"),
        pictured(scores.safe_time(F.coalesce("image_published", "published"), now)).alias("image_source_published_at"),
        pictured(F.coalesce("image_origin", F.lit("feed"))).alias("image_origin"),
        pictured(now).alias("image_updated_at"),
        "published_at",
        F.col("published_at").alias("primary_discovered_at"),
        "lat", "lon",
        F.nullif(text.html_text(F.col("location_name")), F.lit("")).alias("location_name"),
        F.col("tier").alias("credibility_tier"),
        F.lit(1).cast("bigint").alias("event_count"),
        scores.impact(F.col("tier"), F.lit(1)).alias("impact_score"),
        F.array().cast(SOURCES).alias("sources"),
        F.when(lasting, F.col("published_at") + F.make_dt_interval(F.lit(text.LOW_SIGNAL_DAYS))).alias("expires_at"),
    )


def to_items(stories: DataFrame) -> DataFrame:
    """Stories as readers get them: a cluster's centre before its own coordinates, and names of the feed's interface."""
    has = lambda c, kind="string": F.col(c) if c in stories.columns else F.lit(None).cast(kind)
    return stories.select(
        F.coalesce(has("id").cast("string"), "url").alias("id"),
        "title", has("description").alias("description"), "url", "source",
        has("source_type").alias("sourceType"), has("category").alias("category"), has("published_at", "timestamp").alias("publishedAt"),
        has("primary_discovered_at", "timestamp").alias("headlinePublishedAt"), has("image_url").alias("imageUrl"),
        F.coalesce(has("center_lat", "double"), "lat").alias("latitude"), F.coalesce(has("center_lng", "double"), "lon").alias("longitude"),
        has("location_name").alias("locationName"), has("cluster_id").alias("clusterId"), has("story_count", "bigint").alias("storyCount"),
        F.coalesce(has("event_count", "bigint"), has("source_count", "bigint")).alias("sourcesCount"),
        has("is_top_hot", "boolean").alias("isTopHot"), has("impact_score", "double").alias("impactScore"), has("credibility_tier", "int").alias("credibilityTier"),
    )


def latest_active(rows: DataFrame, key: str, active: Column, *newest: str) -> DataFrame:
    """Of each key the newest row that is active."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in newest])
    return rows.where(active).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merged_entities(rows: DataFrame, key: str, largest: list[str], flags: list[str], first: list[str]) -> DataFrame:
    """One row of each key: the largest of some fields, whether any flag is set, and what is there of the others."""
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in largest], *[F.bool_or(c).alias(c) for c in flags], *[F.min(c).alias(c) for c in first])


def merge_store(store: DataFrame, incoming: DataFrame, key: str, visible: DataFrame, largest: list[str], flags: list[str], first: list[str]) -> DataFrame:
    """The rows of a store and of what came in, merged by key, that a reader's visible set (key) has."""
    both = store.unionByName(incoming, allowMissingColumns=True)
    return merged_entities(both, key, largest, flags, first).join(visible.select(key).distinct(), key, "left_semi")


def pruned(store: DataFrame, protected: Column, touched: str, rows: int = STORE_ROWS) -> DataFrame:
    """The rows that a store of bounded size keeps: protected ones first, then those touched last."""
    return store.orderBy(protected.desc(), F.col(touched).desc(), "id").limit(rows)


def selected_first(rows: DataFrame, selected: str, *order: Column, limit: int) -> DataFrame:
    """The selected row, then the others in order, with their place; as many as ``limit`` (one task numbers those)."""
    by = [(F.col("id") == selected).desc(), *order]
    return rows.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("bigint"))


def pick(rows: DataFrame, seen: DataFrame, key: str, seed: str = "") -> DataFrame:
    """One row of those whose key was not seen yet, by a hash of key and seed, so that a pick can be repeated."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return rows.join(seen.select(key).distinct(), key, "left_anti").orderBy(draw, key).limit(1)


def latency_bands(rows: DataFrame, ms: Column, bands: list[tuple[int, str]] = LATENCY_BANDS) -> DataFrame:
    """``band``: by how much a latency is too long."""
    out = F.lit("fine")
    for least, name in reversed(bands):
        out = F.when(ms > least, name).otherwise(out)
    return rows.withColumn("band", out)


def incidents(rows: DataFrame, key: Column, ms: Column, severity: Column) -> DataFrame:
    """(dedup_key, times, first_ms, last_ms, worst): incidents counted by key."""
    return rows.groupBy(key.alias("dedup_key")).agg(F.count("*").alias("times"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), F.max(severity).alias("worst"))


def coverage(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """Rows that one of two sets lacks, as missing or extra; none where they cover each other."""
    return wanted.exceptAll(got).withColumn("side", F.lit("missing")).union(got.exceptAll(wanted).withColumn("side", F.lit("extra")))


def free_places(total: int, holders: DataFrame, active: Column, reserved: Column) -> DataFrame:
    """How many of so many places are left by those that are active or reserved, none at least."""
    return holders.agg(F.greatest(F.lit(0), F.lit(total) - F.count_if(active) - F.count_if(reserved & ~active)).cast("bigint").alias("free"))


def hidden_sources(total: Column, shown: Column) -> Column:
    """How many sources a restricted list does not show."""
    return F.greatest(F.lit(0), total - shown)


def image_targets(targets: DataFrame, rows: int = IMAGE_TARGETS) -> DataFrame:
    """The targets (story, url, priority, published_ms, tier) to look at in this run: one a story, the most urgent of all."""
    best = Window.partitionBy("story").orderBy("priority", F.col("published_ms").desc(), "url")
    one = targets.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return one.orderBy("priority", F.col("published_ms").desc(), "tier", "story").limit(rows)


def apply_images(stories: DataFrame, found: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """``stories`` (id, image_url, image_ms, image_updated_ms, published_ms, ..) with the pictures (id, url, at_ms) found
    for them that they may take, one each, the newest; and how many were found, and taken."""
    newest = found.where("url is not null").groupBy("id").agg(F.max_by("url", F.struct("at_ms", "url")).alias("_url"), F.max("at_ms").alias("_at"))
    rows = stories.join(newest, "id", "left")
    old = F.coalesce("image_ms", "published_ms", F.lit(0))
    takes = F.col("_url").isNotNull() & image_wins(F.trim(F.coalesce("image_url", F.lit(""))) == "", old, F.coalesce("image_updated_ms", old), F.col("_at"), F.lit(now_ms))
    rows = rows.withColumn("_takes", takes)
    new = {"image_url": F.col("_url"), "image_ms": F.col("_at"), "image_updated_ms": F.lit(now_ms)}
    kept = rows.select(*[F.when(F.col("_takes"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stories.columns])
    stats = rows.agg(F.count_if(F.col("_url").isNotNull()).alias("found"), F.count_if("_takes").alias("taken"))
    return kept, stats


def backfill_links(stories: DataFrame, others: int = OTHER_LINKS) -> DataFrame:
    """(id, place, url): where to look for a story's picture: its own address, then its newest other sources."""
    newest = F.array_sort(F.filter("sources", lambda x: x["url"] != F.col("url")), lambda a, b: F.coalesce(F.nullif(F.signum(b["at_ms"] - a["at_ms"]).cast("int"), F.lit(0)), F.when(a["url"] < b["url"], -1).otherwise(1)))
    links = F.concat(F.array("url"), F.transform(F.slice(newest, 1, others), lambda x: x["url"]))
    return stories.select("id", F.posexplode(links).alias("place", "url"))


def details(candidates: DataFrame, stories: DataFrame, key: str, count: str) -> DataFrame:
    """The stories that candidates name, a missing or zero count as one."""
    return stories.join(candidates.select(key).distinct(), key, "left_semi").withColumn(count, F.coalesce(F.nullif(F.col(count), F.lit(0)), F.lit(1)))


def display_ms(sources: Column, activity: Column, published: Column) -> Column:
    """When a story was last told of: its newest source, else its activity, else its publication."""
    return F.coalesce(F.array_max(F.transform(sources, lambda x: x["at_ms"])), activity, published)


def position_text(altitude: Column, speed: Column) -> tuple[Column, Column]:
    """An orbiting station's altitude with one decimal and its speed with none, halves up."""
    return F.format_string("%.1f", F.floor(altitude * 10 + 0.5) / 10), F.format_string("%d", F.floor(speed + 0.5).cast("bigint"))

"""The feed query: filters, canonical deduplication, ranking, limits, clusters and map features."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scores

DAY_MS = 86_400_000
# Ranges, row limits by tier and by zoom, and what each tier may ask for.
RANGE_MS = {"1d": DAY_MS, "3d": 3 * DAY_MS, "1w": 7 * DAY_MS, "1m": 30 * DAY_MS}
TIER_ROWS = {"guest": 10, "free": 50, "paid": 1000}
ALL_SOURCES = ("news", "extra", "reddit", "x", "telegram")
TIER_RIGHTS = {
    "guest": {"ranges": ("1d",), "features": ()},
    "free": {"ranges": ("1d",), "features": ("filters", "search")},
    "pro": {"ranges": ("1d", "3d", "1w", "1m"), "features": ("filters", "search", "advanced")},
    "analyst": {"ranges": ("1d", "3d", "1w", "1m", "custom"), "features": ("filters", "search", "advanced")},
}
ZOOM_ROWS = [(6.5, 250), (4.0, 500)]
MAX_ROWS = 1000
MAX_QUERY_CHARS = 160


@dataclass(frozen=True)
class FeedQuery:
    """What a reader asks for; ``now_ms`` is the time of the request."""

    now_ms: int
    bbox: geo.BBox | None = None
    sources: tuple[str, ...] = ALL_SOURCES
    categories: tuple[str, ...] = ()
    time_range: str = "all"
    since_ms: int | None = None
    until_ms: int | None = None
    search: str = ""
    min_volume: int = 1
    tiers: tuple[int, ...] = ()
    sort: str = "hot"
    limit: int | None = None
    pinned: str | None = None
    cluster: bool = False

    def validated(self) -> FeedQuery:
        """The query itself, or a ValueError that says what is wrong with it."""
        if self.bbox and not (-90 <= self.bbox.min_lat <= self.bbox.max_lat <= 90 and all(-360 <= x <= 360 for x in (self.bbox.min_lon, self.bbox.max_lon))):
            raise ValueError("the window is out of range")
        if self.since_ms is not None and self.until_ms is not None and self.until_ms < self.since_ms:
            raise ValueError("until is before since")
        if len(self.search) > MAX_QUERY_CHARS:
            raise ValueError(f"a search has at most {MAX_QUERY_CHARS} characters")
        if any(t not in (1, 2, 3) for t in self.tiers) or not 1 <= self.min_volume <= 100_000:
            raise ValueError("tiers are 1 to 3 and volumes 1 to 100000")
        return self


def effective_limit(requested: int | None, tier: str, zoom: float | None, searching: bool, history_ms: int | None = None) -> int:
    """The rows a request gets: its own limit within the tier's and, unless it searches, the zoom's."""
    top = TIER_ROWS[tier]
    if requested is None and history_ms is not None and history_ms > DAY_MS + 5000:
        return min(MAX_ROWS, top)
    asked = max(1, min(MAX_ROWS, requested or MAX_ROWS))
    caps = [] if searching or zoom is None else [rows for z, rows in ZOOM_ROWS if zoom >= z][:1]
    return min([asked, top, *caps])


@dataclass(frozen=True)
class AppliedLimit:
    """What a reply says of its limit: the rows asked for and given, by tier, and whether more were there."""

    requested: int | None
    applied: int
    tier: str
    is_capped: bool
    scope: str = "viewport"


def clusters_apply(zoom: float | None, box: geo.BBox | None, force_raw: bool = False) -> bool:
    """Whether a query is answered by clusters: far out, in a window that is not the world, unless single rows are asked for."""
    return not force_raw and (zoom is None or zoom < 5) and box is not None and not box.is_global()


def gate(q: FeedQuery, tier: str) -> str | None:
    """What a tier may not ask for (filters, search, range), or null: judged before anything is read."""
    rights = TIER_RIGHTS[tier]
    advanced = q.min_volume > 1 or (bool(q.tiers) and len(set(q.tiers)) != 3)
    basic = len(set(q.sources)) != len(ALL_SOURCES) or (bool(q.categories) and "all" not in q.categories)
    if (basic and "filters" not in rights["features"]) or (advanced and "advanced" not in rights["features"]):
        return "filters"
    if q.search and "search" not in rights["features"]:
        return "search"
    return None if q.time_range in rights["ranges"] else "range"


def parse(params: dict[str, str], now_ms: int) -> FeedQuery:
    """A query from text parameters; a ValueError says what is wrong with them."""
    number = lambda name: _number(params[name], name)
    sides = [s for s in ("minLat", "maxLat", "minLng", "maxLng") if s in params]
    if sides and len(sides) < 4:
        raise ValueError("a window has four sides")
    zoom = number("zoom") if params.get("zoom") else None
    if zoom is not None and not 0 <= zoom <= 24:
        raise ValueError("zoom is out of range")
    box = geo.BBox(*[number(s) for s in sides], zoom) if sides else None
    chosen = lambda name, every: tuple(sorted({v for v in params.get(name, ",".join(every)).split(",") if v}))
    sources, tiers = chosen("sources", ALL_SOURCES), chosen("credibility", ("1", "2", "3"))
    if set(sources) - set(ALL_SOURCES) or set(tiers) - {"1", "2", "3"}:
        raise ValueError("a filter is unknown")
    span = params.get("time_range") or "1d"
    if span not in (*RANGE_MS, "custom"):
        raise ValueError("time_range is unknown")
    volume = _number(params.get("min_reports", "1"), "min_reports")
    if volume != int(volume):
        raise ValueError("min_reports is a whole number")
    limit = max(1, min(MAX_ROWS, int(number("limit")))) if "limit" in params else None
    since, until = (_instant(params.get(name), name) for name in ("since", "until"))
    sort = "new" if params.get("sort") == "new" else "hot"
    q = FeedQuery(now_ms, box, sources, chosen("categories", ("all",)), span, since, until, params.get("query", "").strip(), int(volume), tuple(int(t) for t in tiers), sort, limit)
    return q.validated()


def _number(raw: str, name: str) -> float:
    try:
        value = float(raw)
    except ValueError:
        raise ValueError(f"{name} is not a number") from None
    if not math.isfinite(value):
        raise ValueError(f"{name} is not finite")
    return value


def _instant(raw: str | None, name: str) -> int | None:
    if not raw:
        return None
    try:
        at = datetime.fromisoformat(raw.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"{name} is not a date") from None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def detail(stories: DataFrame, wanted: str) -> DataFrame:
    """The story of an id, or of the original id."""
    return stories.where((F.col("id") == wanted) | (F.col("original_id") == wanted)).orderBy((F.col("id") == wanted).desc(), "id").limit(1)


def source_filter(source_type: Column, source: Column, chosen: tuple[str, ...]) -> Column:
    """Feeds, news interfaces and social platforms by choice; a platform shows in the source's name."""
    name = F.lower(source)
    social = {"reddit": name.contains("reddit"), "x": name.contains("(x)") | name.contains("twitter"), "telegram": name.contains("telegram")}
    picks = [F.lit(False)]
    picks += [source_type == kind for wanted, kind in (("news", "rss"), ("extra", "gnews")) if wanted in chosen]
    picks += [(source_type == "social") & test for platform, test in social.items() if platform in chosen]
    if set(social) <= set(chosen):
        picks.append(source_type == "social")
    return reduce(lambda a, b: a | b, picks)


def search_filter(query: str, *columns: Column) -> Column:
    """Whether a column holds the text, letters in any case; % and _ stand for themselves."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in columns])


def predicates(q: FeedQuery) -> Column:
    """All filters of the query over stories (lat, lon, source_type, source, category, latest_ms, tier, volume, ..)."""
    tests = [F.col("lat").isNotNull() & F.col("lon").isNotNull(), source_filter(F.col("source_type"), F.col("source"), q.sources)]
    if q.bbox:
        tests.append(geo.within(F.col("lat"), F.col("lon"), q.bbox))
    if q.categories and "all" not in q.categories:
        tests.append(F.coalesce("category", F.lit("general")).isin(list(q.categories)))
    if q.time_range == "custom":
        tests += [F.col("latest_ms") >= q.since_ms] if q.since_ms is not None else []
        tests += [F.col("latest_ms") <= q.until_ms] if q.until_ms is not None else []
    elif q.time_range in RANGE_MS:
        tests.append(F.lit(q.now_ms) - F.col("latest_ms") <= RANGE_MS[q.time_range])
    if q.search:
        tests.append(search_filter(q.search, F.col("title"), F.col("description"), F.col("location_name")))
    if q.min_volume > 1:
        tests.append(F.col("volume") >= q.min_volume)
    if q.tiers:
        tests.append(F.coalesce("tier", F.lit(3)).isin(list(q.tiers)))
    return reduce(lambda a, b: a & b, tests)


def ranking(sort: str) -> list[Column]:
    """Hot: impact, then recency; new: recency; ids settle ties.  Volume has no say."""
    recent = [F.col("latest_ms").desc(), F.col("canonical_id").asc()]
    return recent if sort == "new" else [F.coalesce("impact", F.lit(0.0)).desc(), *recent]


def canonical_id(id_: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(original, F.lit("")), id_)


def dedupe(stories: DataFrame, sort: str) -> DataFrame:
    """The best row of each canonical id by the current order."""
    best = Window.partitionBy("canonical_id").orderBy(*ranking(sort), F.col("id"))
    return stories.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def feed(stories: DataFrame, q: FeedQuery) -> DataFrame:
    """Filters, the pinned story, canonical deduplication, order and limit as one lazy plan."""
    q.validated()
    if q.now_ms == 0:
        return stories
    rows = stories.withColumn("canonical_id", canonical_id(F.col("id"), F.col("original_id")))
    kept = rows.where(predicates(q))
    if q.pinned:
        match = (F.col("id") == q.pinned) | (F.col("original_id") == q.pinned)
        one = rows.where(match & F.col("lat").isNotNull() & F.col("lon").isNotNull()).orderBy("id").limit(1)
        # only where no row that stays matches it
        there = kept.where(match).limit(1).select(F.lit(1).alias("_there"))
        kept = kept.unionByName(one.join(there, F.lit(True), "left_anti"))
    ordered = dedupe(kept, q.sort).orderBy(*ranking(q.sort))
    return ordered.limit(q.limit) if q.limit else ordered


def with_cap(rows: DataFrame, sort: str, limit: int) -> DataFrame:
    """The first ``limit`` rows with ``is_capped``: whether there were more."""
    more = rows.orderBy(*ranking(sort)).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*ranking(sort)))
    total = F.count("*").over(Window.partitionBy())
    return more.withColumn("place", place).withColumn("is_capped", total > limit).where(F.col("place") <= limit)


def clusters(stories: DataFrame, zoom: int, cell: float) -> DataFrame:
    """Stories in square cells: count, centre, greatest impact and its story, and an id of zoom, centre and count.

    A row's ``story_count`` counts for as many stories, and a cell is hot if a row of it ``is_top_hot``.
    """
    rows = stories.where(geo.usable(F.col("lat"), F.col("lon")))
    own = F.coalesce("story_count", F.lit(1)) if "story_count" in stories.columns else F.lit(1)
    hot = F.coalesce("is_top_hot", F.lit(False)) if "is_top_hot" in stories.columns else F.lit(False)
    grouped = rows.groupBy(F.floor(F.col("lat") / cell).alias("cell_y"), F.floor(F.col("lon") / cell).alias("cell_x")).agg(
        F.sum(own).cast("bigint").alias("story_count"), F.max(hot).alias("is_top_hot"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), F.max("impact").alias("max_impact"), F.max_by("id", F.struct("impact", "latest_ms", "id")).alias("top_id")
    )
    return grouped.withColumn("cluster_id", F.format_string("cluster-z%d-%.4f-%.4f-%d", F.lit(zoom), "center_lat", "center_lon", "story_count"))


def hot_flags(stories: DataFrame, top: int = 3) -> DataFrame:
    """``is_top_hot`` on all rows of the ``top`` hottest canonical ids."""
    rows = stories.withColumn("canonical_id", canonical_id(F.col("id"), F.col("original_id")))
    best = dedupe(rows, "hot").orderBy(*ranking("hot")).limit(top).select("canonical_id", F.lit(True).alias("_hot"))
    return rows.join(F.broadcast(best), "canonical_id", "left").withColumn("is_top_hot", F.coalesce("_hot", F.lit(False))).drop("_hot")


def pinned_limit(rows: DataFrame, order: list[Column], n: int, pinned: str) -> DataFrame:
    """The first ``n`` rows; a pinned one beyond them takes the last place."""
    ranked = rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    pin = rows.where(F.col("id") == pinned).limit(1)
    outside = pin.join(ranked.where(F.col("id") == pinned).select("id"), "id", "left_anti")
    shift = outside.select(F.lit(1).alias("_out"))
    kept = ranked.join(F.broadcast(shift), F.lit(True), "left").where((F.col("place") < n) | F.col("_out").isNull()).drop("_out")
    return kept.unionByName(outside.withColumn("place", F.lit(n)))


def spread_overlaps(stories: DataFrame, selected: str | None = None) -> DataFrame:
    """Stories on one spot (5 decimals) laid out on a golden-angle spiral of at most six kilometres."""
    spot = [F.floor(F.col("lat") * 1e5 + 0.5), F.floor(F.col("lon") * 1e5 + 0.5)]
    order = [(F.col("id") != (selected or "")).cast("int"), F.col("id")]
    w = Window.partitionBy(*spot).orderBy(*order)
    rows = stories.withColumn("_i", F.row_number().over(w) - 1).withColumn("_a", F.first("lat").over(w)).withColumn("_b", F.first("lon").over(w))
    radius = F.least(F.lit(6.0), F.sqrt("_i") * 0.9 * 1.2)
    angle = F.radians(F.col("_i") * 137.5)
    lat = F.least(F.lit(85.0), F.greatest(F.lit(-85.0), F.col("_a") + radius * F.cos(angle) / 111.32))
    lon = F.col("_b") + radius * F.sin(angle) / (111.32 * F.greatest(F.lit(0.2), F.cos(F.radians("_a"))))
    moved = F.col("_i") > 0
    return rows.withColumn("map_lat", F.when(moved, lat).otherwise(F.col("lat"))).withColumn("map_lon", F.when(moved, geo.wrap_lon(lon)).otherwise(F.col("lon"))).drop("_i", "_a", "_b")


def geojson(stories: DataFrame) -> DataFrame:
    """A GeoJSON point feature of each story, as text."""
    props = F.struct("id", F.coalesce(F.nullif("original_id", F.lit("")), "id").alias("canonicalId"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("story_count", F.lit(1)).alias("storyCount"), F.coalesce("is_top_hot", F.lit(False)).alias("isTopHot"))
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return stories.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("feature"))


def headline_stats(stories: DataFrame) -> DataFrame:
    """Stories in all (a missing or zero count is one) and the newest activity."""
    return stories.agg(F.sum(F.coalesce(F.nullif("story_count", F.lit(0)), F.lit(1))).cast("bigint").alias("stories"), F.max("latest_ms").alias("newest_ms"))


def timeline(reports: DataFrame, story: str, at: Column, limit: int | None) -> DataFrame:
    """A story's reports, the primary one (``is_primary``) and the newest ``limit`` - 1 others; 0: the primary alone."""
    if limit is None:
        return reports.withColumn("is_restricted", F.lit(False))
    newest = Window.partitionBy(story, "is_primary").orderBy(at.desc())
    ranked = reports.withColumn("_r", F.row_number().over(newest)).withColumn("_n", F.count("*").over(Window.partitionBy(story)))
    kept = ranked.where(F.col("is_primary") | (F.col("_r") <= max(0, limit - 1)))
    return kept.withColumn("is_restricted", F.col("_n") > max(1, limit)).drop("_r", "_n")

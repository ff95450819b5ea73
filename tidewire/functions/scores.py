"""Scores, clocks and hashes as Columns.  ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import without_accents

# Fixed values
HOUR_MS = 3_600_000
FUTURE_SKEW_MS = 300_000
SLOT_MS = 900_000
POLL_DIVISOR = {"fast": 1, "normal": 2, "slow": 4}
POLL_ITEMS = {"fast": 15, "normal": 12, "slow": 8}
POLL_AGE_MS = {"fast": 36 * HOUR_MS, "normal": 48 * HOUR_MS, "slow": 96 * HOUR_MS}
FAST_FEEDS = [
    "BBC World", "Al Jazeera", "SCMP", "CNA Asia", "The Hindu", "BBC Africa", "Africanews", "BBC Middle East", "Al Arabiya English",
    "Times of Israel", "Middle East Eye", "USGS Earthquakes", "ISW Daily Updates", "ACLED", "NDTV India", "ABC Australia",
    "Vanguard News", "Anadolu Agency", "Yonhap News", "Dawn Pakistan", "ANTARA News", "Premium Times Nigeria", "NJ.com", "Global News Canada",
]
SLOW_FEEDS = ["War on the Rocks", "Foreign Affairs", "CFR", "Chatham House", "ECFR", "The Diplomat", "Geopolitical Futures", "Bellingcat", "ICG CrisisWatch"]
FAST_ACCOUNTS = ["IDF (X)", "OSINTtechnical (X)", "ELINT News (X)", "OSINTdefender (X)", "BRICSinfo (X)", "Breaking911 (X)"]
SLOW_CATEGORIES = ["business", "technology", "science", "health"]
COOLDOWN_MS = {"hour": HOUR_MS, "quarter_day": 6 * HOUR_MS, "two_hours": 2 * HOUR_MS, "half_hour": HOUR_MS // 2}
FAILURES = ["rate_limited", "provider_error", "parse_error"]
PLACE_ALIASES = {"uk": "united kingdom", "usa": "united states", "u.s.": "united states", "america": "united states", "britain": "united kingdom", "kiev": "kyiv", "uae": "united arab emirates"}
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without a zone, whatever the session's zone; null is 0."""
    return F.coalesce(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")), F.lit(0).cast("bigint"))


def impact(tier: Column, publishers: Column) -> Column:
    """3.5 less the tier, and 5 less the tier for each further independent publisher."""
    t = F.when(tier.isNull() | F.isnan(tier.cast("double")), F.lit(3.0)).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(1.0), tier.cast("double"))))
    n = F.when(publishers.isNull() | F.isnan(publishers.cast("double")), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.floor(publishers.cast("double")).cast("double")))
    return 3.5 - t + (n - 1) * (5 - t)


def event_count(count: Column, sources: Column) -> Column:
    """The larger of a stated count and the number of sources, 1 at least."""
    n = F.greatest(F.coalesce(count.cast("bigint"), F.lit(0)), F.when(sources.isNull(), 0).otherwise(F.size(sources)).cast("bigint"))
    return F.when(n > 0, n).otherwise(F.lit(1).cast("bigint"))


def latest_ms(activity: Column, published: Column, discovered: Column) -> Column:
    """The latest of an activity, a publication and an array of discoveries, in milliseconds; missing ones are 0."""
    return F.greatest(epoch_ms(activity), epoch_ms(published), F.coalesce(F.array_max(F.transform(discovered, epoch_ms)), F.lit(0).cast("bigint")))


def freshness(latest_ms_: Column, items: Column, now_ms: Column, max_age_ms: Column) -> Column:
    """empty, stale or healthy: by the age of the latest item, which may be five minutes ahead."""
    age = now_ms - latest_ms_
    return F.when((items == 0) | latest_ms_.isNull(), "empty").when((age > max_age_ms) | (age < -FUTURE_SKEW_MS), "stale").otherwise("healthy")


def cooldown_ms(code: Column) -> Column:
    """How long a failure with this code keeps a source closed."""
    hour = code == "http_429"
    long = code.isin("http_401", "http_403", "http_404", "https_required", "redirect_limit", "redirect_missing")
    mid = code.rlike("^http_4[0-9]{2}$") | code.isin("invalid_xml", "content_type", "byte_limit")
    short = code.rlike("^http_5[0-9]{2}$") | code.isin("timeout", "dns_failure", "connect_failure", "body_read_failure", "body_unavailable", "all_strategies_failed")
    pick = F.when(hour, COOLDOWN_MS["hour"]).when(long, COOLDOWN_MS["quarter_day"]).when(mid, COOLDOWN_MS["two_hours"]).when(short, COOLDOWN_MS["half_hour"])
    return F.coalesce(pick, F.lit(0)).cast("bigint")


def error_code(status: Column, message: Column) -> Column:
    """A safe code of a failure: its HTTP status, or what its message speaks of."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string"))).when(text.contains("timeout") | text.contains("timed out"), "timeout").when(text.contains("dns") | text.contains("enotfound"), "dns_failure").when(text.contains("xml"), "invalid_xml").otherwise("provider_failure")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over the characters' codes (of the basic plane), as a bigint."""
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("bigint"), lambda h, c: step(h, c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def poll_tier(name: Column, category: Column) -> Column:
    """How often a feed is polled: by its name, else by its category."""
    return F.when(name.isin(FAST_FEEDS) | (category == "crisis"), "fast").when(name.isin(SLOW_FEEDS) | category.isin(SLOW_CATEGORIES), "slow").otherwise("normal")


def account_poll_tier(name: Column, platform: Column) -> Column:
    return F.when((platform == "telegram") | name.isin(FAST_ACCOUNTS), "fast").otherwise("normal")


def poll_due(tier: Column, key: Column, now_ms: int) -> Column:
    """Whether a source is polled in this quarter of an hour: its hash spreads it over its tier's slots."""
    d = F.when(tier == "fast", 1).when(tier == "normal", 2).otherwise(4).cast("bigint")
    return F.lit(now_ms // SLOT_MS) % d == fnv1a(key) % d


def expanded_limit(limit: Column, emergency: bool) -> Column:
    return F.ceil(limit * 1.5).cast("bigint") if emergency else limit.cast("bigint")


def safe_time(raw: Column, now: Column) -> Column:
    """A timestamp from ISO or mail-style text, the weekday left out; what can't be read, or is ahead, is now."""
    bare = F.trim(F.regexp_replace(raw, r"^[A-Za-z]{3,9},\s*", ""))
    zoned = F.regexp_replace(bare, r"\s*(?:GMT|UTC|Z)$", "")
    read = F.coalesce(F.try_to_timestamp(bare), *[F.try_to_timestamp(zoned, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "d MMM yyyy", "yyyy/MM/dd")])
    return F.least(F.coalesce(read, now), now)


def time_ago(minutes: Column) -> Column:
    m = F.floor(minutes)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))


def plain_place(name: Column) -> Column:
    """A place name for comparison: without accents, in lower case, aliases in their common form; "null" is none."""
    plain = F.lower(F.trim(without_accents(name)))
    aliases = F.create_map(*[F.lit(x) for pair in PLACE_ALIASES.items() for x in pair])
    return F.when(plain != "null", F.coalesce(F.try_element_at(aliases, plain), plain))


def within_bounds(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """Whether a point is within bounds; west beyond east means over the antimeridian."""
    across = F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))
    return F.coalesce(lat.between(south, north) & across, F.lit(False))


def accuracy(cases: DataFrame, kind: str = "outcome") -> DataFrame:
    """(outcome, n, correct_share): cases by outcome, and the share of all that are right."""
    right = F.sum(F.col(kind).endswith("correct").cast("int")) / F.count("*")
    return cases.groupBy(kind).agg(F.count("*").alias("n")).crossJoin(cases.agg(F.round(right, 6).alias("correct_share")))


def outcome(expected_name: Column, actual_name: Column, expected_key: Column, actual_key: Column, distance_km: Column, tolerance_km: Column) -> Column:
    """How a located text compares with what was expected of it."""
    return (
        F.when(plain_place(expected_name).isNull() & plain_place(actual_name).isNull(), "unmapped-correct")
        .when(plain_place(expected_name).isNull(), "false-pin")
        .when(plain_place(actual_name).isNull(), "miss")
        .when(plain_place(expected_name) != plain_place(actual_name), "wrong-place")
        .when(expected_key.isNotNull() & ~expected_key.eqNullSafe(actual_key), "wrong-identity")
        .when(distance_km > F.coalesce(tolerance_km, F.lit(25.0)), "wrong-coordinate")
        .otherwise("mapped-correct")
    )


def fixed_2dp(x: Column) -> Column:
    """Two decimals, halves towards plus infinity."""
    return F.floor(x * 100 + 0.5) / 100


def width_bucket_of(width: Column, widths: list[int]) -> Column:
    """The smallest stored width that is wide enough, else the widest."""
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: w >= width)), F.lit(max(widths)))


def local_input(value: Column, zone: str) -> Column:
    """An instant as a reader's local "yyyy-MM-ddTHH:mm"; text without a zone stays, and what can't be read is empty."""
    zoned = value.rlike(r"(?i)(?:Z|[+-][0-9]{2}:[0-9]{2})$")
    utc = F.to_utc_timestamp(F.try_to_timestamp(value), F.current_timezone())
    shown = F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd'T'HH:mm")
    return F.coalesce(F.when(F.coalesce(value, F.lit("")) == "", "").when(zoned, shown).otherwise(value), F.lit(""))


def http_outcome(status: Column) -> Column:
    """What an HTTP status says of an attempt: success, rate_limited (403 and 429) or provider_error."""
    return F.when(status.between(200, 299) | (status == 304), "success").when(status.isin(403, 429), "rate_limited").otherwise("provider_error")

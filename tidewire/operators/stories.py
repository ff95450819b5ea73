"""Story resolution: exact, vector, spatial and temporal evidence, conflicts, and the fold of reports into stories."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scores, text
from .shared import checkpoint_dir, dealt_join, sized

# Fixed values
STRICT, NEAR = 0.85, 0.60
MERGE_KM, PRECISE_KM = 50.0, 3.0
TOP_K, EXPANDED_K = 12, 50
HORIZON_MS = 48 * scores.HOUR_MS
STALE_MS, MUCH_NEWER_MS, LENGTH_SHARE = 6 * scores.HOUR_MS, 900_000, 0.7
IMAGE_GAP_MS, IMAGE_COOLDOWN_MS = 12 * scores.HOUR_MS, 6 * scores.HOUR_MS
CONFLICT_GAP_MS = 18 * scores.HOUR_MS
BROAD_REGIONS = ["africa", "asia", "europe", "north america", "south america", "oceania", "antarctica", "middle east", "world", "global"]
SPORTS = [
    r"\b(?:football|soccer)\b", r"\bvolleyball\b", r"\bbasketball\b",
    r"\bbaseball\b", r"\bcricket\b", r"\brugby\b", r"(?<!table\s)\btennis\b",
    r"\bbadminton\b", r"\bhockey\b", r"\bswimming\b", r"\barchery\b",
    r"\bfencing\b", r"\bcycling\b", r"\bwrestling\b", r"\btable tennis\b",
]
COMPETITIONS = [r"\basian games\b", r"\bolympic(?:s| games)?\b", r"\bworld cup\b", r"\bworld championships?\b"]
GENDERS = [r"\bmen(?:'s)?\b", r"\bwomen(?:'s)?\b"]
TARGETS = [
    r"\b(?:hospital|medical cent(?:er|re))\b", r"\b(?:school|kindergarten)\b",
    r"\bwarehouse\b", r"\b(?:apartment|residential|homes?|houses?)\b",
    r"\b(?:factory|plant|refinery)\b", r"\b(?:airport|airfield)\b",
    r"\b(?:port|harbou?r)\b",
]
#: What makes a target the site of an incident: {} is the target.
SITE_FORMS = [
    r"{}\s+(?:(?:major|massive|chemical|industrial|deadly|fatal|missile|drone|rocket|bomb|gas)\s+){{0,2}}(?:fire|blaze|explosion|blast|attack|strike)\b",
    r"\b(?:fire|blaze|explosion|blast|strike|attack)\b.{{0,35}}\b(?:at|in|on|hits?|strikes?|struck|targets?|targeted|damages?|destroys?)\s+[^,.;:]{{0,50}}{}",
    r"{}\s+(?:(?:was|is)\s+)?(?:hit|struck|attacked|bombed|shelled|damaged|destroyed|burns|ablaze)\b",
]
INCIDENT = r"\b(?:fire|blaze|explosion|blast|strike|missile|earthquake|shooting|attack)\b"
FOLLOW_UP = [
    r"\b(?:death toll|toll (?:rises|rose)|aftermath|survivors?|funerals?|investigat(?:ion|ors?|es?)|days? after|following|previous|earlier|last week's|update)\b",
    r"\b(?:dies|died|succumbs?|injured)\b.{0,100}\b(?:after|later|from (?:his|her|their|the) injuries)\b",
]
QUIZ = r"^(?:(?:daily|weekly)\s+)?(?:quiz|trivia|crossword)(?:\s*(?:[:|—-]|$)|\s+(?:on|about|time|answers?|clues?)\b)"
COMPETITION_REPORT = r"\b(?:beats?|defeats?|wins?|won|match|tournament|competition|final|semifinal|quarterfinal|gold|silver|bronze|medal|champion(?:ship)?|victor(?:y|ies))\b"
AGREEMENT_REPORT = r"\b(?:sign(?:s|ed)?|agree(?:s|d|ment)?|pact|deal|accord|treaty)\b"
MARKET, SESSION = r"\b(?:shares|stocks|kospi|nikkei|sensex|wall street)\b", r"\b(?:close[sd]?|open[s]?|end[s]?|finish(?:es)?|slump[s]?|gain[s]?|surge[s]?|rise[s]?|fall[s]?|rebound[s]?)\b"
LATER_REPORT = r"\b(?:names?|released|identified|announced|funerals?|investigat(?:ion|ors?|es?)|survivors?)\b"
INCIDENT_TOLD = r"\b(?:fire|blaze|earthquake|attack|strike|shooting|explosion|blast|exploded|struck|hit|erupted|occurred|broke out)\b"
# End of fixed values


def dot(x: Column, y: Column) -> Column:
    """The dot product of two arrays, which is the cosine of unit vectors."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def parse_vector(text_: Column) -> Column:
    """A vector from its text form "[0.1,0.2]"."""
    return F.from_json(text_, "array<float>")


def exact_candidates(incoming: DataFrame, recent: DataFrame, now_ms: int) -> DataFrame:
    """(seq, story) of incoming items and recent stories with equal title fingerprints of 24 or more."""
    marked = lambda df: df.withColumn("fp", text.fingerprint(F.col("title"))).where("length(fp) >= 24")
    stories = marked(recent.where(F.col("published_ms") >= now_ms - HORIZON_MS)).select("fp", F.col("id").alias("story"))
    return dealt_join(marked(incoming).select("seq", "fp"), stories, ["fp"]).select("seq", "story")


def _pack(frames: Iterator[pa.RecordBatch], block: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of (id, embedding) as one row of bytes each: 64-bit ids, and a matrix of 64-bit numbers."""
    for frame in frames:
        for i in range(0, frame.num_rows, block):
            part = frame.slice(i, block)
            vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]), pa.array([vectors.tobytes()])], ["ids", "vectors"])


def _met_blocks(queries: DataFrame, base: DataFrame) -> DataFrame:
    """Each block of ``base`` beside each of ``queries``: (b_ids, b, q_ids, q)."""
    packed = lambda df: df.where("embedding is not null").select(F.col("id").cast("bigint"), "embedding").mapInArrow(_pack, "ids binary, vectors binary")
    return packed(base).toDF("b_ids", "b").crossJoin(packed(queries).toDF("q_ids", "q"))


#: Similarities that a task holds at once.
SIMILARITIES = 1 << 20
#: Ids of one place that stand in a row.
BLOCK = 1024


def _similarities(frame: pa.RecordBatch, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, base ids, similarities) of each pair of blocks, some queries at a time."""
    for b_raw, b, q_raw, q in zip(*frame.columns, strict=True):
        b_ids, q_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (b_raw, q_raw))
        bs, qs = (np.frombuffer(x.as_buffer(), np.float64).reshape(len(ids), -1) for x, ids in ((b, b_ids), (q, q_ids)))
        step = max(1, SIMILARITIES // max(1, len(b_ids)))
        for i in range(0, len(q_ids), step):
            sims = qs[i : i + step] @ bs.T
            yield q_ids[i : i + step], b_ids, np.round(sims, digits, out=sims)


def _nearest(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest finite similarities of each row, of equal ones the smaller ids."""
    least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
    rows, cols = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
    order = np.lexsort((ids[cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def _pairs_of(q_ids: np.ndarray, b_ids: np.ndarray, sims: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(b_ids[cols]), pa.array(sims[rows, cols])], ["query_id", "neighbour_id", "similarity"])


def similar(queries: DataFrame, base: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """(query_id, neighbour_id, similarity): all other rows of ``base`` at least so similar to a row of ``queries``.

    The exact form beside ``knn``, for where the nearest few are not enough; pairs below ``least`` are never rows.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for q_ids, b_ids, sims in _similarities(frame, digits):
                rows, cols = np.nonzero((sims >= least) & (q_ids[:, None] != b_ids[None, :]))
                yield _pairs_of(q_ids, b_ids, sims, rows, cols)

    return _met_blocks(queries, base).mapInArrow(run, "query_id bigint, neighbour_id bigint, similarity double")


def knn(queries: DataFrame, base: DataFrame, k: int = TOP_K, digits: int = 6, earlier: bool = False) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the ``k`` nearest rows of ``base`` for each row of ``queries``.

    Both have (id, embedding); rows without a vector are left out.  Rows are packed where they are, a batch a row, and
    each batch of queries meets each of the base as a matrix product; every such pair keeps its best ``k``, and these
    partial lists are merged by a window.  Nothing but the queries and the lists is shuffled, and no pair of vectors is
    ever a row.  With ``earlier``, neighbours have smaller ids.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for q_ids, b_ids, sims in _similarities(frame, digits):
                hidden = q_ids[:, None] <= b_ids[None, :] if earlier else q_ids[:, None] == b_ids[None, :]
                sims[hidden] = -np.inf
                yield _pairs_of(q_ids, b_ids, sims, *_nearest(sims, b_ids, k))

    part = _met_blocks(queries, base).mapInArrow(run, "query_id bigint, neighbour_id bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "neighbour_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def expanded(candidates: DataFrame, eligible: Column) -> DataFrame:
    """Of lists of 50 the first 12, and all 50 only where a full page of 12 has no eligible row."""
    w = Window.partitionBy("query_id")
    rows = candidates.withColumn("_ok", eligible)
    page = F.sum((F.col("rank") <= TOP_K).cast("int")).over(w)
    hits = F.sum(((F.col("rank") <= TOP_K) & F.col("_ok")).cast("int")).over(w)
    return rows.withColumn("_more", (page == TOP_K) & (hits == 0)).where((F.col("rank") <= TOP_K) | F.col("_more")).drop("_ok", "_more")


def _blocks(points: DataFrame, p: str) -> DataFrame:
    """(lat, lon, block, ids), names after ``p``: the ids of equal points, about ``BLOCK`` of them in a row."""
    full = points.groupBy("lat", "lon").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).where("_n > 1")
    checkpoint_dir(points.sparkSession)
    full = full.checkpoint()
    block = F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))).cast("int")
    rows = points.join(sized(full), ["lat", "lon"], "left").withColumn("_block", block)
    return rows.groupBy("lat", "lon", "_block").agg(F.collect_list("id")).toDF(f"{p}_lat", f"{p}_lon", f"{p}_block", f"{p}_ids")


def within_km(left: DataFrame, right: DataFrame, km: float, ms: int | None = None, digits: int | None = None) -> DataFrame:
    """Pairs (a_id, b_id, km) of points (id, lat, lon) at most ``km`` apart; ``digits`` rounds the distances.

    With ``ms``, points also have at_ms, and pairs are at most that far apart in time, found point by point.  Else
    equal points are one place, and distances are found and rounded between places: a pair of ids costs no more than
    its row.  Blocks of ids meet where their places are near, and each two blocks are dealt out by themselves, so no
    task gets all pairs of a place.  Rows without an id or a place meet nothing.
    """
    rounded = lambda df: df if digits is None else df.withColumn("km", F.round("km", digits))
    if ms is not None:
        return rounded(_cell_pairs(left, right, km, ms))
    left, right = (df.where("lat is not null and lon is not null") for df in (left, right))
    place = lambda df: df.select(F.struct("lat", "lon").alias("id"), "lat", "lon").distinct()
    near = rounded(_cell_pairs(place(left), place(right), km)).select("a_id.*", "b_id.*", "km").toDF("a_lat", "a_lon", "b_lat", "b_lon", "km")
    met = near.join(_blocks(left, "a"), ["a_lat", "a_lon"]).join(_blocks(right, "b"), ["b_lat", "b_lon"])
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = met.repartition(tasks, "a_lat", "a_lon", "a_block", "b_lat", "b_lon", "b_block")
    return met.select(F.explode("a_ids").alias("a_id"), "b_ids", "km").select("a_id", F.explode("b_ids").alias("b_id"), "km")


def _cell_pairs(left: DataFrame, right: DataFrame, km: float, ms: int | None = None) -> DataFrame:
    """Pairs of points (id, lat, lon) at most ``km`` apart, by an equi-join of grid cells.

    With ``ms``, points also have at_ms, and pairs are at most that far apart in time, by buckets in the same join.

    A cell is ``km`` high, and as wide in degrees as that distance is at its row's edge nearer the pole.  The left
    side is given to its own and the eight cells around, over the antimeridian too, so each pair meets exactly once.
    """
    height = km / 111.0
    row = lambda lat: F.floor(lat / height).cast("bigint")

    def columns(r: Column) -> Column:
        edge = F.least(F.lit(89.9), F.greatest(F.abs(r * height), F.abs((r + 1) * height)))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / height)).cast("bigint")

    def column(lon: Column, r: Column) -> Column:
        return F.least(columns(r) - 1, F.floor((geo.wrap_lon(lon) + 180) / 360 * columns(r)).cast("bigint"))

    at = lambda p: [] if ms is None else [F.col("at_ms").alias(f"{p}_ms")]
    a = left.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), *at("a"))
    a = a.withColumn("row", F.explode(F.array(*[row(F.col("a_lat")) + d for d in (-1, 0, 1)])))
    home = column(F.col("a_lon"), F.col("row"))
    a = a.withColumn("col", F.explode(F.array_distinct(F.array(*[F.pmod(home + d, columns(F.col("row"))) for d in (-1, 0, 1)]))))
    b = right.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), *at("b")).withColumn("row", row(F.col("b_lat")))
    b = b.withColumn("col", column(F.col("b_lon"), F.col("row")))
    keys = ["row", "col"]
    if ms is not None:
        keys.append("_t")
        a = a.withColumn("_t", F.explode(F.array(*[F.floor(F.col("a_ms") / ms) + d for d in (-1, 0, 1)])))
        b = b.withColumn("_t", F.floor(F.col("b_ms") / ms))
    met = dealt_join(a, b, keys)
    if ms is not None:
        met = met.where(F.abs(F.col("a_ms") - F.col("b_ms")) <= ms)
    met = met.withColumn("km", geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return met.where(F.col("km") <= km).select("a_id", "b_id", "km")


def within_time(left: DataFrame, right: DataFrame, keys: list[str], ms: int) -> DataFrame:
    """Pairs (id, at_ms, keys..) with equal keys at most ``ms`` apart, by an equi-join of time buckets."""
    a = left.select(F.col("id").alias("a_id"), F.col("at_ms").alias("a_ms"), *keys).withColumn("_t", F.explode(F.array(*[F.floor(F.col("a_ms") / ms) + d for d in (-1, 0, 1)])))
    b = right.select(F.col("id").alias("b_id"), F.col("at_ms").alias("b_ms"), *keys).withColumn("_t", F.floor(F.col("b_ms") / ms))
    return dealt_join(a, b, ["_t", *keys]).where(F.abs(F.col("a_ms") - F.col("b_ms")) <= ms).drop("_t")


def _bits(title: Column, patterns: list[str]) -> Column:
    hit = lambda i, p: F.when(text.matches(title, p), 1 << i).otherwise(0)
    return reduce(lambda a, b: a.bitwiseOR(b), [hit(i, p) for i, p in enumerate(patterns)])


def incident_days(whole: Column) -> Column:
    """A bit for each weekday of sentences that tell of an incident itself, not of what was reported of it later."""
    told = F.filter(F.split(whole, r"[.!?;]+"), lambda s: text.matches(s, INCIDENT_TOLD) & ~text.matches(s, LATER_REPORT))
    return F.aggregate(told, F.lit(0), lambda bits, s: bits.bitwiseOR(_bits(s, [rf"\b{d}\b" for d in text.DAYS])))


def named_countries(stories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``stories`` with ``countries``: the codes of countries that titles of agreements name, by n-grams of four words."""
    words = F.filter(F.split(text.without_accents(F.lower("title")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    deals = stories.where(text.matches(F.col("title"), AGREEMENT_REPORT)).select("id", words.alias("w"))
    grams = deals.select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("at + n <= size(w) + 1")
    grams = grams.select("id", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("key"))
    known = gazetteer.where("type = 'country' and country is not null").select("key", "country").distinct()
    found = grams.join(sized(known), "key").groupBy("id").agg(F.collect_set("country").alias("countries"))
    return stories.join(found, "id", "left")


def evidence(stories: DataFrame) -> DataFrame:
    """``stories`` with what conflicts are judged by, found once per row: bit sets, flags and fingerprints of the title.

    Rows have (id, title, description, url, at_ms, lat, lon, precise) and may have location_name and the ``countries``
    of ``named_countries``.
    """
    t = F.col("title")
    sites = ["|".join(form.format(target) for form in SITE_FORMS) for target in TARGETS]
    whole = F.concat_ws(". ", t, F.coalesce("description", F.lit("")))
    if "countries" not in stories.columns:
        stories = stories.withColumn("countries", F.lit(None).cast("array<string>"))
    named = F.lit(False)
    if "location_name" in stories.columns:
        first = F.trim(F.substring_index("location_name", ",", 1))
        escaped = F.regexp_replace(first, r"([.*+?^${}()|\[\]\\])", r"\\$1")
        edge = F.lit(text.EDGE)
        form = F.concat(F.lit("(?i)"), edge, F.lit("(?:in|at|near)\\s+(?:the city of\\s+)?"), escaped, edge)
        named = F.when(F.coalesce(first, F.lit("")) != "", F.regexp_like(whole, form)).otherwise(False)
    return stories.withColumns(
        {
            "identity": text.report_identity(F.col("url")),
            "fp": text.fingerprint(t),
            "template": text.template_fingerprint(t),
            "dated": text.has_date(t),
            "quiz": text.matches(t, QUIZ),
            "contest": text.matches(t, COMPETITION_REPORT),
            "sports": _bits(t, SPORTS),
            "cups": _bits(t, COMPETITIONS),
            "genders": _bits(t, GENDERS),
            "incident": text.matches(t, INCIDENT),
            "sites": _bits(t, sites),
            "market": text.matches(t, MARKET) & text.matches(t, SESSION),
            "follow_up": text.matches(whole, *FOLLOW_UP),
            "weekdays": incident_days(whole),
            "deal": text.matches(t, AGREEMENT_REPORT),
            "named": named,
        }
    )


def conflicts(a: str, b: str) -> Column:
    """Whether two rows of ``evidence`` contradict each other (columns a.x, b.x); what is absent is no contradiction."""
    x, y = (lambda c, p=p: F.col(f"{p}.{c}") for p in (a, b))
    apart = lambda c: (x(c) != 0) & (y(c) != 0) & (x(c).bitwiseAND(y(c)) == 0)
    both_of = lambda c: x(c) & y(c)
    recurring = (x("fp") != y("fp")) & x("dated") & y("dated") & (F.length(x("template")) >= 12) & (x("template") == y("template"))
    contest = both_of("contest") & ((x("sports") != 0) | (y("sports") != 0))
    parties = both_of("deal") & (F.size(x("countries")) == 2) & (F.size(y("countries")) == 2) & (F.size(F.array_except(x("countries"), y("countries"))) > 0)
    gap = F.abs(x("at_ms") - y("at_ms"))
    both, same = both_of("incident"), x("fp") == y("fp")
    far = geo.haversine_km(x("lat"), x("lon"), y("lat"), y("lon")) > MERGE_KM
    elsewhere = (same | both) & (both_of("precise") | (same & both_of("named"))) & far
    day = lambda c: F.floor(c / (24 * scores.HOUR_MS))
    single = lambda c: F.bit_count(c) == 1
    session = (gap >= CONFLICT_GAP_MS) & both_of("market") & (day(x("at_ms")) != day(y("at_ms")))
    days = (gap > CONFLICT_GAP_MS) & both & ~x("follow_up") & ~y("follow_up") & single(x("weekdays")) & single(y("weekdays")) & apart("weekdays")
    # an unknown part is no contradiction, and hides none
    parts = [recurring, x("quiz") != y("quiz"), contest & (apart("sports") | apart("cups") | apart("genders")), parties, both & apart("sites"), elsewhere, session, days]
    any_ = reduce(lambda p, q: p | q, [F.coalesce(p, F.lit(False)) for p in parts])
    return ~x("identity").eqNullSafe(y("identity")) & any_


def conflict_candidates(stories: DataFrame) -> DataFrame:
    """(a_id, b_id), a_id < b_id: rows of ``evidence`` that may be one story.

    Those are rows within 50 km and 48 hours of each other, of equal title fingerprints, or of equal templates where
    both titles have a date.
    """
    placed = stories.where(geo.usable(F.col("lat"), F.col("lon")))
    pairs = [within_km(placed, placed, MERGE_KM, HORIZON_MS).where("a_id < b_id").select("a_id", "b_id")]
    for mark, rows in (("fp", stories.where("fp <> ''")), ("template", stories.where("dated and template <> ''"))):
        a, b = (rows.select(F.col("id").alias(f"{p}_id"), mark) for p in "ab")
        pairs.append(dealt_join(a, b, [mark]).where("a_id < b_id").select("a_id", "b_id"))
    return reduce(DataFrame.union, pairs).distinct()


def precise(stories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``precise``: finite coordinates within three kilometres of a city or landmark of the stated name, regions aside.

    The name counts whole, and up to its first comma.
    """
    bare = F.lower(F.trim("location_name"))
    names = F.array_distinct(F.array(bare, F.trim(F.substring_index(bare, ",", 1))))
    places = gazetteer.where("type in ('city', 'landmark')").select("key", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    near = stories.where(geo.usable(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", F.explode(names).alias("key")).where(~F.col("key").isin(BROAD_REGIONS)).join(sized(places), "key")
    ok = near.where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon")) <= PRECISE_KM).select("id").distinct()
    return stories.join(ok.withColumn("_ok", F.lit(True)), "id", "left").withColumn("precise", F.coalesce("_ok", F.lit(False))).drop("_ok")


def passes(similarity: Column, near: Column) -> Column:
    """Close enough in meaning: 0.85, or 0.60 at a shared precise place."""
    return (similarity >= STRICT) | ((similarity >= NEAR) & near)


# The rules below are made of comparisons alone, so they hold for columns and, in the fold, for plain numbers.


def title_wins(tier, at, length, new_tier, new_at, new_length):
    """Whether an incoming title replaces a story's: better tier, newer of the same, or one worse and much newer."""
    newer = (new_at > at) | ((new_at == at) & (new_length > length))
    return (new_tier < tier) | ((new_tier == tier) & newer) | ((new_tier == tier + 1) & (new_at > at + MUCH_NEWER_MS))


def description_wins(tier, at, length, new_tier, new_at, new_length):
    """Whether an incoming description replaces a story's: better tier, or of the same one longer, or fresh enough."""
    stale = new_at > at + STALE_MS
    same = (stale & (new_length >= length * LENGTH_SHARE)) | (new_length > length)
    wins = (new_tier < tier) | (length == 0) | ((new_tier == tier) & same) | ((new_tier == tier + 1) & stale & (new_length >= length))
    return wins & (new_length > 0)


def image_wins(lacking, image_at, updated, new_at, now):
    """Whether a story may take a new picture: it lacks one, or the new one is 12 h newer and the last change 6 h old."""
    return lacking | ((new_at >= image_at + IMAGE_GAP_MS) & (now >= updated + IMAGE_COOLDOWN_MS))


def components(nodes: DataFrame, links: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, component): the smallest id that links (a, b) lead to, by alternating large-star and small-star rounds.

    Rounds grow with the logarithm of the longest path; where ``rounds`` do not settle the labels, this raises.
    Edges are checkpointed each round, so lineage stays short and lost executors cost little.
    """
    checkpoint_dir(nodes.sparkSession)
    edges = links.select("a", "b").where("a <> b").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour goes to the smallest one
        down = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, goes to the smallest
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = hung.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.select("id").join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")

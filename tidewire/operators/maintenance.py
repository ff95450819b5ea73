"""Archive maintenance: change sets that a separate call may write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from . import ingest, items
from . import stories as st
from .shared import checkpoint_dir

# Fixed values
DUPLICATE_CHARS, DUPLICATE_GAP_MS = 32, 72 * scores.HOUR_MS
RECLUSTER_K, RECLUSTER_MS = 10, 7 * 24 * scores.HOUR_MS
BACKFILL_DAYS, BACKFILL_ROWS, VECTOR_DAYS = 7, 250, 180


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``after`` of which a field differs from ``before``, nulls told apart."""
    old = before.select(F.col(key), *[F.col(f).alias(f"_old_{f}") for f in fields])
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_old_{f}")) for f in fields])
    return after.join(old, key).where(differs).select(*after.columns)


def clean_archive(stories: DataFrame, removed_sources: list[str]) -> DataFrame:
    """(id, action, description, sources, impact) of stories that cleaning changes or, without corroboration, deletes.

    Sources are normalised first, so a link to the story itself, or a repeated one, corroborates nothing.
    """
    listed, _ = items.normal_sources(F.col("url"), F.col("sources"))
    rows = stories.withColumns({"_description": text.clean_description(F.col("description")), "_sources": listed})
    bad = F.col("source").isin(removed_sources) | text.reject_reason(F.col("source"), F.col("url"), F.col("title"), F.col("_description")).isNotNull()
    rows = rows.withColumns({"_bad": bad, "_impact": scores.impact(F.col("tier"), F.col("independent"))})
    differs = ~F.col("_description").eqNullSafe(F.col("description")) | ~F.col("_sources").eqNullSafe(F.coalesce("sources", F.array().cast(items.SOURCES))) | ~F.col("_impact").eqNullSafe(F.col("impact"))
    action = F.when((F.size("_sources") == 0) & F.col("_bad"), "delete").when(differs, "update")
    return rows.withColumn("action", action).where("action is not null").select("id", "action", F.col("_description").alias("description"), F.col("_sources").alias("sources"), F.col("_impact").alias("impact"))


def collapse_duplicates(stories: DataFrame, bookmarked: DataFrame, gap_ms: int = DUPLICATE_GAP_MS) -> DataFrame:
    """(id, winner) of stories that repeat another: equal titles (32 or more) at one place, in sessions of 72 hours.

    A group counts if it has two different addresses and no bookmarked member; the best tier, then the most reports,
    then the longest description wins.
    """
    place = F.coalesce(F.lower("location_name"), F.concat_ws(",", scores.fixed_2dp(F.col("lat")).cast("string"), scores.fixed_2dp(F.col("lon")).cast("string")))
    rows = stories.withColumns({"fp": text.fingerprint(F.col("title")), "place": place}).where(F.length("fp") >= DUPLICATE_CHARS)
    rows = ingest.sessions(rows.withColumn("seq", F.col("id")), ["fp", "place"], F.col("at_ms"), gap_ms)
    rows = rows.join(bookmarked.select(F.col("id"), F.lit(True).alias("_mark")), "id", "left")
    group = ["fp", "place", "session"]
    fits = rows.groupBy(*group).agg(F.count_distinct("url").alias("_urls"), F.coalesce(F.max("_mark"), F.lit(False)).alias("_held")).where("_urls >= 2 and not _held").select(*group)
    best = Window.partitionBy(*group).orderBy("tier", F.col("event_count").desc(), F.length("description").desc(), "id")
    ranked = rows.join(fits, group).withColumn("_r", F.row_number().over(best)).withColumn("winner", F.first("id").over(best))
    return ranked.where("_r > 1").select("id", "winner")


def regeocode(stories: DataFrame, located: DataFrame) -> DataFrame:
    """(id, action): update where a new location differs, delete where there is none any more, else nothing."""
    new = located.select("id", *[F.col(c).alias(f"n_{c}") for c in ("lat", "lon", "location_name")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in ("lat", "lon", "location_name")])
    action = F.when(F.col("n_lat").isNull(), "delete").when(~same, "update")
    return stories.join(new, "id").withColumn("action", action).where("action is not null").select("id", "action", "n_lat", "n_lon", "n_location_name")


def approved(changes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Changes that the manifest (id, action) approves."""
    return changes.join(manifest.select("id", "action").distinct(), ["id", "action"])


def without_vector(stories: DataFrame) -> DataFrame:
    return stories.where("embedding is null")


def expired_vectors(stories: DataFrame, now_ms: int, days: int = VECTOR_DAYS) -> DataFrame:
    return stories.where(F.col("embedding").isNotNull() & (F.col("at_ms") < now_ms - days * 24 * scores.HOUR_MS))


def image_backfill(stories: DataFrame, now_ms: int) -> DataFrame:
    """The 250 largest stories of the last week that have no picture and were not checked in that time."""
    week = now_ms - BACKFILL_DAYS * 24 * scores.HOUR_MS
    open_ = stories.where(F.col("image").isNull() & (F.col("at_ms") >= week) & (F.col("checked_ms").isNull() | (F.col("checked_ms") < week)))
    return open_.orderBy(F.col("event_count").desc(), F.col("at_ms").desc(), "id").limit(BACKFILL_ROWS)


def recluster_pairs(stories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(a, b, order): stories (id bigint, .. as ``evidence``, embedding) of which the newer, a, may absorb b.

    Of the ten nearest stories of each those at most seven days apart, near enough in meaning and without a
    contradiction.  ``order`` ranks the keepers of a row: newest first, ids settle ties.
    """
    checkpoint_dir(stories.sparkSession)
    e = st.evidence(st.named_countries(st.precise(stories, gazetteer), gazetteer)).checkpoint()
    met = st.knn(e.select("id", "embedding"), e.select("id", "embedding"), RECLUSTER_K).join(e.alias("a"), F.col("query_id") == F.col("a.id")).join(e.alias("b"), F.col("neighbour_id") == F.col("b.id"))
    near = st.geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= st.MERGE_KM
    fits = st.passes(F.col("similarity"), F.coalesce(F.col("a.precise") & F.col("b.precise") & near, F.lit(False))) & (F.abs(F.col("a.at_ms") - F.col("b.at_ms")) <= RECLUSTER_MS) & ~st.conflicts("a", "b")
    newer = F.struct(-F.col("a.at_ms"), F.col("a.id")) < F.struct(-F.col("b.at_ms"), F.col("b.id"))
    return met.where(fits & newer).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.struct((-F.col("a.at_ms")).alias("age"), F.col("a.id").alias("id")).alias("order"))


def recluster_stories(stories: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(absorbed, by) of stored stories, newest first: each goes to the newest story that may absorb it and is not absorbed."""
    return recluster(recluster_pairs(stories, gazetteer), F.col("order"))


def recluster(pairs: DataFrame, order: Column) -> DataFrame:
    """(absorbed, by): of linked pairs (a, b) each row goes to the first neighbour before it that is not absorbed itself.

    ``order`` ranks a pair's keeper; a row that keeps others is never absorbed in the same run.  Each round absorbs
    the rows whose first neighbour left is settled and free, and takes absorbed rows out of the others' neighbours, so
    rounds grow with the longest chain of rows that wait for each other.  Links that lead in a circle raise.
    """
    checkpoint_dir(pairs.sparkSession)
    waiting = pairs.select("a", "b", order.alias("_order")).where("a <> b").checkpoint()
    done = []
    while waiting.limit(1).count():
        first = waiting.groupBy("b").agg(F.min(F.struct("_order", "a")).alias("_first")).select(F.col("b").alias("absorbed"), F.col("_first.a").alias("by"))
        new = first.join(waiting.select(F.col("b").alias("by")).distinct(), "by", "left_anti").select("absorbed", "by").checkpoint()
        if not new.limit(1).count():
            raise ValueError("links lead in a circle")
        gone = new.select("absorbed")
        waiting = waiting.join(gone, F.col("b") == F.col("absorbed"), "left_anti").join(gone, F.col("a") == F.col("absorbed"), "left_anti").checkpoint()
        done.append(new)
        if len(done) == 16:
            done = [reduce(DataFrame.union, done).checkpoint()]
    return reduce(DataFrame.union, done) if done else waiting.select(F.col("b").alias("absorbed"), F.col("a").alias("by"))

"""Ingestion: preparing incoming items, history, caps, source health and circuits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .shared import sized

# Fixed values
FINGERPRINT_CHARS = 24
NOVELTY_DEFAULT, NOVELTY_LEAST, EMERGENCY = 20, 8, 1.5


def longest_of(items: DataFrame, key: str) -> DataFrame:
    """Of each key the item with the longest description, the earliest of equals, at the place of the key's first item."""
    longest = Window.partitionBy(key).orderBy(F.length("description").desc(), F.col("seq"))
    ranked = items.withColumn("_r", F.row_number().over(longest)).withColumn("_first", F.min("seq").over(Window.partitionBy(key)))
    return ranked.where("_r = 1").withColumn("seq", F.col("_first")).drop("_r", "_first")


def prepare(items: DataFrame) -> DataFrame:
    """Clean items (seq, source, url, title, description) and drop repeats.

    First within a source, by title and description where the title tells enough, else by address; then across
    sources by report identity.  Items without address or title go.
    """
    clean = items.withColumns({"url": text.canonical_url(F.col("url")), "title": text.clean_title(F.col("title")), "description": text.clean_description(F.col("description"))}).where("url <> '' and title <> ''")
    mark = text.fingerprint(F.col("title"))
    told = (F.length(mark) >= FINGERPRINT_CHARS) & (F.col("description") != "")
    key = F.when(told, F.concat_ws("\x00", "source", mark, text.fingerprint(F.col("description")))).otherwise(F.concat_ws("\x00", "source", "url"))
    first = longest_of(clean.withColumn("_key", key), "_key").drop("_key")
    return longest_of(first.withColumn("_key", text.report_identity(F.col("url"))), "_key").drop("_key")


def quality_gate(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted items, and rejections counted by reason."""
    judged = items.withColumn("reject_reason", text.reject_reason(F.col("source"), F.col("url"), F.col("title"), F.col("description")))
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null").groupBy("reject_reason").count()


def unseen(items: DataFrame, stories: DataFrame) -> DataFrame:
    """Items whose address no story has, neither as its own nor among its sources (url, sources: array<struct<url>>)."""
    known = stories.select("url").union(stories.select(F.explode("sources.url").alias("url"))).where("url is not null").distinct()
    return items.join(known, "url", "left_anti")


def novelty_cap(items: DataFrame, limits: DataFrame | None = None, multiplier: float = 1.0) -> DataFrame:
    """The first items of each source in order of arrival: ceil(limit x multiplier) of them.

    ``limits`` has (source, max_new); a source's limit is 8 at least and 20 where nothing is known.
    """
    base = F.lit(NOVELTY_DEFAULT)
    if limits is not None:
        items = items.join(limits.select("source", F.greatest(F.lit(NOVELTY_LEAST), F.coalesce(F.nullif("max_new", F.lit(0)), base)).alias("_limit")), "source", "left")
        base = F.coalesce("_limit", base)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return items.withColumn("_rank", rank).where(F.col("_rank") <= F.ceil(base * multiplier)).drop("_rank", "_limit")


def capped_counts(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """How many items of each source the cap left out."""
    return items.join(accepted.select("seq"), "seq", "left_anti").groupBy("source").agg(F.count("*").alias("capped"))


def recent_items(items: DataFrame, now_ms: int, tier: str, limit: int | None = None) -> DataFrame:
    """The first items of each feed that are undated, or neither too old for the tier nor over five minutes ahead."""
    ms = F.col("published_ms")
    fits = ms.isNull() | ms.between(now_ms - scores.POLL_AGE_MS[tier], now_ms + scores.FUTURE_SKEW_MS)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return items.where(fits).withColumn("_r", rank).where(F.col("_r") <= (limit or scores.POLL_ITEMS[tier])).drop("_r")


def open_circuits(attempts: DataFrame, now_ms: int, needed: int = 3) -> DataFrame:
    """(source_type, source_name) of sources whose newest three attempts failed and whose cooldown is not over.

    ``attempts`` has (source_type, source_name, outcome, error_code, at_ms, seq).  Feeds are also judged without
    their fallbacks, under the type rss-primary: attempts skipped for a cooldown don't count there, and a fallback
    that worked is a failure of the primary.
    """
    primary = attempts.where("source_type = 'rss' and coalesce(error_code, '') <> 'primary_cooldown'")
    fell = F.coalesce(F.col("error_code").startswith("fallback_"), F.lit(False))
    primary = primary.withColumns({"source_type": F.lit("rss-primary"), "outcome": F.when(fell, "provider_error").otherwise(F.col("outcome")), "error_code": F.when(fell, F.expr("substring(error_code, 10)")).otherwise(F.col("error_code"))})
    newest = Window.partitionBy("source_type", "source_name").orderBy(F.col("at_ms").desc(), F.col("seq"))
    last = attempts.unionByName(primary).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= needed)
    judged = last.groupBy("source_type", "source_name").agg(F.count("*").alias("n"), F.every(F.col("outcome").isin(scores.FAILURES)).alias("failed"), F.max(scores.cooldown_ms(F.col("error_code"))).alias("cooldown"), F.max("at_ms").alias("latest"))
    return judged.where((F.col("n") == needed) & F.col("failed") & (F.col("cooldown") > 0) & (F.col("latest") + F.col("cooldown") > now_ms)).select("source_type", "source_name")


def without_open(items: DataFrame, circuits: DataFrame) -> DataFrame:
    """Items (source_type, source_name, ..) of sources whose circuit is not open."""
    return items.join(circuits.select("source_type", "source_name").distinct(), ["source_type", "source_name"], "left_anti")


def run_metrics(raw: DataFrame, prepared: DataFrame, accepted: DataFrame, new: DataFrame) -> DataFrame:
    """One row of an ingestion run's counts."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(raw, "raw").crossJoin(count(prepared, "prepared")).crossJoin(count(accepted, "accepted")).crossJoin(count(new, "fresh"))


def source_tiers(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items with their source's credibility tier, 3 where it is unknown."""
    return items.join(sized(registry.select(F.col("name").alias("source"), F.col("credibility_tier").alias("_t"))), "source", "left").withColumn("tier", F.coalesce("_t", F.lit(3))).drop("_t")


def rate_windows(hits: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Requests by key and window of so many seconds, and whether they are over the limit."""
    return hits.groupBy(key, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("hits")).select(key, F.col("w.start").alias("window_start"), "hits", (F.col("hits") > limit).alias("limited"))


def first_hit_windows(hits: DataFrame, key: str, at: str, ms: int, limit: int) -> DataFrame:
    """(key, start_ms, hits, limited): windows of so many milliseconds that begin with the first hit after the last one.

    ``key`` is a bigint and ``at`` milliseconds.  A window's place depends on all before it, so rows stream by sorted
    by key and time, and a task holds one window's count.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[int] | None = None
        for frame in frames:
            done = []
            for k, t in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if now is not None and now[0] == k and t < now[1] + ms:
                    now[2] += 1
                    continue
                done += [] if now is None else [now]
                now = [k, t, 1]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], [key, "start_ms", "hits"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in now], [key, "start_ms", "hits"])

    ordered = hits.select(F.col(key).cast("bigint"), F.col(at).cast("bigint")).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = ordered.repartition(key).sortWithinPartitions(key, at).mapInArrow(run, f"`{key}` bigint, start_ms bigint, hits bigint")
    return rows.withColumn("limited", F.col("hits") > limit)


def sessions(rows: DataFrame, key: list[str], at_ms: Column, gap_ms: int) -> DataFrame:
    """Rows numbered by session: a new one begins where more than ``gap_ms`` passed since the row before."""
    w = Window.partitionBy(*key).orderBy(at_ms, "seq")
    starts = F.coalesce((at_ms - F.lag(at_ms).over(w) > gap_ms).cast("int"), F.lit(0))
    return rows.withColumn("_new", starts).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_patches(stories: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Stories with sparse patches applied: a field changes where its ``<field>_set`` is true, null values included."""
    fields = [c for c in stories.columns if f"{c}_set" in patches.columns]
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for f in fields for c in (f, f"{f}_set")])
    joined = stories.join(p, key, "left")
    new = {f: F.when(F.coalesce(F.col(f"_p_{f}_set"), F.lit(False)), F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in stories.columns])


def upsert(stories: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """``incoming`` rows, and those of ``stories`` whose key is not among them."""
    return stories.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)

"""Registration, tables, and the story view that stands for stored stories over the driver's events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The time of all requests: behind the last event.
NOW_MS = 1_706_745_600_000
HOUR_MS = scores.HOUR_MS


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL; without any, its docstring says why."""

    def put(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The same view in SQL; queries put it behind WITH.
STORIES = """stories AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
  CASE WHEN event_id % 3 = 0 THEN lpad(CAST(event_id - event_id % 6 AS VARCHAR), 12, '0') END AS original_id,
  coalesce(CASE WHEN event_id % 3 = 0 THEN lpad(CAST(event_id - event_id % 6 AS VARCHAR), 12, '0') END, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS canonical_id,
  CASE WHEN event_id % 50 <> 7 THEN CAST((user_id * 37) % 170 - 85 AS DOUBLE) END AS lat,
  CAST((event_id * 53) % 360 - 180 AS DOUBLE) AS lon,
  CASE event_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'gnews' ELSE 'social' END AS source_type,
  CASE WHEN event_id % 3 = 2 THEN 'acct' || CAST(user_id % 7 AS VARCHAR) || (CASE user_id % 4 WHEN 0 THEN ' (reddit)' WHEN 1 THEN ' (X)' WHEN 2 THEN ' telegram' ELSE ' other' END)
    ELSE 'src' || CAST(user_id % 20 AS VARCHAR) END AS source,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS category,
  (epoch_us(ts) // 1000) AS published_ms, (epoch_us(ts) // 1000) + (event_id % 5) * 3600000 AS latest_ms,
  CAST(1 + event_id % 3 AS INTEGER) AS tier, 1 + event_id % 6 AS volume,
  3.5 - CAST(1 + event_id % 3 AS DOUBLE) + CAST(event_id % 6 AS DOUBLE) * (5 - CAST(1 + event_id % 3 AS DOUBLE)) AS impact,
  upper(event_type) || ' report of user ' || CAST(user_id AS VARCHAR) AS title, props AS description,
  'zone ' || CAST(user_id % 9 AS VARCHAR) AS location_name FROM events)"""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    padded = lambda c: F.lpad(c.cast("string"), 12, "0")
    account = F.when(u % 4 == 0, " (reddit)").when(u % 4 == 1, " (X)").when(u % 4 == 2, " telegram").otherwise(" other")
    ms = scores.epoch_ms(F.col("ts"))
    tier, volume = (1 + i % 3).cast("int"), 1 + i % 6
    return e.select(
        padded(i).alias("id"),
        F.when(i % 3 == 0, padded(i - i % 6)).alias("original_id"),
        F.when(i % 50 != 7, ((u * 37) % 170 - 85).cast("double")).alias("lat"),
        ((i * 53) % 360 - 180).cast("double").alias("lon"),
        F.when(i % 3 == 0, "rss").when(i % 3 == 1, "gnews").otherwise("social").alias("source_type"),
        F.when(i % 3 == 2, F.concat(F.lit("acct"), (u % 7).cast("string"), account)).otherwise(F.concat(F.lit("src"), (u % 20).cast("string"))).alias("source"),
        F.when(i % 11 != 0, F.col("event_type")).alias("category"),
        ms.alias("published_ms"),
        (ms + (i % 5) * 3600000).alias("latest_ms"),
        tier.alias("tier"),
        volume.alias("volume"),
        scores.impact(tier, volume).alias("impact"),
        F.concat(F.upper("event_type"), F.lit(" report of user "), u.cast("string")).alias("title"),
        F.col("props").alias("description"),
        F.concat(F.lit("zone "), (u % 9).cast("string")).alias("location_name"),
    )

"""Queries over loose records, preferences, pictures and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, records, scores
from ..operators import feed, ingest, items
from ..operators import stories as st
from .base import NOW_MS, STORIES, query, stories, table


@query("SELECT event_id, 'k ' || regexp_extract(props, '[0-9]+') || CASE event_id % 4 WHEN 0 THEN ' list' WHEN 1 THEN '' WHEN 2 THEN ' keyed' ELSE ' plain' END AS text FROM events WHERE event_id % 4 <> 1 UNION ALL SELECT event_id, '' FROM events WHERE event_id % 4 = 1")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of lists, objects, scalars and junk."""
    i, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0)
    raw = F.when(i % 4 == 0, F.concat(F.lit('["k", "'), k, F.lit('", "", "list"]'))).when(i % 4 == 1, F.lit("{broken")).when(i % 4 == 2, F.concat(F.lit('{"#text": "", "text": "k '), k, F.lit(' keyed"}'))).otherwise(F.concat(F.lit('"k '), k, F.lit(' plain"')))
    return table(spark, sf_dir, "events").select("event_id", records.coerced_text(raw).alias("text"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def type_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which a field has the wrong type."""
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": "text"}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").where(records.wrong_type(raw, "$.k", "BIGINT")).select("event_id")


@query("SELECT c_custkey, 'n' || CAST(c_custkey AS VARCHAR) AS name, c_custkey * 36 + 10 AS number FROM customer UNION ALL SELECT c_custkey, 'z', 35 FROM customer")
def packed_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed in text, numbers in base 36."""
    key = F.col("c_custkey")
    raw = F.concat(F.lit("n"), key.cast("string"), F.lit(","), F.lower(F.conv((key * 36 + 10).cast("string"), 10, 36)), F.lit("|z,z|"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(records.packed_rows(raw)))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'rss,x' WHEN 1 THEN 'x' ELSE '' END AS sources, CAST(least(999, greatest(1, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE c_custkey * 2 - 50 END)) AS INTEGER) AS volume FROM customer")
def clean_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """allowed values once each, numbers within bounds."""
    key = F.col("c_custkey")
    chosen = F.when(key % 3 == 0, F.array(F.lit("rss"), F.lit("bad"), F.lit("x"), F.lit("rss"))).when(key % 3 == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("other")))
    volume = F.when(key % 5 == 0, "junk").otherwise((key * 2 - 50).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(records.chosen_of(chosen, ["rss", "x"]), ",").alias("sources"), records.clamped(volume, 1, 999).alias("volume"))


@query("SELECT p_partkey, p_size BETWEEN 0 AND 16 AND p_partkey % 1000 <= pow(2, p_size) - 1 AS valid FROM part")
def tile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map tiles within their zoom's range."""
    x = F.col("p_partkey") % 1000
    return table(spark, sf_dir, "part").select("p_partkey", geo.valid_tile(F.col("p_size"), x, F.lit(0)).alias("valid"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size * 40 >= 1024 ELSE p_size * 20 * (p_partkey % 900) >= 90000 AND least(p_size * 20, p_partkey % 900) >= 120 AND greatest(p_size * 20, p_partkey % 900) <= least(p_size * 20, p_partkey % 900) * 5 END AS good,
  CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'webp' END AS kind FROM part""")
def picture_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures large enough, and their kinds by their first bytes."""
    i, s = F.col("p_partkey"), F.col("p_size")
    width = F.when(i % 7 != 0, s * 20)
    head = F.when(i % 5 == 0, "89504E470D0A").when(i % 5 == 1, "474946383961").when(i % 5 == 2, "FFD8FFE0").when(i % 5 == 3, "524946460000000057454250").otherwise("00")
    return table(spark, sf_dir, "part").select("p_partkey", records.good_image(width, i % 900, s * 40).alias("good"), records.image_kind(F.unhex(head)).alias("kind"))


@query(f"WITH {STORIES} SELECT id, CASE WHEN contains(lower(source), 'reddit') THEN 'reddit' WHEN contains(lower(source), '(x)') THEN 'x' WHEN contains(lower(source), 'telegram') THEN 'telegram' ELSE 'feed' END AS style, CASE category WHEN 'error' THEN 'red' ELSE 'grey' END AS colour, CASE tier WHEN 1 THEN 'established' WHEN 2 THEN 'regional' ELSE 'unverified' END AS label FROM stories")
def display_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display classes, colours and labels."""
    s = stories(spark, sf_dir)
    return s.select("id", records.source_style(F.col("source")).alias("style"), records.lookup(F.col("category"), {"error": "red"}, "grey").alias("colour"), records.lookup(F.col("tier"), records.TIER_LABELS, "unverified").alias("label"))


@query("SELECT s_suppkey, CAST(least(i, n) AS BIGINT) AS i, round(i * 1.0 * (s_suppkey % 50) / n, 6) AS x FROM (SELECT s_suppkey, n, unnest(range(0, n + 1)) AS i FROM (SELECT s_suppkey, CAST(greatest(1, ceil((s_suppkey % 50) / 7.0)) AS BIGINT) AS n FROM supplier))")
def tessellated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut into steps of bounded length."""
    x = (F.col("s_suppkey") % 50).cast("double")
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(records.tessellated(zero, zero, x, zero, 7.0)).alias("i", "p"))
    return rows.select("s_suppkey", F.col("i").cast("bigint").alias("i"), F.round("p.x", 6).alias("x"))


@query("SELECT printf('%.1f', floor(s_acctbal * 10 + 0.5) / 10) AS altitude, printf('%d', CAST(floor(s_acctbal + 0.5) AS BIGINT)) AS speed, s_suppkey FROM supplier")
def formatted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, with one decimal and with none."""
    altitude, speed = items.position_text(F.col("s_acctbal"), F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", altitude.alias("altitude"), speed.alias("speed"))


@query("SELECT o_orderkey, coalesce(nullif(o_custkey % 4, 0), 1) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def candidate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of candidates by a semi-join, zero counts as one."""
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return items.details(wanted, table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("n")), "o_orderkey", "n")


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.85 OR (list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.6 AND a.label = b.label) AS passes FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of stated pairs, one side's vectors read from text."""
    v = table(spark, sf_dir, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b_id"), st.parse_vector(F.to_json("embedding")).alias("b_vec"), F.col("label").alias("b_label"))
    sim = st.dot(F.col("embedding"), F.col("b_vec"))
    return v.join(b, "vec_id").select(F.col("vec_id").alias("a_id"), "b_id", F.round(sim, 6).alias("similarity"), st.passes(sim, F.col("label") == F.col("b_label")).alias("passes"))


@query("SELECT lang, 'missing' AS side FROM (SELECT DISTINCT lang FROM documents EXCEPT SELECT DISTINCT lang FROM documents WHERE lang <> 'fr') UNION ALL SELECT lang, 'extra' FROM (SELECT 'xx' AS lang)")
def stratum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: strata that are missing, and those that are too many, by set differences both ways."""
    want = table(spark, sf_dir, "documents").select("lang").distinct()
    got = want.where("lang <> 'fr'").union(spark.createDataFrame([("xx",)], "lang string"))
    return items.coverage(want, got)


@query("SELECT 'guest' AS tier, 10 AS rows UNION ALL SELECT 'free', 50 UNION ALL SELECT 'paid', 250")
def entitled_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tier at a close zoom."""
    return spark.createDataFrame([(t, feed.effective_limit(None, t, 7.0, False)) for t in feed.TIER_ROWS], "tier string, rows int")


@query("SELECT event_type AS dedup_key, count(*) AS times, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, max(value) AS worst FROM events WHERE value > 20 GROUP BY 1")
def incident_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents counted by key, first and last seen."""
    e = table(spark, sf_dir, "events").where("value > 20")
    return items.incidents(e, F.col("event_type"), scores.epoch_ms(F.col("ts")), F.col("value"))


@query("SELECT e.user_id, count(*) AS n FROM events e WHERE e.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 60) GROUP BY 1")
def guarded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of which no member is held, by a flag and an anti-join."""
    e = table(spark, sf_dir, "events")
    held = e.where("event_type = 'error' and value > 60").select("user_id").distinct()
    return e.where("event_type <> 'error'").join(held, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {STORIES}, s AS (SELECT id, source, published_ms FROM stories WHERE published_ms >= {records.since_ms(NOW_MS, 7 * 86_400_000)}) SELECT source, count(*) AS n FROM s GROUP BY source")
def aligned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: a range aligned to the minute."""
    s = stories(spark, sf_dir).where(F.col("published_ms") >= records.since_ms(NOW_MS, 7 * 86_400_000))
    return s.groupBy("source").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id DESC) AS r FROM documents) SELECT doc_id, source FROM q WHERE r = 1")
def best_image_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each story the target of the best priority, then the newest."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 1")
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pick among what was not seen yet, by a hash instead of chance so that it can be repeated."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return items.pick(d, d.where("doc_id % 10 = 0"), "doc_id")


@query("SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages) GROUP BY host")
def host_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt by host, so that each host is worked off by one task at a time."""
    from ..operators import corroboration

    p = table(spark, sf_dir, "pages").withColumn("host", corroboration.host(F.col("url")))
    return p.repartition("host").groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'http_503' WHEN doc_id % 3 = 1 THEN 'timeout' ELSE 'provider_failure' END AS code, CASE WHEN doc_id % 2 = 0 THEN 'fast' WHEN lang = 'fr' THEN 'slow' ELSE 'normal' END AS tier FROM documents")
def source_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe error codes and poll tiers."""
    i = F.col("doc_id")
    code = scores.error_code(F.when(i % 3 == 0, F.lit(503)), F.when(i % 3 == 1, F.lit("Request timed out")).otherwise(F.lit("?")))
    tier = scores.poll_tier(F.when(i % 2 == 0, "SCMP").otherwise(F.col("source")), F.when(F.col("lang") == "fr", "health").otherwise("world"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), tier.alias("tier"))


@query("SELECT source, CAST(sum(CASE WHEN r > 12 THEN 1 ELSE 0 END) AS BIGINT) AS over_limit FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source")
def normal_tier_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the normal tier's item limit leaves out."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), F.lit(None).cast("bigint").alias("published_ms"))
    kept = ingest.recent_items(d, NOW_MS, "normal").groupBy("source").agg(F.count("*").alias("k"))
    return d.groupBy("source").agg(F.count("*").alias("n")).join(kept, "source").select("source", (F.col("n") - F.col("k")).alias("over_limit"))

"""Story queries: evidence, joins, components, maintenance, geocoding and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scores, text
from ..operators import articles, geocode, items, maintenance, resolution
from ..operators import stories as st
from ..operators.shared import new_folder, shuffled
from ..sources import feeds, sinks
from ..streaming import jobs

from .base import HOUR_MS, NOW_MS, STORIES, query, stories, table
from .ingest_queries import FP, TITLE

FAR = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def _haversine(a: str, b: str) -> str:
    inner = f"(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))"
    return FAR.format(a=inner)


KNN = """WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM s)"""


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return st.knn(v.where("id % 100 = 0"), v, k)


@query(KNN + " SELECT query_id, neighbour_id, similarity, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 12")
def knn_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve nearest vectors of each query (every hundredth row), against all rows."""
    return _knn(spark, sf_dir, st.TOP_K).withColumn("rank", F.col("rank").cast("bigint"))


@query(KNN + """, k AS (SELECT *, count(*) FILTER (rank <= 12) OVER (PARTITION BY query_id) AS page, count(*) FILTER (rank <= 12 AND neighbour_id % 7 = 0) OVER (PARTITION BY query_id) AS hits FROM r WHERE rank <= 50)
  SELECT query_id, neighbour_id FROM k WHERE rank <= 12 OR (page = 12 AND hits = 0)""")
def knn_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty candidates where none of the first twelve is eligible."""
    return st.expanded(_knn(spark, sf_dir, st.EXPANDED_K), F.col("neighbour_id") % 7 == 0).select("query_id", "neighbour_id")


POINTS = """pts AS (SELECT event_id AS id, CAST((user_id * 37 + event_id * 3) % 170 - 85 AS DOUBLE) AS lat, CAST((event_id * 53) % 360 - 180 AS DOUBLE) AS lon FROM events)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), ((F.col("user_id") * 37 + F.col("event_id") * 3) % 170 - 85).cast("double").alias("lat"), ((F.col("event_id") * 53) % 360 - 180).cast("double").alias("lon"))


@query(f"WITH {POINTS} SELECT a.id AS a_id, b.id AS b_id, round({_haversine('a.', 'b.')}, 6) AS km FROM pts a JOIN pts b ON a.id < b.id AND {_haversine('a.', 'b.')} <= 50")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points within fifty kilometres, by places and grid cells."""
    p = _points(spark, sf_dir)
    return st.within_km(p, p, 50.0, digits=6).where("a_id < b_id")


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000) <= 3600000")
def time_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events at most an hour apart, by time buckets."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scores.epoch_ms(F.col("ts")).alias("at_ms"), "user_id")
    return st.within_time(e, e, ["user_id"], HOUR_MS).where("a_id < b_id").select("a_id", "b_id")


TITLES = f"t AS (SELECT doc_id, {FP.format(TITLE)} AS fp FROM documents)"


@query(f"WITH {TITLES} SELECT a.doc_id AS seq, b.doc_id AS story FROM t a JOIN t b ON a.fp = b.fp WHERE length(a.fp) >= 24 AND a.doc_id % 2 = 1 AND b.doc_id % 2 = 0")
def exact_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming items and stories with equal titles."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.clean_title(F.substring_index("text", "\n", 1)).alias("title"))
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "title", F.lit(NOW_MS).alias("published_ms"))
    return st.exact_candidates(d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "seq"), old, NOW_MS)


PAIRS = """p AS (SELECT a.event_id AS id, CAST(1 + a.event_id % 3 AS INTEGER) AS t1, CAST(1 + a.user_id % 3 AS INTEGER) AS t2, epoch_us(a.ts) // 1000 AS m1, epoch_us(a.ts) // 1000 + (a.event_id % 40) * 1000000 - 5000000 AS m2, a.event_id % 90 AS n1, a.user_id % 100 AS n2 FROM events a)"""


@query(f"""WITH {PAIRS} SELECT id, CASE WHEN t2 < t1 THEN true WHEN t2 = t1 THEN m2 > m1 OR (m2 = m1 AND n2 > n1) ELSE t2 = t1 + 1 AND m2 > m1 + 900000 END AS title_wins,
  n2 > 0 AND (CASE WHEN t2 < t1 OR n1 = 0 THEN true WHEN t2 = t1 THEN (m2 > m1 + 21600000 AND n2 >= n1 * 0.7) OR n2 > n1 ELSE t2 = t1 + 1 AND m2 > m1 + 21600000 AND n2 >= n1 END) AS description_wins,
  CASE WHEN n1 = 0 THEN true ELSE m2 >= m1 + 43200000 AND {NOW_MS} >= m1 + 21600000 END AS image_wins FROM p""")
def content_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 V7: whether an incoming title, description and picture replace a story's."""
    i, u, m = F.col("event_id"), F.col("user_id"), scores.epoch_ms(F.col("ts"))
    e = table(spark, sf_dir, "events").select(i.alias("id"), (1 + i % 3).alias("t1"), (1 + u % 3).alias("t2"), m.alias("m1"), (m + (i % 40) * 1000000 - 5000000).alias("m2"), (i % 90).alias("n1"), (u % 100).alias("n2"))
    c = [F.col(x) for x in ("t1", "m1", "n1", "t2", "m2", "n2")]
    return e.select("id", st.title_wins(*c).alias("title_wins"), st.description_wins(*c).alias("description_wins"), st.image_wins(F.col("n1") == 0, F.col("m1"), F.col("m1"), F.col("m2"), F.lit(NOW_MS)).alias("image_wins"))


LINKS = "links AS (SELECT event_id AS a, event_id - user_id AS b FROM events WHERE event_id % 4 = 1 AND event_id >= user_id)"


@query(f"""WITH RECURSIVE {LINKS}, sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk(id, node) AS (SELECT a, a FROM sym UNION SELECT w.id, sym.b FROM walk w JOIN sym ON w.node = sym.a),
  c AS (SELECT id, min(node) AS component FROM walk GROUP BY id) SELECT event_id AS id, coalesce(component, event_id) AS component FROM events LEFT JOIN c ON id = event_id""")
def story_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: components of linked reports."""
    e = table(spark, sf_dir, "events")
    links = e.where("event_id % 4 = 1 and event_id >= user_id").select(F.col("event_id").alias("a"), (F.col("event_id") - F.col("user_id")).alias("b"))
    return st.components(e.select(F.col("event_id").alias("id")), links)


@query()
def folded_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 V9: documents of equal titles folded in order of arrival; the fold depends on its own state, so tests hold it
    to plain Python."""
    i, none = F.col("doc_id"), F.lit(None).cast("bigint")
    title = text.clean_title(F.substring_index("text", "\n", 1))
    d = table(spark, sf_dir, "documents").select(i.alias("seq"), title.alias("title"), F.col("text").alias("description"), F.format_string("https://s.example/%d", i % 700).alias("url"), "source", (1 + i % 3).cast("int").alias("tier"), (i * 977 % 100 * HOUR_MS).alias("at_ms"))
    d = d.withColumns({"story": text.fingerprint(F.col("title")), "latest_ms": F.col("at_ms"), "source_type": F.lit("rss"), "image_ms": none, "image_updated_ms": none, "description_ms": none, "description_tier": F.lit(None).cast("int"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "location_name": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string")})
    again = F.row_number().over(Window.partitionBy("story", "url").orderBy("seq")) > 1
    return resolution.fold(d.withColumn("repeated", again), NOW_MS).select("story", "title", "tier", "published_ms", "description_ms", "title_seq")


@query()
def conflicting_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: pairs that contradict each other; the patterns use what DuckDB's lack, so rows only and tests."""
    s = stories(spark, sf_dir)
    n = F.col("id").cast("int")
    lead = F.when(n % 5 == 0, "Quiz: name the city").when(n % 5 == 1, "Men's football final won by hosts").when(n % 5 == 2, "Women's tennis final won by hosts").when(n % 5 == 3, "Fire at the hospital").otherwise("Explosion at the warehouse on Monday")
    s = s.withColumns({"title": F.concat(lead, F.lit(" - "), "title"), "url": F.concat(F.lit("https://a.example/"), "id"), "at_ms": F.col("latest_ms"), "precise": F.col("lat").isNotNull()})
    st.checkpoint_dir(spark)
    e = st.evidence(s).checkpoint()  # found once; the joins below read it seven times
    met = st.conflict_candidates(e).join(shuffled(e.alias("a")), F.col("a_id") == F.col("a.id")).join(shuffled(e.alias("b")), F.col("b_id") == F.col("b.id"))
    return met.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), st.conflicts("a", "b").alias("conflict"))


DUPLICATES = f"""WITH {STORIES}, g AS (SELECT *, published_ms - lag(published_ms) OVER (PARTITION BY title, location_name ORDER BY published_ms, id) > 86400000 AS fresh FROM stories WHERE length(title) >= 20),
  s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY title, location_name ORDER BY published_ms, id ROWS UNBOUNDED PRECEDING) AS session FROM g),
  f AS (SELECT title, location_name, session FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND NOT bool_or(CAST(id AS BIGINT) % 97 = 0)),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY title, location_name, session ORDER BY tier, volume DESC, length(description) DESC, id) AS k, first_value(id) OVER (PARTITION BY title, location_name, session ORDER BY tier, volume DESC, length(description) DESC, id) AS winner FROM s SEMI JOIN f USING (title, location_name, session))
  SELECT id, winner FROM r WHERE k > 1"""


@query(DUPLICATES)
def duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated stories in sessions of a day, bookmarked groups left alone."""
    s = stories(spark, sf_dir).where("length(title) >= 20").withColumns({"at_ms": F.col("published_ms"), "event_count": F.col("volume"), "url": F.col("id"), "title": F.rpad("title", 40, "x")})
    return maintenance.collapse_duplicates(s, s.where("cast(id as bigint) % 97 = 0").select("id"), 24 * HOUR_MS)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderstatus <> 'X') OR o_orderkey % 10 = 0")
def maintenance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: only the rows that a rewrite changes, nulls told apart."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.select("id", F.when(F.col("id") % 3 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 10 != 0, F.col("price")).alias("price"))
    return maintenance.changed(o, new, "id", ["status", "price"])


@query()
def archive_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning changes or deletes; the fold over lines is beyond SQL, so rows only and tests."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    s = d.select(i.cast("string").alias("id"), "source", F.lit("https://a.example/x").alias("url"), text.clean_title(F.substring_index("text", "\n", 1)).alias("title"), F.col("text").alias("description"), F.lit(None).cast(items.SOURCES).alias("sources"), (1 + i % 3).alias("tier"), F.lit(1).alias("independent"), F.lit(1.5).alias("impact"))
    return maintenance.clean_archive(s, ["src3"])


@query(f"""WITH {STORIES}, n AS (SELECT id, CASE WHEN tier = 1 THEN NULL WHEN tier = 2 THEN lat + 1 ELSE lat END AS n_lat, lon AS n_lon, location_name AS n_location_name, lat FROM stories),
  c AS (SELECT *, CASE WHEN n_lat IS NULL THEN 'delete' WHEN n_lat IS DISTINCT FROM lat THEN 'update' END AS action FROM n) SELECT id, action FROM c WHERE (action = 'update' AND CAST(id AS BIGINT) % 2 = 0) OR (action = 'delete' AND CAST(id AS BIGINT) % 5 = 0)""")
def regeocode_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved changes of new locations."""
    s = stories(spark, sf_dir)
    new = s.select("id", F.when(F.col("tier") == 2, F.col("lat") + 1).when(F.col("tier") == 3, F.col("lat")).alias("lat"), "lon", "location_name")
    n = F.col("id").cast("bigint")
    manifest = s.where(n % 2 == 0).select("id", F.lit("update").alias("action")).union(s.where(n % 5 == 0).select("id", F.lit("delete").alias("action")))
    return maintenance.approved(maintenance.regeocode(s, new), manifest).select("id", "action")


@query(f"WITH {STORIES} SELECT id FROM stories WHERE tier = 1 AND published_ms >= {NOW_MS - 7 * 24 * HOUR_MS} AND (volume % 2 = 0 OR published_ms - 691200000 < {NOW_MS - 7 * 24 * HOUR_MS}) ORDER BY volume DESC, published_ms DESC, id LIMIT 250")
def image_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the largest stories of the week without a picture."""
    s = stories(spark, sf_dir).withColumns({"image": F.when(F.col("tier") != 1, "x"), "at_ms": F.col("published_ms"), "event_count": F.col("volume"), "checked_ms": F.when(F.col("volume") % 2 == 1, F.col("published_ms") - 691200000)})
    return maintenance.image_backfill(s, NOW_MS).select("id")


@query(f"SELECT vec_id, vec_id % 3 = 0 AS expired FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 1")
def vector_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 M6: vectors that expire, and rows that lack one."""
    v = table(spark, sf_dir, "embeddings")
    old = F.when(F.col("vec_id") % 3 == 0, NOW_MS - 200 * 24 * HOUR_MS).otherwise(NOW_MS)
    gone = maintenance.expired_vectors(v.withColumn("at_ms", old), NOW_MS).select("vec_id", F.lit(True).alias("expired"))
    lacking = maintenance.without_vector(v.withColumn("embedding", F.when(F.col("vec_id") % 5 != 1, F.col("embedding"))))
    return gone.union(lacking.where("vec_id % 3 <> 0").select("vec_id", F.lit(False)))


RECLUSTER = """WITH RECURSIVE p AS (SELECT event_id - 1 - event_id % 3 AS a, event_id AS b FROM events WHERE event_id % 4 <> 0 AND event_id > 3),
  step(b, absorbed) AS (SELECT event_id, false FROM events WHERE event_id NOT IN (SELECT b FROM p) UNION ALL SELECT p.b, NOT s.absorbed FROM step s JOIN p ON p.a = s.b)
  SELECT p.b AS absorbed, p.a AS "by" FROM p JOIN step s ON s.b = p.b WHERE s.absorbed"""


@query(RECLUSTER)
def recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: greedy absorption by neighbours that are not absorbed themselves; each row here has one neighbour before it."""
    e = table(spark, sf_dir, "events").where("event_id % 4 <> 0 and event_id > 3")
    p = e.select((F.col("event_id") - 1 - F.col("event_id") % 3).alias("a"), F.col("event_id").alias("b"))
    return maintenance.recluster(p, F.col("a"))


CASES = [(1, "Paris, Texas", "Paris, Texas", 1.0), (2, None, None, None), (3, "London", None, None), (4, None, "Rome", None), (5, "Berlin", "Bern", 700.0), (6, "Lagos", "lagos ", 90.0), (7, "Madrid", "Madrid", 3.0), (8, "Kiev", "Kyív", 1.0), (9, "USA", "America", 2.0), (10, "null", None, None)]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in c) + ")" for c in CASES)
_PLAIN = "CASE strip_accents(lower(trim({0}))) WHEN 'null' THEN NULL WHEN 'kiev' THEN 'kyiv' WHEN 'usa' THEN 'united states' WHEN 'america' THEN 'united states' ELSE strip_accents(lower(trim({0}))) END"
OUTCOME = "CASE WHEN want IS NULL AND got IS NULL THEN 'unmapped-correct' WHEN want IS NULL THEN 'false-pin' WHEN got IS NULL THEN 'miss' WHEN want <> got THEN 'wrong-place' WHEN km > 25 THEN 'wrong-coordinate' ELSE 'mapped-correct' END"


@query(f"WITH v(id, want, got, km) AS (VALUES {_VALUES}), c AS (SELECT {_PLAIN.format('want')} AS want, {_PLAIN.format('got')} AS got, km FROM v), o AS (SELECT {OUTCOME} AS outcome FROM c) SELECT outcome, count(*) AS n, round((SELECT avg(CASE WHEN outcome LIKE '%correct' THEN 1 ELSE 0 END) FROM o), 6) AS correct_share FROM o GROUP BY outcome")
def geocode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of located cases against what was expected, names by their aliases, and the share that is right."""
    c = spark.createDataFrame(CASES, "id int, want string, got string, km double")
    key = F.lit(None).cast("string")
    return scores.accuracy(c.select(scores.outcome(F.col("want"), F.col("got"), key, key, F.col("km"), F.lit(None).cast("double")).alias("outcome")))


_KEYS = ", ".join(f"('{k}', '{n}')" for k, n in sorted({(r[0], r[1].replace("'", "''")) for r in geocode.SEED}))
_DEMONYM = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in geocode.demonyms().items()) + r" ELSE regexp_replace(x, '(?:''s)?[.''-]*$', '') END"
PLACED = rf"""places(key, name) AS (VALUES {_KEYS}),
  t AS (SELECT doc_id, text || ' near ' || CASE doc_id % 4 WHEN 0 THEN 'Tokyo' WHEN 1 THEN 'New York' WHEN 2 THEN 'French soil' ELSE 'nowhere' END AS t FROM documents),
  docs AS (SELECT doc_id, ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\p{{L}}\p{{N}}''.-]+'), lambda x: x <> ''), lambda x: {_DEMONYM}), ' ') || ' ' AS t FROM t)"""


@query(f"WITH {PLACED} SELECT DISTINCT doc_id AS id, name FROM docs JOIN places ON contains(t, ' ' || key || ' ')")
def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place names in whole texts, by n-grams."""
    i = F.col("doc_id")
    place = F.when(i % 4 == 0, "Tokyo").when(i % 4 == 1, "New York").when(i % 4 == 2, "French soil").otherwise("nowhere")
    d = table(spark, sf_dir, "documents").select(i.alias("id"), F.concat("text", F.lit(" near "), place).alias("text"))
    return geocode.mentions(d, geocode.seed(spark)).select("id", "name").distinct()


_WORDS_SQL = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}''.-]+'), lambda x: x <> '')"


@query(f"""WITH i AS (SELECT {_WORDS_SQL.format('text')} AS w FROM benchmark),
  k AS (SELECT DISTINCT array_to_string(w[p + 1:p + n], ' ') AS key, n FROM i, (VALUES (1), (2), (3)) s(n), unnest(range(0, len(w) - n + 1)) AS u(p)),
  d AS (SELECT doc_id, {_WORDS_SQL.format('text')} AS w FROM documents),
  g AS (SELECT doc_id, n, array_to_string(w[p + 1:p + n], ' ') AS key FROM d, (VALUES (1), (2), (3)) s(n), unnest(range(0, len(w) - n + 1)) AS u(p))
  SELECT doc_id AS id, count(*) AS hits, count(DISTINCT key) AS keys, CAST(sum(g.n) AS BIGINT) AS words FROM g JOIN k USING (key, n) GROUP BY doc_id""")
def scanned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of keys, all runs of three words or fewer of ``benchmark``, found in whole ``documents`` by one automaton."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), geocode.words(F.col("text")).alias("w"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), geocode.words(F.col("text")).alias("w"))
    found = geocode.key_hits(docs, geocode.n_grams(items, 3).select("key"), 3)
    return found.groupBy("id").agg(F.count("*").alias("hits"), F.count_distinct("key").alias("keys"), F.sum("n").alias("words"))


@query("SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'Tokyo' WHEN 1 THEN 'Paris, Texas' WHEN 2 THEN 'Paris' WHEN 3 THEN 'Eiffel Tower' END AS name, CASE doc_id % 5 WHEN 0 THEN 'unique' WHEN 1 THEN 'hierarchy' WHEN 2 THEN 'dominant' WHEN 3 THEN 'landmark' END AS rule FROM documents WHERE doc_id % 5 <> 4")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts located by the cascade of rules."""
    i = F.col("doc_id")
    t = F.when(i % 5 == 0, "Quake felt in Tokyo").when(i % 5 == 1, "Storm in Paris, Texas").when(i % 5 == 2, "Strike in Paris").when(i % 5 == 3, "Crowd at the Eiffel Tower").otherwise("Fire in Springfield")
    return geocode.resolve(table(spark, sf_dir, "documents").select(i.alias("id"), t.alias("text")), geocode.seed(spark)).select("id", "name", "rule")


HEADLINES = [
    ("Storm hits Tokyo, Japan", "Tokyo", "explicit_pair"),
    ("Storm in Paris, Texas", "Paris, Texas", "explicit_pair"),
    ("Strike in Paris", "Paris", "dominant"),
    ("BERLIN (Reuters) - Talks resume", "Berlin", "unique"),
    ("Madrid vs London match ends", None, None),
    ("Attack strikes Japanese nuclear plants", "Japan", "country"),
    ("White House says no", "United States", "actor_country"),
    ("Texas state budget passes", "Texas", "state"),
    ("Crowd at the Eiffel Tower", "Eiffel Tower", "landmark"),
    ("Unrest across Europe", "Europe", "region"),
    ("Fire in Springfield", None, None),
]
_CASE = lambda part: "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{h[part]}'" for i, h in enumerate(HEADLINES) if h[part]) + " END"


@query(f"SELECT doc_id AS id, {_CASE(1)} AS name, {_CASE(2)} AS rule FROM documents WHERE doc_id % 11 NOT IN (4, 10)")
def located_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, their whole texts behind a headline, located by what their words say."""
    titles = F.array(*[F.lit(h[0]) for h in HEADLINES])
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(titles, (F.col("doc_id") % 11).cast("int")).alias("title"), F.col("text").alias("description"), "source")
    return articles.resolve(d, geocode.seed(spark)).select("id", "name", "rule")


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey % 5, c_nationkey ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_name) AS r FROM customer)
  SELECT CAST(c_nationkey % 5 AS VARCHAR) AS country, CAST(c_nationkey AS VARCHAR) AS region, CAST(id % 180 - 90 AS DOUBLE) AS lat, CAST(id % 360 - 180 AS DOUBLE) AS lon FROM c WHERE r = 1""")
def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region lies where its most populous city does."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    cities = c.select(F.col("c_name").alias("name"), (F.col("c_nationkey") % 5).cast("string").alias("country"), F.col("c_nationkey").cast("string").alias("region"), (i % 180 - 90).cast("double").alias("lat"), (i % 360 - 180).cast("double").alias("lon"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("population"))
    return geocode.admin_centroids(cities)


@query("SELECT n_nationkey AS id, 'saint ' || lower(n_name) AS key FROM nation UNION ALL SELECT n_nationkey, 'st ' || lower(n_name) FROM nation")
def gazetteer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of places, saints also in short."""
    n = table(spark, sf_dir, "nation")
    cities = n.select(F.concat(F.lit("Saint "), "n_name").alias("name"), F.concat(F.lit("Saint "), "n_name").alias("ascii_name"), F.lit(None).cast("array<string>").alias("alternates"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("n_regionkey").cast("string").alias("country"), F.col("n_nationkey").cast("string").alias("region"), F.lit(10).cast("bigint").alias("population"))
    return geocode.build(cities).select(F.col("region").cast("int").alias("id"), "key")


@query("SELECT type, count(*) AS entries, count(DISTINCT key) AS keys FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[2]}')" for r in geocode.SEED) + ") g(key, type) GROUP BY type")
def gazetteer_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer entries by type."""
    return geocode.composition(geocode.seed(spark))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Paris' WHEN 1 THEN 'New York' END AS name FROM customer WHERE c_custkey % 3 <> 2")
def geocoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place names alone looked up."""
    i = F.col("c_custkey")
    names = table(spark, sf_dir, "customer").select(i.alias("id"), F.when(i % 3 == 0, " París's").when(i % 3 == 1, "NEW YORK,").otherwise("Atlantis").alias("place"))
    return geocode.geocode_name(names, geocode.seed(spark)).select("id", "name")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 1.5::DOUBLE ELSE 35.6762::DOUBLE END AS lat FROM customer")
def enriched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that have coordinates keep them, others get their text's."""
    i = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(i.alias("id"), F.when(i % 2 == 0, 1.5).alias("lat"), F.when(i % 2 == 0, 2.5).alias("lon"), F.lit(None).cast("string").alias("location_name"), F.lit("Shares rise in Tokyo").alias("text"))
    return geocode.enrich(items, geocode.seed(spark)).select("id", "lat")


@query("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def streaming_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream deduplicated within its horizon and written by idempotent batches, read back."""
    root = new_folder(spark, "dedupe")
    raw = table(spark, sf_dir, "events").select("event_type", "user_id", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    raw.write.mode("overwrite").parquet(f"{root}/in")
    stream = jobs.deduplicated(jobs.landed(spark, f"{root}/in", raw.schema.simpleString()[7:-1].replace(":", " ")), ["event_type", "user_id"])
    jobs.keyed_batches(stream, f"{root}/checkpoint", f"{root}/out", lambda b: b.select("event_type", "user_id")).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("users"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start_ms, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream of several files; all windows that its watermark of two hours has finished."""
    root = new_folder(spark, "windows")
    raw = table(spark, sf_dir, "events").select(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"), "event_type")
    raw.repartitionByRange(8, "ts").write.mode("overwrite").parquet(f"{root}/in")
    jobs.land_in_order(spark, f"{root}/in")
    counts = jobs.window_counts(jobs.landed(spark, f"{root}/in", "ts timestamp, event_type string", 1), "event_type")
    jobs.keyed_batches(counts, f"{root}/checkpoint", f"{root}/out", lambda b: b).start().awaitTermination()
    last = raw.agg(F.max("ts").alias("last"))
    zone = F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    done = spark.read.parquet(f"{root}/out").crossJoin(last).where(F.expr("start + interval 3 hours <= last"))
    return done.select((F.unix_millis("start") - zone).alias("start_ms"), "event_type", "n")


@query("WITH e AS (SELECT event_id, user_id FROM events WHERE event_id % 2 = 0) SELECT user_id, count(*) AS n FROM e WHERE user_id % 5 <> 0 GROUP BY 1")
def streaming_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream under its tier's watermark against what the stored stories have."""
    root = new_folder(spark, "unseen")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    e.where("event_id % 2 = 0").write.mode("overwrite").parquet(f"{root}/in")
    history = e.where("user_id % 5 = 0").select("user_id")
    stream = jobs.unseen_against(jobs.on_time(jobs.landed(spark, f"{root}/in", "event_id bigint, user_id bigint, ts timestamp")), history, "user_id")
    jobs.keyed_batches(stream, f"{root}/checkpoint", f"{root}/out", lambda b: b.select("event_id", "user_id")).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, event_type || CAST(user_id AS VARCHAR) AS key, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before FROM events),
  c AS (SELECT *, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 48 HOUR) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM e)
  SELECT event_id, first(event_id) OVER (PARTITION BY key, chain ORDER BY ts, event_id) AS story FROM c""")
def streaming_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in eight batches matched with what its state still holds: stories that had a report within 48 hours."""
    root = new_folder(spark, "matches")
    raw = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"))
    raw.repartitionByRange(8, "ts").write.mode("overwrite").parquet(f"{root}/in")
    jobs.land_in_order(spark, f"{root}/in")
    jobs.use_rocksdb(spark)
    found = jobs.matched(jobs.landed(spark, f"{root}/in", "event_id bigint, key string, ts timestamp", 1), "key", "event_id")
    jobs.keyed_batches(found, f"{root}/checkpoint", f"{root}/out", lambda b: b).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("id").alias("event_id"), "story")


@query("SELECT o_orderkey % 7 AS batch, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS kept FROM orders GROUP BY 1")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of sources united by name, a missing column null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("batch"))
    a, b = o.where("o_orderkey % 2 = 0").withColumn("kept", F.lit(1)), o.where("o_orderkey % 2 <> 0")
    return a.unionByName(b, allowMissingColumns=True).groupBy("batch").agg(F.count("*").alias("n"), F.count("kept").alias("kept"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'update' END AS action, count(*) AS count FROM orders GROUP BY 1")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change set would do."""
    return sinks.dry_run(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("update").alias("action")))


@query("SELECT event_id AS status_id, user_id AS account FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id) AS r FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1706313600000 AND 1706573100000) WHERE r <= 10")
def normalised_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest posts of each account within three days."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("status_id"), F.lit("a text that is long enough").alias("text"), scores.epoch_ms(F.col("ts")).alias("at_ms"))
    return feeds.normalise_posts(e, 1706572800000).select("status_id", "account")


@query(f"WITH {STORIES} SELECT 'acct' || source AS label, round(lat, 2) AS lat, lon, printf('%.2f,%.2f', lat, lon) AS cell FROM stories WHERE lat IS NOT NULL")
def flight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving points with labels, defaults and cells."""
    none = F.lit(None).cast("double")
    s = stories(spark, sf_dir).select(F.lit("  ").alias("flight"), F.concat(F.lit("acct"), "source").alias("registration"), "lat", "lon", none.alias("track"), none.alias("altitude"), none.alias("speed"))
    return feeds.flights(s).select("label", "lat", "lon", "cell")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 5) ELSE substr(text, 1, 5) || '. ' || substr(text, 6, 200) END AS embedding_text FROM documents WHERE length(text) > 5")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a story's vector is made of."""
    d = table(spark, sf_dir, "documents").where("length(text) > 5")
    rest = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.expr("substring(text, 6)"))
    return d.select("doc_id", text.embedding_text(F.substring("text", 1, 5), rest).alias("embedding_text"))


@query(f"WITH {STORIES} SELECT id, lat BETWEEN -90 AND 90 AND lat IS NOT NULL AS usable, published_ms >= {NOW_MS - 48 * HOUR_MS} AS recent FROM stories")
def usable_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that can be mapped, and what is recent."""
    s = stories(spark, sf_dir)
    r = feeds.recent(s, NOW_MS - 48 * HOUR_MS).select("id", F.lit(True).alias("_r"))
    return s.join(r, "id", "left").select("id", geo.usable(F.col("lat"), F.col("lon")).alias("usable"), F.coalesce("_r", F.lit(False)).alias("recent"))

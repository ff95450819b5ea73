"""Locating texts: a gazetteer as a dimension table, n-gram joins, scored mentions and a cascade of rules.

All is joins, windows and columns; the gazetteer is a table that users load (``sources.geonames``), with a small seed
of public facts beside it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scan, text
from .shared import sized

# A seed of places (key, name, type, country, region, lat, lon, population).
SEED = [
    ("paris", "Paris", "city", "FR", "11", 48.8566, 2.3522, 2_100_000),
    ("paris", "Paris, Texas", "city", "US", "TX", 33.6609, -95.5555, 24_000),
    ("london", "London", "city", "GB", "ENG", 51.5074, -0.1278, 8_900_000),
    ("berlin", "Berlin", "city", "DE", "16", 52.52, 13.405, 3_600_000),
    ("madrid", "Madrid", "city", "ES", "29", 40.4168, -3.7038, 3_200_000),
    ("new york", "New York", "city", "US", "NY", 40.7128, -74.006, 8_400_000),
    ("tokyo", "Tokyo", "city", "JP", "40", 35.6762, 139.6503, 13_900_000),
    ("lagos", "Lagos", "city", "NG", "05", 6.5244, 3.3792, 15_300_000),
    ("sydney", "Sydney", "city", "AU", "02", -33.8688, 151.2093, 5_300_000),
    ("springfield", "Springfield, Illinois", "city", "US", "IL", 39.7817, -89.6501, 114_000),
    ("springfield", "Springfield, Missouri", "city", "US", "MO", 37.209, -93.2923, 169_000),
    ("texas", "Texas", "admin1", "US", "TX", 31.0, -100.0, 29_000_000),
    ("france", "France", "country", "FR", None, 46.2276, 2.2137, 67_000_000),
    ("germany", "Germany", "country", "DE", None, 51.1657, 10.4515, 83_000_000),
    ("spain", "Spain", "country", "ES", None, 40.4637, -3.7492, 47_000_000),
    ("japan", "Japan", "country", "JP", None, 36.2048, 138.2529, 125_000_000),
    ("united states", "United States", "country", "US", None, 39.8283, -98.5795, 331_000_000),
    ("nigeria", "Nigeria", "country", "NG", None, 9.082, 8.6753, 206_000_000),
    ("eiffel tower", "Eiffel Tower", "landmark", "FR", "11", 48.8584, 2.2945, 0),
    ("europe", "Europe", "region", None, None, 54.526, 15.2551, 0),
    ("africa", "Africa", "region", None, None, -8.7832, 34.5085, 0),
]
SEED_SCHEMA = "key string, name string, type string, country string, region string, lat double, lon double, population bigint"
DEMONYMS = {
    "american": "united states", "chinese": "china", "russian": "russia", "indian": "india", "japanese": "japan", "german": "germany", "deutschland": "germany", "french": "france",
    "british": "united kingdom", "canadian": "canada", "brazilian": "brazil", "australian": "australia", "tasmanian": "australia", "mexican": "mexico", "italian": "italy", "spanish": "spain",
    "korean": "south korea", "iranian": "iran", "iraqi": "iraq", "syrian": "syria", "turkish": "turkey", "israeli": "israel", "palestinian": "palestine", "egyptian": "egypt", "saudi": "saudi arabia",
    "pakistani": "pakistan", "afghan": "afghanistan", "nigerian": "nigeria", "kenyan": "kenya", "ethiopian": "ethiopia", "sudanese": "sudan", "somali": "somalia", "libyan": "libya", "yemeni": "yemen",
    "lebanese": "lebanon", "jordanian": "jordan", "polish": "poland", "dutch": "netherlands", "belgian": "belgium", "swedish": "sweden", "norwegian": "norway", "danish": "denmark", "finnish": "finland",
    "greek": "greece", "portuguese": "portugal", "swiss": "switzerland", "austrian": "austria", "romanian": "romania", "hungarian": "hungary", "czech": "czech republic", "indonesian": "indonesia",
    "filipino": "philippines", "vietnamese": "vietnam", "thai": "thailand", "taiwanese": "taiwan", "malaysian": "malaysia", "singaporean": "singapore", "argentinian": "argentina", "colombian": "colombia",
    "chilean": "chile", "venezuelan": "venezuela", "peruvian": "peru", "cuban": "cuba", "irish": "ireland", "scottish": "scotland", "welsh": "wales", "moroccan": "morocco", "tunisian": "tunisia",
    "algerian": "algeria", "ecuadorian": "ecuador", "bolivian": "bolivia", "ukrainian": "ukraine", "georgian": "georgia", "armenian": "armenia", "uruguayan": "uruguay", "paraguayan": "paraguay",
    "bahraini": "bahrain", "qatari": "qatar", "kuwaiti": "kuwait", "omani": "oman", "congolese": "democratic republic of the congo", "tanzanian": "tanzania", "ugandan": "uganda", "rwandan": "rwanda",
    "cameroonian": "cameroon", "senegalese": "senegal", "ghanaian": "ghana", "ivorian": "ivory coast", "mozambican": "mozambique", "zimbabwean": "zimbabwe", "zambian": "zambia", "namibian": "namibia",
    "botswanan": "botswana", "malawian": "malawi", "nepalese": "nepal", "burmese": "myanmar", "cambodian": "cambodia", "laotian": "laos", "siberian": "siberia", "crimean": "crimea", "arctic": "arctic",
    "antarctic": "antarctica", "caribbean": "caribbean", "balkan": "balkans", "scandinavian": "scandinavia", "bavarian": "germany", "catalan": "spain", "tibetan": "china", "asian": "asia",
    "european": "europe", "african": "africa",
}
#: Persons whose name is a demonym, by the word before it.
NO_DEMONYM = {"cuban": "mark"}
PRECEDENCE = {"city": 1, "admin1": 2, "country": 3, "region": 4, "landmark": 5}
PREPOSITIONS = ["in", "at", "near", "from", "outside", "across"]
DOMINANT_POPULATION, DOMINANT_RATIO = 100_000, 5
MAX_WORDS = 6
#: Keys of a gazetteer that go to the tasks as one automaton (some tens of MB).
SCANNED = 200_000
CONFIDENCE = {"hierarchy": 1.0, "country": 0.9, "admin1": 0.9, "landmark": 0.95, "dominant": 0.75, "unique": 0.85, "region": 0.6}


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED, SEED_SCHEMA)


def build(cities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A gazetteer of (name, ascii_name, alternates: array, lat, lon, country, region, population) rows.

    A key for each name in plain lower case, of three characters or more; "saint" and "st" stand for each other; a
    city that repeats a key in one region is kept once, the most populous.
    """
    plain = lambda c: F.lower(text.without_accents(F.trim(c)))
    named = cities.withColumn("key", F.explode(F.array_distinct(F.transform(F.concat(F.array("name", "ascii_name"), F.coalesce("alternates", F.array().cast("array<string>"))), plain))))
    saints = named.where("key like 'saint %' or key like 'st. %'").withColumn("key", F.regexp_replace("key", r"^(?:saint|st\.) ", "st "))
    keys = named.unionByName(saints)
    if aliases is not None:
        keys = keys.unionByName(named.join(sized(aliases.select(F.col("canonical").alias("key"), "alias")), "key").withColumn("key", F.col("alias")).drop("alias"))
    best = Window.partitionBy("key", "country", "region").orderBy(F.col("population").desc(), "name")
    out = keys.where("length(key) > 2").withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return out.select("key", "name", F.lit("city").alias("type"), "country", "region", "lat", "lon", "population")


def admin_centroids(cities: DataFrame) -> DataFrame:
    """(country, region, lat, lon) of each region: where its most populous city lies."""
    best = Window.partitionBy("country", "region").orderBy(F.col("population").desc(), "name")
    return cities.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("country", "region", "lat", "lon")


def composition(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.groupBy("type").agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))


def words(column: Column) -> Column:
    return F.array_remove(F.split(text.without_accents(F.lower(F.coalesce(column, F.lit("")))), r"[^\p{L}\p{N}'.-]+"), "")


def _spellings(key: str) -> set[tuple[str, ...]]:
    """The words of a key; a country that a demonym stands for may also be one of them."""
    whole = {key}
    for country in set(DEMONYMS.values()):
        if " " in country:
            whole |= {re.sub(rf"(?<!\S){re.escape(country)}(?!\S)", country.replace(" ", "\0"), k) for k in whole}
    return {tuple(w.replace("\0", " ") for w in k.split(" ")) for k in whole if k}


def n_grams(w: DataFrame, max_words: int) -> DataFrame:
    """(id, pos, n, key, before): all runs of up to ``max_words`` of the words of (id, w)."""
    grams = w.select("id", "w", F.posexplode("w").alias("pos", "first")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(max_words)))).where(F.col("pos") + F.col("n") <= F.size("w"))
    return grams.select("id", "pos", "n", F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ").alias("key"), F.when(F.col("pos") > 0, F.get("w", F.col("pos") - 1)).alias("before"))


def key_hits(w: DataFrame, keys: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, pos, n, key, before): each run of words of (id, w: array) that is one of the ``keys`` (key), and the word before it."""
    known = [r["key"] for r in keys.where("key is not null").distinct().limit(SCANNED + 1).collect()]
    if len(known) > SCANNED:
        return n_grams(w, max_words).join(keys.distinct(), "key")
    hits = w.withColumn("_h", scan.phrases_in(F.col("w"), [p for k in known for p in _spellings(k) if len(p) <= max_words]))
    before = F.when(F.col("_h.pos") > 0, F.get("w", F.col("_h.pos") - 1))
    return hits.select("id", "w", F.explode("_h").alias("_h")).select("id", "_h.*", before.alias("before"))


def demonyms() -> dict[str, str]:
    """Countries by the adjective of their people, and by its plural."""
    return {f"{k}s": v for k, v in DEMONYMS.items()} | DEMONYMS


def place_words(column: Column) -> Column:
    """The words of a text, a nation's adjective as its country, others without possessives and marks at their ends."""
    nations = demonyms()
    country = F.create_map(*[F.lit(x) for p in nations.items() for x in p])
    w = words(column)
    # the words before are looked at, and the map is searched, for words in them alone
    person = lambda x, i: reduce(lambda a, b: a | b, [(x == k) & F.coalesce(F.get(w, i - 1) == before, F.lit(False)) for k, before in NO_DEMONYM.items()])
    return F.transform(w, lambda x, i: F.when(x.isin(*nations) & ~person(x, i), F.try_element_at(country, x)).otherwise(F.regexp_replace(x, r"(?:'s)?[.'-]*$", "")))


def mentions(texts: DataFrame, gazetteer: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(id, pos, n, cue, key, name, type, ..): places whose names texts (id, text) hold, of up to six words.

    ``cue`` is the preposition before a mention, if any.  Mentions inside a longer one are dropped.  Up to ``SCANNED``
    keys go to the tasks as one automaton, which finds them in one pass over a text's words; a larger gazetteer is
    joined by its keys with the n-grams of the texts, which gives the same.
    """
    w = texts.select("id", place_words(F.col(text_col)).alias("w"))
    grams = key_hits(w, gazetteer.select("key"), max_words)
    cue = F.when(F.col("before").isin(PREPOSITIONS), F.col("before"))
    met = grams.join(gazetteer, "key").withColumn("cue", cue).drop("before")
    spans = met.select("id", F.struct("pos", "n").alias("s")).distinct().groupBy("id").agg(F.collect_list("s").alias("spans"))
    inside = F.exists("spans", lambda s: (s["pos"] <= F.col("pos")) & (s["pos"] + s["n"] >= F.col("pos") + F.col("n")) & (s["n"] > F.col("n")))
    return met.join(spans, "id").where(~inside).drop("spans")


def scored(found: DataFrame) -> DataFrame:
    """Mentions with a score, the lower the better, and their rank in the text.

    Placement (a cue is better than none, early than late), specificity, and support from the same text: a country or
    region that the text names too.
    """
    specificity = F.when(F.col("type") == "landmark", 0).when(F.col("type") == "city", 2).when(F.col("type") == "admin1", 6).when(F.col("type") == "country", 10).otherwise(40)
    countries = Window.partitionBy("id")
    named = F.collect_set(F.when(F.col("type").isin("country"), F.col("country"))).over(countries)
    regions = F.collect_set(F.when(F.col("type") == "admin1", F.concat_ws("/", "country", "region"))).over(countries)
    child = F.col("type").isin("city", "landmark")
    supported = child & (F.array_contains(named, F.col("country")) | F.array_contains(regions, F.concat_ws("/", "country", "region")))
    rows = found.withColumns({"supported": F.coalesce(supported, F.lit(False)), "score": specificity + F.when(F.col("cue").isNotNull(), 0).otherwise(12) + F.least(F.col("pos"), F.lit(30)) * 0.1})
    rows = rows.withColumn("score", F.col("score") - F.when(F.col("supported"), 10).otherwise(0))
    order = Window.partitionBy("id").orderBy("score", F.col("population").desc(), "name")
    return rows.withColumn("rank", F.row_number().over(order))


def dominant(found: DataFrame) -> DataFrame:
    """Mentions with ``share``: unique keys, those of a city of 100000 and five times the next one's size, or neither."""
    entities = found.select("id", "key", "name", "population").distinct()
    w = Window.partitionBy("id", "key").orderBy(F.col("population").desc(), "name")
    ranked = entities.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("population").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("id", "key")))
    state = F.when(F.col("_n") == 1, "unique").when((F.col("_r") == 1) & (F.col("population") >= DOMINANT_POPULATION) & (F.col("population") >= DOMINANT_RATIO * F.greatest(F.coalesce("_next", F.lit(0)), F.lit(1))), "dominant")
    return found.join(ranked.select("id", "key", "name", state.alias("share")), ["id", "key", "name"])


def resolve(texts: DataFrame, gazetteer: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, name, lat, lon, confidence, rule) of texts that can be placed; ambiguous ones are not.

    Rules in order: a child whose country or region the text names, a landmark, a unique place, a dominant one, a
    region of a country, a country, a broad region.
    """
    m = dominant(scored(mentions(texts, gazetteer, text_col)))
    rule = (
        F.when(F.col("supported"), "hierarchy")
        .when(F.col("type") == "landmark", "landmark")
        .when((F.col("type") == "city") & (F.col("share") == "unique"), "unique")
        .when((F.col("type") == "city") & (F.col("share") == "dominant"), "dominant")
        .when(F.col("type").isin("admin1", "country", "region"), F.col("type"))
    )
    places = {r: i for i, r in enumerate(["hierarchy", "landmark", "unique", "dominant", "admin1", "country", "region"])}
    order = F.create_map(*[F.lit(x) for p in places.items() for x in p])
    sure = F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])
    best = Window.partitionBy("id").orderBy(F.try_element_at(order, F.col("rule")), "score", F.col("population").desc(), "name")
    picked = m.withColumn("rule", rule).where("rule is not null").withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return picked.select("id", "name", "lat", "lon", F.try_element_at(sure, F.col("rule")).alias("confidence"), "rule")


def geocode_name(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, name, lat, lon): a place name alone looked up, of equals the best type and then the most populous."""
    order = F.create_map(*[F.lit(x) for p in PRECEDENCE.items() for x in p])
    key = F.lower(text.without_accents(text.clean_candidate(F.col("place"))))
    best = Window.partitionBy("id").orderBy(F.try_element_at(order, F.col("type")).desc(), F.col("population").desc(), "name")
    met = names.withColumn("key", key).join(gazetteer, "key").withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return met.select("id", "name", "lat", "lon")


def enrich(items: DataFrame, gazetteer: DataFrame, text_col: str = "text") -> DataFrame:
    """Items with coordinates where they had none and their text can be placed."""
    missing = items.where(~geo.usable(F.col("lat"), F.col("lon")))
    found = resolve(missing, gazetteer, text_col).select("id", F.col("name").alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    out = items.join(found, "id", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("lat", "lon") else F.coalesce("_name", c).alias(c) if c == "location_name" else F.col(c) for c in items.columns])

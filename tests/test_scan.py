import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.functions import scan
from tidewire.operators import articles, geocode

WORDS = ["a", "b", "c", "d", "united states", "x"]


def brute(words, phrases):
    return sorted((i, len(p), " ".join(p)) for p in set(phrases) for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p)


def test_all_phrases_are_found_in_one_pass(spark):
    rng = random.Random(0)
    pick = lambda n: tuple(rng.choice(WORDS[:5]) for _ in range(n))
    phrases = [pick(rng.randint(1, 5)) for _ in range(60)]
    rows = [(i, [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]) for i in range(200)] + [(-1, None), (-2, [])]
    found = spark.createDataFrame(rows, "id int, w array<string>").repartition(3).select("id", scan.phrases_in(F.col("w"), phrases).alias("h")).collect()
    got = {r["id"]: sorted(tuple(h) for h in r["h"] or []) for r in found}
    assert got == {i: brute(w or [], phrases) for i, w in rows}
    none = spark.createDataFrame(rows, "id int, w array<string>").select(scan.phrases_in(F.col("w"), []).alias("h")).collect()
    assert all(not r["h"] for r in none)


def test_automaton_and_n_gram_join_agree_on_documents(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" near the American coast, in New York and Paris, Texas. united states")).alias("text"))
    words = docs.select("id", F.slice(geocode.words(F.col("text")), 1, 60).alias("w"))
    keys = geocode.n_grams(words, 3).select("key").distinct().limit(10_000)
    schema = geocode.seed(spark).schema
    made = keys.select("key", F.col("key").alias("name"), F.lit("city").alias("type"), F.lit("FR").alias("country"), F.lit("11").alias("region"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(1).cast("bigint").alias("population"))
    gazetteer = geocode.seed(spark).unionByName(spark.createDataFrame(made.collect(), schema))
    columns = ["id", "pos", "n", "cue", "key", "name"]
    one = sorted(map(tuple, geocode.mentions(docs, gazetteer).select(*columns).collect()), key=str)
    monkeypatch.setattr(geocode, "SCANNED", 100)
    two = sorted(map(tuple, geocode.mentions(docs, gazetteer).select(*columns).collect()), key=str)
    assert one == two and len(one) > 10_000
    assert {r[4] for r in one} >= {"united states"}


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Troops moved north of Kyiv", [("Kyiv", "venue")]),
        ("Missiles launched from Iran at Tel Aviv", [("Iran", "origin"), ("Tel Aviv", "venue")]),
        ("Protests in Lima and clashes near the Gulf of Aden", [("Lima", "venue"), ("Gulf of Aden", "venue")]),
        ("Sanctions against Russia; an envoy to Norway", [("Russia", "target"), ("Norway", "toward")]),
        ("Explosion rocks Beirut, forces struck Gaza", [("Beirut", "target"), ("Gaza", "target")]),
        ("Talks with France on Monday", [("France", "toward"), ("Monday", "toward")]),
        ("He came out. Of Rome they spoke", []),
        ("IN PARIS", [("PARIS", "venue")]),
        ("in", []),
        (None, []),
    ],
)
def test_names_behind_cues(spark, text, wanted):
    row = spark.createDataFrame([(text,)], "t string").select(scan.names_behind(F.col("t"), articles.CUES, articles.NAME).alias("n")).first()
    assert [tuple(x) for x in row["n"]] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Oregon-based firm in L.A. and St. Paul", "Oregon firm in Los Angeles and Saint Paul"),
        ("Kazakhstan-EU talks, N. Korea's test", "Kazakhstan EU talks, North Korea's test"),
        ("The Liberal party and #UKRAINE #USNavy", "The party and Navy"),
        ("El Niño conditions in Peru. Follow us on Telegram", "conditions in Peru."),
        ("Cold War films; Los Angeles Lakers win", "films; Lakers win"),
        ("Turkey recipes and U.S.'s plan", "poultry recipes and U.S. plan"),
    ],
)
def test_rewrites(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(articles.cleaned(F.col("t")).alias("c")).first()["c"] == wanted


def test_nations_by_their_adjectives(spark):
    said = lambda t: spark.createDataFrame([(t,)], "t string").select(geocode.place_words(F.col("t")).alias("w")).first()["w"]
    assert said("Ukrainian troops, Germans and the Saudi king's men") == ["ukraine", "troops", "germany", "and", "the", "saudi arabia", "king", "men"]
    assert said("Mark Cuban met Cuban doctors") == ["mark", "cuban", "met", "cuba", "doctors"] and said("cuban") == ["cuba"]
    assert said("Congolese") == ["democratic republic of the congo"] and said("") == [] and said(None) == []


def test_lists_are_searched_some_words_at_a_time(monkeypatch):
    automaton = scan.Phrases([("a",), ("a", "b"), ("c", "a")])
    lists = pa.array([["a", "b"], None, [], ["c", "a", "b"] * 5, ["x"], ["c"], ["a"], None], pa.list_(pa.string()))
    whole = automaton.in_lists(lists).to_pylist()
    sizes, some = [], automaton._in_some
    monkeypatch.setattr(automaton, "_in_some", lambda x: sizes.append(len(x.flatten())) or some(x))
    for most in (1, 2, 4, 100):
        monkeypatch.setattr(scan, "WORDS", most)
        sizes.clear()
        assert automaton.in_lists(lists).to_pylist() == whole and len(automaton.in_lists(lists[1:])) == 7
        assert max(sizes) <= max(most, 15)
    assert [h["key"] for h in whole[3]] == ["c a", "a", "a b"] * 5 and whole[5] == [] and automaton.in_lists(lists[:0]).to_pylist() == []

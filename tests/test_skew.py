import random

from pyspark.sql import functions as F

from tidewire.operators import shared
from tidewire.operators import stories as st


def test_a_hot_key_is_dealt_out_on_both_sides(spark):
    left = spark.createDataFrame([(i, "hot" if i % 10 else f"k{i}") for i in range(400)] + [(1000, None)], "id int, k string")
    right = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(1000, None)], "n int, k string")
    wanted = sorted(map(tuple, left.join(right, "k").select("id", "n").collect()))
    for most in (16, 100, 4096):
        met = shared.dealt_join(left, right, ["k"], most)
        assert met.columns == ["k", "id", "n"]
        assert sorted(map(tuple, met.select("id", "n").collect())) == wanted


def test_parts_of_a_hot_key_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot") for i in range(1000)], "id int, k string")
    seen = []
    real = type(rows).join

    def join(self, other, on=None, how=None):
        if isinstance(on, list) and "_lp_at" in on:
            seen.append((self.groupBy(*on).count().agg(F.max("count")).first()[0], other.groupBy(*on).count().agg(F.max("count")).first()[0]))
        return real(self, other, on, how)

    monkeypatch.setattr(type(rows), "join", join)
    assert shared.dealt_join(rows, rows.withColumnRenamed("id", "n"), ["k"], 100).count() == 1_000_000
    assert len(seen) == 1 and max(seen[0]) <= 160


def test_a_dense_city_and_a_frequent_title(spark, monkeypatch):
    monkeypatch.setattr(shared.dealt_join, "__defaults__", (50,))
    rng = random.Random(5)
    points = [(i, 48.85 + rng.uniform(-0.3, 0.3), 2.35 + rng.uniform(-0.5, 0.5)) if i % 10 else (i, rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(500)]
    frame = spark.createDataFrame([(i, lat, lon, rng.randint(0, 200) * 3_600_000) for i, lat, lon in points], "id bigint, lat double, lon double, at_ms bigint").cache()
    a, b = frame.alias("a"), frame.alias("b")
    near = st.geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 50
    every = a.crossJoin(b).where(near).select(F.col("a.id"), F.col("b.id"))
    assert sorted(map(tuple, st.within_km(frame, frame, 50.0).select("a_id", "b_id").collect())) == sorted(map(tuple, every.collect()))
    soon = a.crossJoin(b).where(near & (F.abs(F.col("a.at_ms") - F.col("b.at_ms")) <= 48 * 3_600_000)).select(F.col("a.id"), F.col("b.id"))
    assert sorted(map(tuple, st.within_km(frame, frame, 50.0, 48 * 3_600_000).select("a_id", "b_id").collect())) == sorted(map(tuple, soon.collect()))
    titled = frame.select(F.col("id").alias("seq"), "id", F.lit("A title that is long enough to be told").alias("title"), F.lit(10).alias("published_ms"))
    assert st.exact_candidates(titled, titled, 10).count() == 250_000


def test_conflicting_pairs_find_evidence_once(spark, sf_small):
    import __spark_entry__ as entry

    plan = entry.queries()["conflicting_pairs"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "parquet" not in plan.lower()


def test_no_side_of_conflicting_pairs_is_broadcast(spark, sf_small, monkeypatch):
    import __spark_entry__ as entry

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kind, kept = type(spark.range(0)), []
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: kept.append(plan(self)) or real(self, *a))
    pairs = entry.queries()["conflicting_pairs"](spark, sf_small)
    # what tells frequent keys has a join too, for places, titles and templates
    assert sum("Join" in p for p in kept) == 3 and "Generate explode" in plan(pairs)
    for p in (*kept, plan(pairs)):
        assert "Broadcast" not in p


def test_frequent_keys_are_not_broadcast_with_their_rows(spark):
    left = spark.range(400).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k"))
    met = shared.dealt_join(left, left.withColumnRenamed("id", "n"), ["k"], 100)
    # a side's rows meet the hot keys, which are counted, by a broadcast; the sides meet each other by a shuffle
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 1 and met.count() == 360 * 360 + 40 * 40


def test_equal_points_meet_as_places(spark, monkeypatch):
    met, real = [], st.dealt_join

    def dealt(left, right, keys):
        met.append((left.count(), right.count()))
        return real(left, right, keys)

    monkeypatch.setattr(st, "dealt_join", dealt)
    monkeypatch.setattr(st, "BLOCK", 50)
    places = [(10.0, 20.0), (10.25, 20.0), (0.0, 180.0), (-0.0, -180.0), (None, 3.0), (60.0, 60.0)]
    rows = [(i, *places[i % 6]) for i in range(600)]
    frame = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    few = frame.where("id < 60")
    got = st.within_km(frame, few, 50.0, digits=3)
    assert met[0][0] <= 5 * 9 and met[0][1] == 5
    a, b = frame.alias("a"), few.alias("b")
    far = st.geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    every = a.crossJoin(b).where(far <= 50).select("a.id", "b.id", F.round(far, 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))

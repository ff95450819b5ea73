import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.functions import geo, scores
from tidewire.operators import articles, corroboration, feed, geocode, ingest, items, maintenance, resolution
from tidewire.operators import stories as st
from tidewire.plans import story_queries

HOUR = 3_600_000


def test_snapped_windows():
    assert geo.BBox(1, 2, 3, 4, 2.4).snapped() == geo.BBox(-90, 90, -180, 180, 2)
    assert geo.BBox(43, 57.5, -8, 11, 5).snapped() == geo.BBox(40, 60, -10, 20, 5)
    assert geo.BBox(-5, 5, 170, 190, 8).snapped() == geo.BBox(-5, 5, 170, -170, 8)
    assert geo.BBox(-5, 5, -179, 179, 3.5).snapped().max_lon == 180


@pytest.mark.parametrize(
    ("asked", "tier", "zoom", "search", "history", "want"),
    [(None, "paid", 7, False, None, 250), (None, "paid", 5, False, None, 500), (None, "paid", 7, True, None, 1000), (300, "free", None, False, None, 50), (None, "paid", 7, False, 3 * 86_400_000, 1000), (5, "guest", 2, False, None, 5)],
)
def test_effective_limit(asked, tier, zoom, search, history, want):
    assert feed.effective_limit(asked, tier, zoom, search, history) == want


def test_queries_are_validated():
    for bad in ({"tiers": (4,)}, {"since_ms": 2, "until_ms": 1}, {"search": "x" * 200}, {"bbox": geo.BBox(50, 40, 0, 1)}):
        with pytest.raises(ValueError, match=r".+"):
            feed.FeedQuery(1, **bad).validated()


def fold_count(rows):
    """The ordered rule in plain Python."""
    identities, publishers, marks, n = set(), set(), set(), 0
    for identity, publisher, mark in rows:
        if identity is not None:
            if identity in identities:
                continue
            identities.add(identity)
        if publisher == "unknown" or publisher in publishers:
            continue
        publishers.add(publisher)
        if mark and mark in marks:
            continue
        if mark:
            marks.add(mark)
        n += 1
    return max(1, n)


def test_independent_sources_equal_the_ordered_rule(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for story in range(400):
        own = [(rng.choice([None, "a", "b", "c"]), rng.choice(["unknown", "p", "q", "r", "s"]), rng.choice(["", "", "x", "y"])) for _ in range(rng.randint(1, 7))]
        want[story] = fold_count(own)
        rows += [(story, seq, *r) for seq, r in enumerate(own)]
    frame = spark.createDataFrame(rows, "story int, seq int, identity string, publisher string, fingerprint string")
    got = corroboration.independent_sources(frame, ["story"], "seq").collect()
    assert {r["story"]: r["independent"] for r in got} == want


def test_publisher_keys(spark):
    rows = [("A", "https://www.news.bbc.co.uk/x", "rss", "domain:bbc.co.uk"), ("A", "https://m.e.com", "rss", "domain:e.com"), ("Some Name!", None, "rss", "name:some name"), ("Acc (X)", "https://x.com/a", "social", "social:acc x"), (None, "https://x.com/acc/1", "social", "social:x.com/acc"), (None, None, "rss", "unknown"), (None, "http://10.0.0.1/x", "rss", "domain:10.0.0.1")]
    frame = spark.createDataFrame(rows, "name string, url string, kind string, want string")
    got = frame.select("want", corroboration.publisher_key(F.col("name"), F.col("url"), F.col("kind")).alias("key")).collect()
    assert [r["key"] for r in got] == [r["want"] for r in got]


def test_prepare_keeps_the_longest_and_the_first_place(spark):
    t = "A title that is surely long enough for it"
    rows = [(1, "s", "https://e/a", t, "words"), (2, "s", "https://e/b", t, "words!"), (3, "t", "https://e/a?utm_x=1", "Other", "longer words"), (4, "t", "bad", "x", ""), (5, "t", "https://e/c", " ", "")]
    got = ingest.prepare(spark.createDataFrame(rows, "seq int, source string, url string, title string, description string")).collect()
    assert sorted((r["seq"], r["url"]) for r in got) == [(1, "https://e/b"), (3, "https://e/a")]


def test_novelty_cap_properties(spark):
    items = spark.range(200).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("source"))
    kept = ingest.novelty_cap(items, None, 1.5)
    assert {r["count"] for r in kept.groupBy("source").count().collect()} == {30}
    limits = spark.createDataFrame([("0", 2), ("1", 0)], "source string, max_new int")
    assert {r["source"]: r["count"] for r in ingest.novelty_cap(items, limits).groupBy("source").count().collect()} == {"0": 8, "1": 20, "2": 20}


def test_circuits(spark):
    rows = []
    for name, kinds in {"down": ["http_503"] * 3, "mixed": ["http_503", None, "http_503"], "two": ["http_503"] * 2, "cold": ["provider_failure"] * 3, "fell": ["fallback_http_429"] * 3}.items():
        rows += [("rss", name, "success" if c is None or c.startswith("fallback") else "provider_error", c, 1_000_000 + i * 1000, i) for i, c in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "source_type string, source_name string, outcome string, error_code string, at_ms long, seq int")
    names = lambda now: sorted((r["source_type"], r["source_name"]) for r in ingest.open_circuits(frame, now).collect())
    assert names(1_100_000) == [("rss", "down"), ("rss-primary", "down"), ("rss-primary", "fell")]
    assert names(1_002_000 + 1_800_000) == [("rss-primary", "fell")]


def test_sessions_split_beyond_the_gap_only(spark):
    rows = [("k", 0, 0), ("k", 1, 72 * HOUR), ("k", 2, 144 * HOUR + 1)]
    got = ingest.sessions(spark.createDataFrame(rows, "key string, seq int, at long"), ["key"], F.col("at"), 72 * HOUR).collect()
    assert sorted((r["seq"], r["session"]) for r in got) == [(0, 0), (1, 0), (2, 1)]


def test_distance_join_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-89.9, 89.9), rng.choice([rng.uniform(-180, 180), 179.99, -179.99, 0.0])) for i in range(150)]
    rows += [(200 + i, y + rng.uniform(-0.5, 0.5) if abs(y) < 89 else y, x) for i, (_, y, x) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "id int, lat double, lon double")
    a, b = frame.alias("a"), frame.alias("b")
    far = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    want = {(r[0], r[1]) for r in a.crossJoin(b).where(far <= 50).select("a.id", "b.id").collect()}
    got = [(r["a_id"], r["b_id"]) for r in st.within_km(frame, frame, 50.0).collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_conflicts(spark):
    rows = [
        ("Men's football final won by hosts", "Women's football final won by hosts", 0, True),
        ("Men's football final won by hosts", "Hosts win men's football final", 0, False),
        ("Fire at the hospital", "Fire at the school", 0, True),
        ("Quiz: name the capital", "Name the capital", 0, True),
        ("Stocks close lower", "Shares rise at open", 30, True),
        ("Explosion hits a depot on Monday", "Blast near the depot Friday night", 20, True),
        ("Explosion hits a depot on Monday", "Blast near the depot Friday night", 10, False),
        ("Explosion reported on Monday", "Explosion reported on Friday", 10, True),
        ("Minister resigns", "Minister steps down", 500, False),
        ("Hosts win table tennis gold", "Hosts win tennis gold", 0, True),
        ("France and Germany sign pact", "Spain and France sign a pact", 0, True),
        ("France and Germany sign pact", "Germany agrees deal with France", 0, False),
        ("Explosion near the depot. Names released Monday", "Explosion near the depot. It was hit Friday", 20, False),
        ("Blast at a plant", "Refinery explosion was massive", 0, False),
        ("Massive blast hits the old port", "Airport bombed", 0, False),
        ("Blast hits the old port", "Airport attack, airport struck", 0, True),
    ]
    schema = "i int, title string, description string, url string, at_ms long, lat double, lon double, precise boolean"
    one = lambda side: spark.createDataFrame([(i, r[side], "", f"https://e/{side}/{i}", r[2] * HOUR * side + HOUR, 0.0, 0.0, False) for i, r in enumerate(rows)], schema)
    judge = lambda df: st.evidence(st.named_countries(df.withColumn("id", F.col("i")), geocode.seed(spark)))
    a, b = judge(one(0)).alias("a"), judge(one(1)).alias("b")
    got = {r["i"]: r["c"] for r in a.join(b, F.col("a.i") == F.col("b.i")).select("a.i", st.conflicts("a", "b").alias("c")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_equal_titles_at_named_places_far_apart_conflict(spark):
    rows = [(1, "Fire in Paris", "", "https://e/1", 0, 48.9, 2.3, False, "Paris, France"), (2, "Fire in Paris", "near Paris", "https://e/2", 0, 33.7, -95.6, False, "Paris, Texas"), (3, "Fire in Paris", "", "https://e/3", 0, 33.7, -95.6, False, "Lamar (County)")]
    e = st.evidence(spark.createDataFrame(rows, "id int, title string, description string, url string, at_ms long, lat double, lon double, precise boolean, location_name string"))
    got = {tuple(r) for r in e.alias("a").crossJoin(e.alias("b")).where("a.id < b.id").select("a.id", "b.id", st.conflicts("a", "b")).collect()}
    assert got == {(1, 2, True), (1, 3, False), (2, 3, False)}


def test_conflict_candidates_equal_all_pairs(spark, sf_small):
    rng = random.Random(6)
    titles = ["Explosion reported on Monday", "Explosion reported on Friday", "Quiz", "quiz!", "Toll rises", "", None]
    rows = [(f"{i:03}", rng.choice([rng.choice(titles), f"Title {i}"]), "", f"https://e/{i}", rng.randint(0, 200 * HOUR), rng.choice([None, rng.uniform(0, 1), 50.0]), rng.uniform(0, 1), False) for i in range(120)]
    e = st.evidence(spark.createDataFrame(rows, "id string, title string, description string, url string, at_ms long, lat double, lon double, precise boolean"))
    a, b = e.alias("a"), e.alias("b")
    near = (geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 50) & (F.abs(F.col("a.at_ms") - F.col("b.at_ms")) <= 48 * HOUR)
    same = ((F.col("a.fp") == F.col("b.fp")) & (F.col("a.fp") != "")) | (F.col("a.dated") & F.col("b.dated") & (F.col("a.template") == F.col("b.template")))
    want = {tuple(r) for r in a.crossJoin(b).where((F.col("a.id") < F.col("b.id")) & (F.coalesce(near, F.lit(False)) | F.coalesce(same, F.lit(False)))).select("a.id", "b.id").collect()}
    got = [tuple(r) for r in st.conflict_candidates(e).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    found = story_queries.conflicting_pairs(spark, sf_small)
    assert found.where("a_id >= '000000000400'").count() > 0 and {r["conflict"] for r in found.select("conflict").distinct().collect()} == {True, False}


def test_fold_follows_arrival(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for story in range(60):
        for seq in range(rng.randint(1, 8)):
            r = {"story": f"n{story:02}", "seq": seq, "repeated": seq > 0 and rng.random() < 0.2, "title": "t" * rng.randint(1, 9), "description": rng.choice(["", "d" * rng.randint(1, 9), None]), "url": f"u{seq}", "source": "s", "source_type": "rss"}
            r |= {"tier": rng.randint(1, 3), "at_ms": rng.randint(0, 10) * HOUR, "lat": rng.choice([None, 1.0, 2.0]), "lon": 0.0, "location_name": None, "image_url": rng.choice([None, "i"]), "image_ms": None, "image_updated_ms": None, "description_tier": None, "description_ms": None}
            r["latest_ms"] = r["at_ms"]
            rows.append(r)
            s = want.setdefault(r["story"], {"title": r["title"], "tier": r["tier"], "at": r["at_ms"], "desc": r["description"] or "", "dt": r["tier"], "da": r["at_ms"], "lat": r["lat"], "latest": r["at_ms"], "impact": r["tier"]})
            if not seq:
                continue
            s["latest"] = max(s["latest"], r["at_ms"])
            if r["repeated"]:
                continue
            old, desc = dict(s), r["description"] or ""
            s["impact"] = min(old["tier"], r["tier"])
            long, new_long = len(old["title"]) + len(old["desc"]), len(r["title"]) + len(desc)
            if r["tier"] < old["tier"]:
                wins = True
            elif r["tier"] == old["tier"]:
                wins = r["at_ms"] > old["at"] or (r["at_ms"] == old["at"] and new_long > long)
            else:
                wins = r["tier"] == old["tier"] + 1 and r["at_ms"] > old["at"] + 15 * 60_000
            if wins:
                s |= {"title": r["title"], "tier": r["tier"], "at": r["at_ms"], "lat": r["lat"]}
            stale = r["at_ms"] > old["da"] + 6 * HOUR
            if r["tier"] < old["dt"] or not old["desc"]:
                wins = True
            elif r["tier"] == old["dt"]:
                wins = (stale and len(desc) >= 0.7 * len(old["desc"])) or len(desc) > len(old["desc"])
            else:
                wins = r["tier"] == old["dt"] + 1 and stale and len(desc) >= len(old["desc"])
            if wins and desc:
                s |= {"desc": desc, "dt": r["tier"], "da": r["at_ms"]}
    frame = spark.createDataFrame([tuple(r[n] for n in resolution.names(resolution.FOLD_IN)) for r in rows], resolution.FOLD_IN).repartition(7)
    got = {r["story"]: {"title": r["title"], "tier": r["tier"], "at": r["discovered_ms"], "desc": r["description"] or "", "dt": r["description_tier"], "da": r["description_ms"], "lat": r["lat"], "latest": r["published_ms"], "impact": r["impact_tier"]} for r in resolution.fold(frame, 99 * HOUR, batch=3).collect()}
    assert got == want


def test_rules_hold_for_columns_and_numbers_alike(spark):
    rng = random.Random(2)
    cases = [(rng.randint(1, 3), rng.randint(0, 9) * HOUR, rng.randint(0, 4), rng.randint(1, 3), rng.randint(0, 9) * HOUR, rng.randint(0, 4)) for _ in range(300)]
    frame = spark.createDataFrame(cases, "a int, b long, c int, d int, e long, f int")
    columns = [F.col(c) for c in "abcdef"]
    for rule in (st.title_wins, st.description_wins):
        assert [r["v"] for r in frame.select(rule(*columns).alias("v")).collect()] == [rule(*c) for c in cases]


def report(seq, title, **own):
    base = {"seq": seq, "title": title, "description": None, "url": f"https://site{seq}.example/a/{seq}", "source": f"S{seq}", "source_type": "rss", "tier": 2, "published_ms": 1000 * HOUR + seq, "lat": None, "lon": None, "location_name": None, "embedding": None, "image_url": None, "image_ms": None, "expires_ms": None}
    return base | own


def test_reports_resolve_into_stories(spark):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(8)]
    tilted = [0.9, *[0.0] * 6, (1 - 0.81) ** 0.5]
    blank = {"discovered_ms": None, "description_tier": None, "description_ms": None, "image_updated_ms": None, "independent": 1, "sources": []}
    stored = [
        blank | report(0, "Flood reaches the old town centre", embedding=axis(5), expires_ms=5, lat=1.0, lon=1.0) | {"id": 11},
        blank | report(0, "Harbour strike enters second week", embedding=axis(0), url="https://w.example/x") | {"id": 12},
        blank | report(0, "Too old to be met by anything new", published_ms=900 * HOUR) | {"id": 13},
        blank | report(0, "Women's football final won by hosts", embedding=axis(3)) | {"id": 14},
    ]
    incoming = [
        report(1, "Flood reaches the old town centre!", tier=1),  # equal title; its better tier takes the pin away
        report(2, "Dockers walk out again", embedding=tilted),  # near vector
        report(3, "Too old to be met by anything new"),  # beyond the horizon, so new
        report(4, "Men's football final won by hosts", embedding=axis(3)),  # near, but contradicts
        report(5, "Other words of the men's football final", embedding=axis(3)),  # joins the one before
        report(6, "Again, later", url="https://site3.example/a/3?utm_source=z"),  # the identity of 3
        report(7, "Harbour strike enters second week", url="https://w.example/x", published_ms=1001 * HOUR),  # the stored one itself
        report(8, "Nothing like it anywhere", expires_ms=7, embedding=axis(6)),
    ]
    frame = lambda rows, head, extra="": spark.createDataFrame([tuple(r[n] for n in resolution.names(head + resolution.REPORT)) + tuple(r[n] for n in extra and [x.split()[0] for x in ("discovered_ms bigint", "description_tier int", "description_ms bigint", "image_updated_ms bigint", "independent bigint", "sources x")]) for r in rows], head + resolution.REPORT + extra)
    got = resolution.resolve_stories(frame(incoming, "seq bigint, "), frame(stored, "id bigint, ", ", " + resolution.STORED), geocode.seed(spark), 1001 * HOUR).collect()
    by = {r["id"] or -r["first_seq"]: r for r in got}
    assert set(by) == {11, 12, -3, -4, -8} and len(got) == 5
    flood, strike, old, final, alone = (by[k] for k in (11, 12, -3, -4, -8))
    assert (flood["title"], flood["tier"], flood["lat"], flood["event_count"], flood["independent"], flood["expires_ms"], flood["embedding"]) == ("Flood reaches the old town centre!", 1, None, 2, 1, 5, None)
    assert [x["name"] for x in flood["sources"]] == ["S0"] and flood["impact"] == 2.5
    assert (strike["title"], strike["event_count"], strike["independent"], strike["published_ms"]) == ("Dockers walk out again", 2, 2, 1001 * HOUR)
    assert [x["url"] for x in strike["sources"]] == ["https://w.example/x"] and strike["impact"] == 1.5 + 3.0
    assert old["event_count"] == 1 and old["published_ms"] == 1000 * HOUR + 6
    assert final["event_count"] == 2 and final["title"] == "Other words of the men's football final"
    assert (alone["expires_ms"], alone["embedding"], alone["sources"]) == (7, axis(6), [])
    assert resolution.resolve_stories(frame(incoming, "seq bigint, ").limit(0), frame(stored, "id bigint, ", ", " + resolution.STORED), geocode.seed(spark), 1001 * HOUR).count() == 0


def test_components_of_a_path_against_the_order(spark):
    path = [0, *range(200, 0, -1)]
    links = spark.createDataFrame([*zip(path, path[1:]), (301, 300), (300, 300)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*path, 300, 301, 302]], "id long")
    got = {r["id"]: r["component"] for r in st.components(nodes, links).collect()}
    assert got == dict.fromkeys(path, 0) | {300: 300, 301: 300, 302: 302}
    with pytest.raises(RuntimeError):
        st.components(nodes, links, rounds=2)


@pytest.mark.parametrize("sign", [1, -1])
def test_recluster_equals_one_by_one(spark, sign):
    rng = random.Random(4)
    links = {(0, 1), (1, 2), (2, 3)} | {tuple(sorted(rng.sample(range(10, 90), 2))) for _ in range(120)}
    want = {}
    for b in range(90):
        free = [a for a, x in links if x == b and a not in want]
        if free:
            want[b] = min(free, key=lambda a: sign * a)
    assert want[1] == 0 and 2 not in want and want[3] == 2
    got = maintenance.recluster(spark.createDataFrame(sorted(links), "a long, b long"), F.col("a") * sign).collect()
    assert {r["absorbed"]: r["by"] for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError, match="circle"):
        maintenance.recluster(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), F.col("a"))


def test_ambiguous_places_stay_unplaced(spark):
    rows = [(1, "Fire in Springfield"), (2, "Fire in Springfield, Illinois, United States"), (3, "German minister speaks"), (4, None), (5, "London's mayor")]
    got = {r["id"]: (r["name"], r["rule"]) for r in geocode.resolve(spark.createDataFrame(rows, "id int, text string"), geocode.seed(spark)).collect()}
    assert 1 not in got and 4 not in got
    assert got[3] == ("Germany", "country") and got[5] == ("London", "unique")


def test_spread_leaves_the_first_in_place(spark):
    rows = spark.createDataFrame([("b", 10.0, 20.0), ("a", 10.0, 20.0), ("c", 11.0, 20.0)], "id string, lat double, lon double")
    got = {r["id"]: (r["map_lat"], r["map_lon"]) for r in feed.spread_overlaps(rows, selected="b").collect()}
    assert got["b"] == (10.0, 20.0) and got["c"] == (11.0, 20.0) and got["a"] != (10.0, 20.0)
    assert abs(got["a"][0] - 10) < 0.06 and abs(got["a"][1] - 20) < 0.06


def test_public_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.1.1": False, "172.20.0.1": False, "172.32.0.1": True, "100.64.0.1": False, "203.0.113.9": False, "256.1.1.1": False, "x": False}
    rows = spark.createDataFrame(list(cases.items()), "ip string, want boolean").select("ip", "want", geo.public_ipv4(F.col("ip")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_addresses_of_version_6(spark):
    cases = {"::1": False, "::": False, "fe80::1": False, "febf::1": False, "fec0::1": True, "[fd12:3456::1]": False, "ff02::fb": False, "2001:DB8::1": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False, "1::2::3": False, "::ffff:8.8.8.8": True, "::ffff:10.0.0.1": False, "::8.8.4.4": True, "64:ff9b::1.2.3.4": True, "::ffff:256.1.1.1": False, "12345::": False, "1:2:3:4:5:6:7::": True, "fe80::1%eth0": False, "8.8.8.8": True, "": False}
    rows = spark.createDataFrame(list(cases.items()), "ip string, want boolean").select("ip", "want", geo.public_address(F.col("ip")).alias("got")).collect()
    assert {r["ip"]: r["got"] for r in rows} == cases


def smooth(points, zoom, step=3.0, most=64):
    """A Catmull-Rom curve in plain Python."""
    clean = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    if len(clean) < 3:
        return clean
    edge = 85.0511287798066
    world = []
    for lon, lat in clean:
        phi = math.radians(max(-edge, min(edge, lat)))
        x = (lon + 180) / 360
        while world and x - world[-1][0] > 0.5:
            x -= 1
        while world and x - world[-1][0] < -0.5:
            x += 1
        world.append((x, (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2))
    out = []
    for i in range(len(world) - 1):
        a, b, c, d = (world[max(0, min(len(world) - 1, i + k))] for k in (-1, 0, 1, 2))
        long = max(math.dist(b, c), (math.dist(a, b) + math.dist(b, c) + math.dist(c, d)) / 3) * 512 * 2**zoom
        n = max(1, min(most, math.ceil(long / step)))
        for k in range(n):
            t = k / n
            x, y = (((2 * q) + (r - p) * t + (2 * p - 5 * q + 4 * r - s) * t**2 + (3 * q - p - 3 * r + s) * t**3) / 2 for p, q, r, s in zip(a, b, c, d, strict=True))
            out.append((x * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * min(1, max(0, y))))))))
    lon, lat = clean[-1]
    while lon - out[-1][0] > 180:
        lon -= 360
    while lon - out[-1][0] < -180:
        lon += 360
    return [*out, (lon, lat)]


def test_smooth_lines_equal_plain_python(spark):
    lines = [[(0, 0), (10, 10), (20, 0)], [(170, 10), (-175, 12), (-160, 5), (-160, 5), (-150, 80)], [(1, 1), (1, 1)], [(0, 89), (10, 89), (20, -89), (-170, 3)]]
    for zoom in (0.0, 1.5):
        for line in lines:
            points = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in line])
            got = [(p["lon"], p["lat"]) for p in spark.range(1).select(geo.smooth_line(points, zoom).alias("v")).first()["v"]]
            want = smooth([(float(x), float(y)) for x, y in line], zoom)
            assert len(got) == len(want) and all(math.dist(a, b) < 1e-7 for a, b in zip(got, want, strict=True))


def test_requests_in_text():
    q = feed.parse({"minLat": "-10", "maxLat": "10", "minLng": "170", "maxLng": "190", "zoom": "4", "query": " x ", "sources": "x,news,x", "time_range": "1w", "limit": "0.5", "since": "2024-01-01", "credibility": "3,1"}, 7)
    assert q == feed.FeedQuery(7, geo.BBox(-10, 10, 170, 190, 4), ("news", "x"), ("all",), "1w", 1704067200000, None, "x", 1, (1, 3), "hot", 1)
    assert feed.gate(feed.parse({}, 7), "guest") is None and feed.gate(q, "pro") is None and feed.gate(q, "free") == "filters" and feed.gate(feed.parse({"time_range": "1w"}, 7), "free") == "range"
    assert not feed.clusters_apply(3, geo.BBox(-90, 90, -180, 180)) and feed.clusters_apply(None, geo.BBox(0, 1, 0, 1)) and not feed.clusters_apply(3, geo.BBox(0, 1, 0, 1), True)
    assert feed.AppliedLimit(None, 10, "guest", True).scope == "viewport"


def test_articles_are_located_by_their_words(spark):
    more = [("charlotte", "Charlotte", "city", "US", "NC", 35.2, -80.8, 870000), ("missouri", "Missouri", "admin1", "US", "MO", 38.5, -92.5, 6000000), ("washington", "Washington, DC", "city", "US", "DC", 38.9, -77.04, 700000), ("london", "London, Ontario", "city", "CA", "08", 42.98, -81.23, 400000), ("canada", "Canada", "country", "CA", None, 56.0, -106.0, 38000000)]
    places = geocode.seed(spark).unionByName(spark.createDataFrame(more, geocode.SEED_SCHEMA))
    cases = [
        ("Fire in Springfield", "Officials in Missouri said", None, None, "Springfield, Missouri", "admin_context"),
        ("Fire in Springfield", "", None, "US", None, None),
        ("Charlotte Smith wins", "in Tokyo", None, None, "Tokyo", "unique"),
        ("Talks resume", "Country: Nigeria. more", None, None, "Nigeria", "country"),
        ("Mayor speaks in London", "", None, None, "London", "dominant"),
        ("Mayor speaks in London", "", None, "ca", "London, Ontario", "source_country"),
        ("Mayor speaks in London, Canada", "", None, None, "London, Ontario", "explicit_pair"),
        ("Council votes - Lagos Times", "", "Lagos Times", None, None, None),
        ("Quake felt at the old stadium", "crowd near lincoln memorial", None, None, "Washington, DC", "override"),
        ("German minister speaks", "", None, None, "Germany", "actor_country"),
        ("German minister speaks in Madrid", "", None, None, "Madrid", "unique"),
        ("Planes from Madrid bomb a depot near Lagos", "", None, None, "Lagos", "unique"),
        ("\U0001f525 Tokyo: fire", "", None, None, "Tokyo", "unique"),
        (None, None, None, None, None, None),
        ("A quiet day", "nothing here", None, None, None, None),
    ]
    frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "id int, title string, description string, source string, country string")
    overrides = spark.createDataFrame([("lincoln memorial", "washington")], "needle string, key string")
    got = {r["id"]: (r["name"], r["rule"]) for r in articles.resolve(frame, places, overrides=overrides).collect()}
    assert [got.get(i, (None, None)) for i in range(len(cases))] == [c[4:] for c in cases]


def test_neighbours_are_found_some_queries_at_a_time():
    rng = np.random.default_rng(3)
    for n, k in ((40, 5), (3, 5), (5, 5), (0, 5)):
        sims, ids = np.round(rng.random((30, n)), 1), rng.permutation(n) * 7
        sims[rng.random((30, n)) < 0.3] = -np.inf
        rows, cols = st._nearest(sims, ids, k)
        wanted = [(i, c) for i in range(30) for _, _, c in sorted((-v, ids[c], c) for c, v in enumerate(sims[i]) if v > -np.inf)[:k]]
        assert list(zip(rows.tolist(), cols.tolist(), strict=True)) == wanted
    block = pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (np.arange(4096), rng.random((4096, 8)), np.arange(4000), rng.random((4000, 8)))], ["b_ids", "b", "q_ids", "q"])
    parts = list(st._similarities(block, 6))
    assert max(s.size for _, _, s in parts) <= st.SIMILARITIES and np.concatenate([q for q, _, _ in parts]).tolist() == list(range(4000))


def test_articles_are_cleaned_once(spark, monkeypatch):
    cleaned, made = articles.cleaned, spark.sparkContext.accumulator(0)

    def counted(body, source=None, lexicon=None):
        @F.udf("string")
        def run(t):
            made.add(1)
            return t

        return run(cleaned(body, source, lexicon))

    monkeypatch.setattr(articles, "cleaned", counted)
    frame = spark.createDataFrame([(i, f"Strike in Paris {i}", "previously in Tokyo") for i in range(20)], "id int, title string, description string")
    assert {r["name"] for r in articles.resolve(frame, geocode.seed(spark)).collect()} == {"Paris"}
    assert made.value == 40


def test_recluster_follows_neighbours_newest_first(spark):
    rng = random.Random(12)
    rows, day = [], 24 * HOUR
    for i in range(60):
        centre = i % 9
        v = [rng.gauss(0, 0.1) + (j == centre) for j in range(12)]
        size = math.sqrt(sum(x * x for x in v))
        rows.append((i, f"Title {i}", "", f"https://e/{i}", rng.randint(0, 20) * day, None, None, None, [x / size for x in v]))
    frame = spark.createDataFrame(rows, "id long, title string, description string, url string, at_ms long, lat double, lon double, location_name string, embedding array<double>")
    near = {}
    for r in rows:
        sims = sorted(((-round(sum(x * y for x, y in zip(r[8], o[8], strict=True)), 6), o[0]) for o in rows if o[0] != r[0]))[:10]
        near[r[0]] = {i for s, i in sims if -s >= 0.85}
    at, gone = {r[0]: r[4] for r in rows}, {}
    for keeper in sorted(at, key=lambda i: (-at[i], i)):
        if keeper in gone:
            continue
        for other in near[keeper]:
            if other not in gone and (-at[keeper], keeper) < (-at[other], other) and abs(at[keeper] - at[other]) <= 7 * day:
                gone[other] = keeper
    assert len(gone) > 10
    assert {r["absorbed"]: r["by"] for r in maintenance.recluster_stories(frame, geocode.seed(spark)).collect()} == gone


def test_archive_cleaning_looks_through_links_to_the_story_itself(spark):
    one = lambda url: {"name": "s", "url": url, "source_type": "rss", "at_ms": 5}
    long = "A description that says in twelve or more words what happened there and to whom, and so is kept."
    rows = [
        ("alone", "gone", "https://e/1", "Title", long, [one("https://E/1/?utm_source=x")], 2, 1, 1.5),
        ("held", "gone", "https://e/2", "Title", long, [one("https://f/2")], 2, 1, 1.5),
        ("twice", "kept", "https://e/3", "Title", long, [one("https://f/3"), one("https://f/3/")], 2, 1, 1.5),
        ("same", "kept", "https://e/4", "Title", long, [one("https://f/4")], 2, 1, 1.5),
        ("score", "kept", "https://e/5", "Title", long, [], 2, 1, 9.0),
        ("thin", "Nature", "https://e/6", "Title", "too short", [], 2, 1, 1.5),
    ]
    frame = spark.createDataFrame(rows, f"id string, source string, url string, title string, description string, sources {items.SOURCES}, tier int, independent int, impact double")
    got = {r["id"]: (r["action"], len(r["sources"])) for r in maintenance.clean_archive(frame, ["gone"]).collect()}
    assert got == {"alone": ("delete", 0), "twice": ("update", 1), "score": ("update", 0), "thin": ("delete", 0)}


def test_bounds_over_the_antimeridian(spark):
    rows = spark.createDataFrame([(0.0, 179.0, True), (0.0, -179.0, True), (0.0, 0.0, False), (50.0, 179.0, False), (None, 179.0, False)], "lat double, lon double, want boolean")
    sides = [F.lit(float(x)) for x in (-10, 10, 170, -170)]
    assert all(r["want"] == r["got"] for r in rows.select("want", scores.within_bounds(F.col("lat"), F.col("lon"), *sides).alias("got")).collect())


def test_equal_titles_meet_by_classes(spark):
    """Every report gets the smallest story of its title that does not contradict it, as if each met each, by few rows."""
    leads = ["Fire at the hospital in the old town", "Fire at the school and the hospital, update", "Shares close lower on wall street today"]
    rows = [(i, leads[i % 3], ["", "The fire broke out on Monday.", "The blaze struck on Friday."][i // 3 % 3], f"https://e.example/{i % 17}", i * 7 % 5 * 20 * HOUR, float(i % 2 * 40), 1.0, i % 4 == 0, "x" if i % 5 else None) for i in range(240)]
    frame = spark.createDataFrame(rows, "id bigint, title string, description string, url string, at_ms bigint, lat double, lon double, precise boolean, location_name string")
    e = st.evidence(frame.withColumn("countries", F.lit(None).cast("array<string>"))).localCheckpoint()
    a, b = e.where("id % 2 = 0"), e.where("id % 2 = 1")
    pairs = a.select(F.col("id").alias("seq"), "fp").join(b.select("id", "fp"), "fp").select("seq", "id", F.lit(2.0).alias("score"))
    wanted = resolution.judged(pairs, a, b).groupBy("seq").agg(F.min(pairs["id"]).alias("story"))
    got = resolution.titled(a, b)
    assert sorted(map(tuple, got.select("seq", "story").collect())) == sorted(map(tuple, wanted.collect()))
    assert pairs.count() > got.count() > 0

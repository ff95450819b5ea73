import random
from datetime import datetime, timedelta

import pytest

from tidewire.operators.shared import new_folder
from tidewire.sources import replies
from tidewire.streaming import jobs

HOUR = 3_600_000
BODY = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>feed</title>
<item><title>A &amp; b</title><link>https://a.example/1</link><description>d</description><content:encoded>long</content:encoded><pubDate>Thu, 01 Feb 2024 00:00:00 +0100</pubDate></item>
<item><title>old</title><guid>https://a.example/2</guid><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>
<item><title>undated</title></item><item><title>ahead</title><pubDate>2024-02-09T00:00:00Z</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>x</title><link href="https://b.example/1"/><updated>2024-01-31T23:30:00</updated><summary>s</summary></entry></feed>"""
NOW = replies.time_ms("2024-02-01T00:00:00Z")


@pytest.mark.parametrize(
    ("reply", "titles", "attempt"),
    [
        ({"status": 200, "body": BODY}, ["A & b"], ("healthy", None, 4, 1, 3, NOW - HOUR)),
        ({"status": 200, "body": ATOM}, ["x"], ("healthy", None, 1, 1, 0, NOW - HOUR // 2)),
        ({"status": 200, "body": "<rss/>"}, [], ("empty", None, 0, 0, 0, None)),
        ({"status": 200, "body": "<rss>"}, [], ("parse_error", "invalid_xml", 0, 0, 0, None)),
        ({"status": 200}, [], ("parse_error", "invalid_xml", 0, 0, 0, None)),
        ({"status": 304, "known_ms": NOW - HOUR, "body": BODY}, [], ("healthy", None, 0, 0, 0, NOW - HOUR)),
        ({"status": 304, "known_ms": NOW - 99 * HOUR}, [], ("stale", None, 0, 0, 0, NOW - 99 * HOUR)),
        ({"status": 304}, [], ("empty", "freshness_unknown", 0, 0, 0, None)),
        ({"status": 429}, [], ("provider_error", "http_429", 0, 0, 0, None)),
        ({}, [], ("provider_error", "network", 0, 0, 0, None)),
    ],
)
def test_replies(reply, titles, attempt):
    items, told = replies.read_reply(reply, NOW, 72 * HOUR, 10)
    assert [x.title for x in items] == titles and told == attempt


def test_reply_items_are_bounded_newest_first():
    body = "<rss>" + "".join(f"<item><title>{i}</title><pubDate>2024-01-31T{i:02d}:00:00Z</pubDate></item>" for i in range(24)) + "</rss>"
    items, attempt = replies.read_reply({"status": 200, "body": body}, NOW, 72 * HOUR, 3)
    assert [x.title for x in items] == ["23", "22", "21"] and attempt[2:5] == (24, 3, 21)


def test_stream_matches_end_with_the_horizon(spark):
    """Reports of few keys over weeks, in batches: equal to one by one; state is gone once the horizon has passed."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = sorted((start + timedelta(hours=rng.choice([0, 1, 47, 48, 49, 50, 96]) * 3 + rng.randint(0, 200), minutes=rng.randint(0, 59)), i, f"k{rng.randint(0, 5)}") for i in range(150))
    rows += [(rows[-1][0] + timedelta(hours=49 * k), 1000 + k, "late") for k in range(1, 4)]
    wanted, last = {}, {}
    for at, i, key in rows:
        story, before = last.get(key, (i, None))
        story = i if before is None or at - before > timedelta(hours=48) else story
        last[key], wanted[i] = (story, at), story
    root = new_folder(spark, "test-matches")
    n = 8
    for b in range(n):
        part = rows[b * len(rows) // n : (b + 1) * len(rows) // n]
        spark.createDataFrame([(i, k, t) for t, i, k in part], "id bigint, k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{root}/{b:02d}")
    for b in range(n):
        spark.read.parquet(f"{root}/{b:02d}").coalesce(1).write.mode("append").parquet(f"{root}/in")
    jobs.use_rocksdb(spark)
    stream = jobs.matched(spark.readStream.schema("id bigint, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "k", "id")
    run = jobs.keyed_batches(stream, f"{root}/checkpoint", f"{root}/out", lambda x: x).start()
    run.awaitTermination()
    got = {r["id"]: r["story"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == wanted and len(set(wanted.values())) > 10
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(held) >= n and held[-1] <= 2  # the other keys' timers have cleared them


def test_stream_matches_keep_state_by_groups(spark):
    """Thousands of keys, one of them null, make no more rows of state than there are groups; equal keys still go on."""
    start, root = datetime(2024, 1, 1), new_folder(spark, "test-groups")
    for b in range(2):
        rows = [(b * 5000 + i, None if i == 7 else f"k{i}", start + timedelta(hours=b)) for i in range(2000)]
        spark.createDataFrame(rows, "id bigint, k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{root}/in")
    jobs.use_rocksdb(spark)
    stream = jobs.matched(spark.readStream.schema("id bigint, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "k", "id")
    run = jobs.keyed_batches(stream, f"{root}/checkpoint", f"{root}/out", lambda x: x).start()
    run.awaitTermination()
    got = {r["id"]: r["story"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {b * 5000 + i: i for b in range(2) for i in range(2000)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert held and max(held) <= 3 * jobs.GROUPS

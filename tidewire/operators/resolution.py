"""Resolving reports into stories: candidates by joins, one story for each report, and the fold of reports into stories.

Which story a report belongs to is decided on sets: equal titles, near vectors, then links among the reports that no
stored story takes.  Contradictions are judged on the stories as stored and on the reports themselves.  What a story
then says follows its reports in order of arrival; rows stream through that fold sorted by story, and a task holds one
story's state, however many reports it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from . import corroboration, stories as st
from .shared import new_folder

#: Columns of reports, all but seq nullable; stories have them too, and those of ``STORED``.
REPORT = "title string, description string, url string, source string, source_type string, tier int, published_ms bigint, lat double, lon double, location_name string, embedding array<float>, image_url string, image_ms bigint, expires_ms bigint"
STORED = "discovered_ms bigint, description_tier int, description_ms bigint, image_updated_ms bigint, independent bigint, sources array<struct<name: string, url: string, source_type: string, at_ms: bigint, fingerprint: string>>"
#: What the fold reads of a row, and what it makes of a story.
FOLD_IN = "story string, seq bigint, repeated boolean, title string, description string, url string, source string, source_type string, tier int, at_ms bigint, latest_ms bigint, lat double, lon double, location_name string, image_url string, image_ms bigint, image_updated_ms bigint, description_tier int, description_ms bigint"
FOLD_OUT = "story string, title string, description string, url string, source string, source_type string, tier int, discovered_ms bigint, published_ms bigint, description_tier int, description_ms bigint, impact_tier int, lat double, lon double, location_name string, image_url string, image_ms bigint, image_updated_ms bigint, title_seq bigint, description_seq bigint"


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def fold_step(state: dict | None, r: dict, now_ms: int) -> dict:
    """A story's state after one more report; the first one, or the stored story itself, begins it."""
    size = lambda x: len((x or "").strip())
    if state is None:
        own = {k: r[k] for k in ("story", "title", "description", "url", "source", "source_type", "tier", "lat", "lon", "location_name", "image_url", "image_ms")}
        told = {"description_tier": r["description_tier"] or r["tier"], "description_ms": r["at_ms"] if r["description_ms"] is None else r["description_ms"]}
        updated = r["image_ms"] if r["image_updated_ms"] is None else r["image_updated_ms"]
        return own | told | {"discovered_ms": r["at_ms"], "published_ms": max(r["latest_ms"], r["at_ms"]), "impact_tier": r["tier"], "image_updated_ms": updated, "title_seq": r["seq"], "description_seq": r["seq"]}
    s = dict(state)
    s["published_ms"] = max(s["published_ms"], r["at_ms"])
    if r["repeated"]:
        return s
    s["impact_tier"] = min(state["tier"], r["tier"])
    length, new_length = (len(x["title"] or "") + len(x["description"] or "") for x in (state, r))
    if st.title_wins(state["tier"], state["discovered_ms"], length, r["tier"], r["at_ms"], new_length):
        # the title's report takes the pin along, even where it has none
        s |= {k: r[k] for k in ("title", "url", "source", "source_type", "tier", "lat", "lon", "location_name")} | {"discovered_ms": r["at_ms"], "title_seq": r["seq"]}
    if st.description_wins(state["description_tier"], state["description_ms"], size(state["description"]), r["tier"], r["at_ms"], size(r["description"])):
        s |= {"description": r["description"], "description_tier": r["tier"], "description_ms": r["at_ms"], "description_seq": r["seq"]}
    new_at = r["at_ms"] if r["image_ms"] is None else r["image_ms"]
    old_at = state["discovered_ms"] if state["image_ms"] is None else state["image_ms"]
    changed = old_at if state["image_updated_ms"] is None else state["image_updated_ms"]
    if size(r["image_url"]) and st.image_wins(size(state["image_url"]) == 0, old_at, changed, new_at, now_ms):
        s |= {"image_url": r["image_url"], "image_ms": new_at, "image_updated_ms": now_ms}
    return s


def fold(reports: DataFrame, now_ms: int, batch: int = 1000) -> DataFrame:
    """A story (``FOLD_OUT``) for each ``story`` of ``reports`` (``FOLD_IN``), its rows in order of ``seq``.

    Rows are sorted by story, so a task goes through them with one story's state in hand.
    """
    out = names(FOLD_OUT)
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[part.split()[1]] for part in FOLD_OUT.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for r in chain.from_iterable(frame.slice(i, batch).to_pylist() for frame in frames for i in range(0, frame.num_rows, batch)):
            if state is not None and state["story"] != r["story"]:
                done.append(state)
                state = None
            state = fold_step(state, r, now_ms)
            if len(done) == batch:
                yield pa.RecordBatch.from_arrays([pa.array([s[n] for s in done], k) for n, k in zip(out, kinds, strict=True)], out)
                done = []
        done += [] if state is None else [state]
        yield pa.RecordBatch.from_arrays([pa.array([s[n] for s in done], k) for n, k in zip(out, kinds, strict=True)], out)

    return reports.select(*names(FOLD_IN)).repartition("story").sortWithinPartitions("story", "seq").mapInArrow(run, FOLD_OUT)


def judged(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (seq, id, score) of rows of evidence that do not contradict each other, with both sides as a and b."""
    met = pairs.join(left.alias("a"), F.col("seq") == F.col("a.id")).join(right.alias("b"), pairs["id"] == F.col("b.id"))
    return met.where(~st.conflicts("a", "b"))


def near_place() -> Column:
    """Whether both sides of a judged pair lie precisely, and within 50 km."""
    far = st.geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return F.col("a.precise") & F.col("b.precise") & (far <= st.MERGE_KM)


#: What ``stories.conflicts`` reads of a row besides its identity and time.
JUDGED = ["fp", "template", "dated", "quiz", "contest", "sports", "cups", "genders", "incident", "sites", "market", "follow_up", "weekdays", "deal", "named", "precise", "countries", "lat", "lon"]


def titled(incoming: DataFrame, recent: DataFrame) -> DataFrame:
    """(seq, story, score 2) of each report with a title of 24 characters or more that a story has: the smallest id that does not contradict it.

    Stories and reports of one title that no contradiction can tell apart are one class, of which the smallest id stands
    for all, so that classes meet and not each report each story.  One identity is never a contradiction, so the
    smallest story of a report's own identity is found beside that.
    """
    # times count only in what tells of a market's session or of one weekday, and places where they are said to be right
    timed = F.col("market") | (F.col("incident") & (F.bit_count("weekdays") == 1) & ~F.col("follow_up"))
    placed = F.col("precise") | F.col("named")
    own = {"at_ms": F.when(timed, F.col("at_ms")), "lat": F.when(placed, F.col("lat")), "lon": F.when(placed, F.col("lon")), "countries": F.array_sort("countries")}
    marked = lambda df: df.where("length(fp) >= 24").withColumns(own)
    kind = [*JUDGED, "at_ms"]
    reports = marked(incoming).select("id", "identity", *kind, F.xxhash64(*kind).alias("_class"))
    stories = marked(recent).select("id", "identity", *kind)
    # rows of a class never share an identity with those that they meet: that is judged below
    asked = reports.select("_class", *kind).distinct().withColumn("identity", F.lit("asked")).alias("a")
    held = stories.groupBy(*kind).agg(F.min("id").alias("story")).withColumn("identity", F.lit("held")).alias("b")
    fits = asked.join(held, F.col("a.fp") == F.col("b.fp")).where(~st.conflicts("a", "b"))
    fits = fits.groupBy(*[F.col(f"a.{c}").alias(c) for c in ("_class", *kind)]).agg(F.min("b.story").alias("story"))
    same = reduce(lambda p, q: p & q, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in kind if c != "fp"], F.col("r.fp") == F.col("f.fp"))
    met = reports.alias("r").join(fits.alias("f"), (F.col("r._class") == F.col("f._class")) & same).select(F.col("r.id").alias("seq"), "f.story")
    twins = stories.groupBy("fp", "identity").agg(F.min("id").alias("story"))
    both = reports.alias("r").join(twins.alias("t"), (F.col("r.fp") == F.col("t.fp")) & F.col("r.identity").eqNullSafe(F.col("t.identity"))).select(F.col("r.id").alias("seq"), "t.story")
    return met.union(both).groupBy("seq").agg(F.min("story").alias("story")).withColumn("score", F.lit(2.0))


def assignments(incoming: DataFrame, stored: DataFrame, now_ms: int) -> DataFrame:
    """(seq, id, score) of the stored story that each incoming report goes to, if any: rows of evidence on both sides.

    Equal titles of 24 characters or more count first (score 2); reports without any are compared by vectors with the
    nearest twelve stories, and with fifty where none of a full twelve is eligible.  Stories older than 48 hours and
    pairs that contradict each other are out.
    """
    recent = stored.where(F.col("published_ms") >= now_ms - st.HORIZON_MS)
    exact = titled(incoming, recent).checkpoint()
    open_ = incoming.join(exact.select(F.col("seq").alias("id")).distinct(), "id", "left_anti")
    near = st.knn(open_.select("id", "embedding"), recent.select("id", "embedding"), st.EXPANDED_K).toDF("seq", "id", "score", "rank")
    met = near.join(open_.alias("a"), F.col("seq") == F.col("a.id")).join(recent.alias("b"), near["id"] == F.col("b.id"))
    met = met.select(F.col("seq").alias("query_id"), near["id"].alias("story"), "score", "rank", (st.passes(F.col("score"), near_place()) & ~st.conflicts("a", "b")).alias("fits"))
    near = st.expanded(met, F.col("fits")).where("fits").select(F.col("query_id").alias("seq"), "story", "score")
    best = F.min_by(F.struct("story", "score"), F.struct(-F.col("score"), F.col("story"))).alias("best")
    return exact.unionByName(near).groupBy("seq").agg(best).select("seq", "best.*")


def pending_links(rows: DataFrame) -> DataFrame:
    """(seq, parent): the earlier report, of rows of evidence, that each report without a stored story joins, if any.

    The first report of its identity, else the first of its title (24 or more) at its place or anywhere, else the one
    of the nearest vector among the twelve nearest before it; contradictions are out.
    """
    first = lambda df, *by: df.groupBy(*by).agg(F.min("id").alias("first"))
    same = rows.join(first(rows, "identity"), "identity").where("first < id").select(F.col("id").alias("seq"), F.col("first").alias("id"), F.lit(3.0).alias("score"))
    cell = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws("/", F.floor(F.col("lat") * 2), F.floor(F.col("lon") * 2)))
    titled = rows.where("length(fp) >= 24").select("id", "fp", F.coalesce(cell, F.lit("")).alias("cell"))
    titles = [titled.join(first(titled, *by), by).where("first < id").select(F.col("id").alias("seq"), F.col("first").alias("id"), F.lit(score).alias("score")) for by, score in ((["fp", "cell"], 2.5), (["fp"], 2.0))]
    vectors = rows.select("id", "embedding")
    near = st.knn(vectors, vectors, st.TOP_K, earlier=True).select(F.col("query_id").alias("seq"), F.col("neighbour_id").alias("id"), F.col("similarity").alias("score"))
    pairs = reduce(DataFrame.unionByName, [same, *titles, near])
    # identities agree or titles do, or the vectors are near enough
    fits = judged(pairs, rows, rows).where((F.col("score") >= 2) | st.passes(F.col("score"), near_place()))
    return fits.select("seq", pairs["id"].alias("parent"), "score").groupBy("seq").agg(F.min_by("parent", F.struct(-F.col("score"), F.col("parent"))).alias("parent"))


def resolve_stories(incoming: DataFrame, stored: DataFrame, gazetteer: DataFrame, now_ms: int) -> DataFrame:
    """The stories that ``incoming`` reports make or change.

    ``incoming`` has (seq bigint, ..``REPORT``), seq the order of arrival; ``stored`` has (id bigint, ..``REPORT``,
    ..``STORED``).  The result has the columns of ``FOLD_OUT`` but ``story`` and the seqs, and

    - id, null for a new story, and first_seq, its first report, null for a stored one;
    - sources: all reports but the title's, once for each identity, in order of arrival; event_count: they and the title's;
    - independent publishers and impact, by the better tier of the last merge;
    - expires_ms, null once a publisher of its own has joined in;
    - embedding: the vector of what now stands there, null where title and description come from different reports.

    Stories that nothing joins are not returned.  An empty ``incoming`` gives none.
    """
    spark = incoming.sparkSession
    st.checkpoint_dir(spark)
    judge = lambda df, at: st.evidence(st.named_countries(st.precise(df.withColumn("at_ms", F.coalesce(at, "published_ms")), gazetteer), gazetteer))
    ein = judge(incoming.withColumnRenamed("seq", "id").drop("at_ms"), F.lit(None).cast("bigint")).checkpoint()
    est = judge(stored, F.col("discovered_ms")).checkpoint()
    taken = assignments(ein, est, now_ms).select("seq", "story").checkpoint()
    left = ein.join(taken.select(F.col("seq").alias("id")), "id", "left_anti").checkpoint()
    roots = st.components(left.select("id"), pending_links(left).select(F.col("parent").alias("a"), F.col("seq").alias("b")))
    place = taken.select(F.col("seq").alias("id"), F.concat(F.lit("s"), F.col("story").cast("string")).alias("story"))
    place = place.unionByName(roots.select("id", F.concat(F.lit("n"), F.col("component").cast("string")).alias("story")))

    # every article of a story in order: the stored one, its sources, then the reports
    touched = taken.select(F.col("story").alias("id")).distinct()
    old = est.join(touched, "id", "left_semi").withColumn("story", F.concat(F.lit("s"), F.col("id").cast("string")))
    new = ein.join(place, "id").withColumn("seq", F.col("id"))
    bare = ["story", "ord", "name", "url", "source_type", "at_ms", "fingerprint"]
    primary = old.select("story", F.lit(-2**62).alias("ord"), F.col("source").alias("name"), "url", "source_type", "at_ms", F.col("fp").alias("fingerprint"))
    kept = old.select("story", F.posexplode("sources").alias("p", "x")).select("story", (F.col("p") - 2**61).alias("ord"), "x.name", "x.url", "x.source_type", "x.at_ms", "x.fingerprint")
    came = new.select("story", F.col("seq").alias("ord"), F.col("source").alias("name"), "url", "source_type", "at_ms", F.col("fp").alias("fingerprint"))
    articles = reduce(DataFrame.unionByName, [x.select(*bare) for x in (primary, kept, came)]).withColumn("identity", text.report_identity(F.col("url")))
    once = Window.partitionBy("story", "identity").orderBy("ord")
    articles = articles.withColumn("_nth", F.row_number().over(once)).checkpoint()

    # the fold, in which a report that is there already moves the time alone
    again = articles.where("_nth > 1").select("story", F.col("ord").alias("seq"), F.lit(True).alias("repeated"))
    none = F.lit(None).cast("bigint")
    begin = old.withColumns({"seq": F.lit(-1).cast("bigint"), "repeated": F.lit(False), "latest_ms": F.coalesce("published_ms", "at_ms")})
    steps = new.join(again, ["story", "seq"], "left").withColumns({"repeated": F.coalesce("repeated", F.lit(False)), "latest_ms": F.col("at_ms"), "description_tier": F.lit(None).cast("int"), "description_ms": none, "image_updated_ms": none})
    rows = begin.select(*names(FOLD_IN)).unionByName(steps.select(*names(FOLD_IN)))
    filled = rows.withColumns({"tier": F.coalesce("tier", F.lit(3)), "at_ms": F.coalesce("at_ms", F.lit(0))}).withColumn("latest_ms", F.coalesce("latest_ms", "at_ms"))
    path = new_folder(spark, "stories")
    fold(filled, now_ms).write.parquet(path)
    folded = spark.read.parquet(path)

    # sources, counts and scores, by joins with the title's report
    lead = folded.select("story", text.report_identity(F.col("url")).alias("lead"))
    members = articles.join(lead, "story")
    others = members.where((F.col("_nth") == 1) & ~F.col("identity").eqNullSafe(F.col("lead")))
    listed = others.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "url", "source_type", "at_ms", "fingerprint"))).alias("l"))
    listed = listed.select("story", F.expr("transform(l, x -> struct(x.name, x.url, x.source_type, x.at_ms, x.fingerprint))").alias("sources"))
    publisher = corroboration.publisher_key(F.col("name"), F.col("url"), F.col("source_type"))
    heads = folded.select("story", F.lit(-2**63).alias("ord"), text.report_identity(F.col("url")).alias("identity"), publisher_of_head().alias("publisher"), text.fingerprint(F.col("title")).alias("fingerprint"))
    counted = others.select("story", "ord", "identity", publisher.alias("publisher"), "fingerprint").unionByName(heads)
    independent = corroboration.independent_sources(counted, ["story"], "ord")
    before = old.select("story", F.coalesce("independent", F.lit(1)).alias("_before"), F.col("expires_ms").alias("_expires"), F.col("embedding").alias("_vector"))
    vectors = new.select(F.col("seq").alias("title_seq"), F.col("embedding").alias("_own"), F.col("expires_ms").alias("_first"))
    out = folded.join(listed, "story", "left").join(independent, "story").join(before, "story", "left").join(vectors, "title_seq", "left")
    roots_ = new.where(F.col("story") == F.concat(F.lit("n"), F.col("seq").cast("string"))).select("story", F.col("expires_ms").alias("_root"))
    out = out.join(roots_, "story", "left")
    stored_one = F.col("story").startswith("s")
    number = F.expr("cast(substring(story, 2) as bigint)")
    gained = F.col("independent") > F.coalesce("_before", F.lit(1))
    one_report = F.col("title_seq") == F.col("description_seq")
    sources = F.coalesce("sources", F.expr("cast(array() as array<struct<name: string, url: string, source_type: string, at_ms: bigint, fingerprint: string>>)"))
    return out.select(
        F.when(stored_one, number).alias("id"),
        F.when(~stored_one, number).alias("first_seq"),
        *[c for c in names(FOLD_OUT) if c not in ("story", "title_seq", "description_seq")],
        sources.alias("sources"),
        (F.size(sources) + 1).cast("bigint").alias("event_count"),
        "independent",
        scores.impact(F.col("impact_tier"), F.col("independent")).alias("impact"),
        F.when(~gained, F.coalesce("_expires", "_root")).alias("expires_ms"),
        F.when(one_report, F.when(F.col("title_seq") == -1, F.col("_vector")).otherwise(F.col("_own"))).alias("embedding"),
    )


def publisher_of_head() -> Column:
    return corroboration.publisher_key(F.col("source"), F.col("url"), F.col("source_type"))


def image_targets(stories: DataFrame, tried: DataFrame) -> DataFrame:
    """(id, url, priority) to look for a picture at, one for each story: stories without one first, then the newest report.

    ``tried`` has (id, url, at_ms, image_url) of reports that joined a story; those with a picture of their own need none.
    """
    lacking = F.coalesce(F.trim("s.image_url"), F.lit("")) == ""
    open_ = st.image_wins(lacking, F.coalesce("s.image_ms", "s.published_ms"), F.coalesce("s.image_updated_ms", "s.image_ms", "s.published_ms"), F.col("t.at_ms"), F.col("s.now_ms"))
    met = tried.alias("t").where("t.image_url is null").join(stories.alias("s"), F.col("t.id") == F.col("s.id")).where(open_)
    priority = F.when(lacking, 0).otherwise(2)
    best = F.min_by(F.struct(F.col("t.url").alias("url"), priority.alias("priority")), F.struct(priority, -F.col("t.at_ms"), F.col("t.url"))).alias("best")
    return met.groupBy(F.col("s.id").alias("id")).agg(best).select("id", "best.*")

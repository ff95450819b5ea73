import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from brute import attention_score, contamination, kd_shards, near_duplicates
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import learning, media, quality, sentencepieces, shards, toxicity, warc
from tidewire.llm.common import Scratch, crc_mod
from tidewire.llm.pieces import load
from tidewire.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string"
EDGE = [(None, None), (None, ""), (5, "dup"), (5, "dup"), (6, None), (None, "a" * 70_000), (7, "É🙂")]


def corpus(n=400, seed=0):
    """Documents with labels: shouting is of low quality, a few words are toxic; benchmark passages and near copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["grumblefoo", "snarkbar", "vexqux"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic, low = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(bad)
        joined = " ".join(text)
        docs.append((i, joined.upper().replace(" ", "!! ") if low else joined))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    return docs, labels


def write_corpus(spark, path, docs, labels, items):
    frame = spark.createDataFrame(docs, SCHEMA).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize(("run", "column", "place", "fold"), [(toxicity.toxicity, "toxic", 2, 5), (quality.quality, "quality", 1, 3)])
def test_classifiers_on_held_out_rows(spark, run, column, place, fold):
    docs, labels = corpus(900)
    truth = {x[0]: x[place] for x in labels}
    rows = run(spark.createDataFrame([*docs, *EDGE], SCHEMA).withColumn("score", F.lit("x")), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")).collect()
    assert len(rows) == len(docs) + len(EDGE)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 10]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % fold == (0 if fold == 5 else 1) for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93, column


def test_classifiers_do_not_see_held_out_labels(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, SCHEMA)
    plain = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for run, mod, rest in ((toxicity.toxicity, 5, 0), (quality.quality, 3, 1)):
        held = crc_mod("doc_id", mod) == rest
        flipped = plain.select("doc_id", *[F.when(held, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
        a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in run(frame, x).collect()) for x in (plain, flipped))
        assert a == b


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {1.0}
    assert quality.quality(docs.limit(0), none).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.DIM)) for n in (1, 4, 2)]
    y = np.array([1.0, 0.0, 1.0])
    model = quality.fit(bags, y, epochs=1)
    x, first = np.concatenate(bags), np.array([0, 1, 5])
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, first)[0]) + (1 - y) * np.log(1 - s))
    grads = model.gradient(x, first, y)
    grads[0] = grads[0] - 1e-4 * model.params[0]
    for p, g in zip(model.params, grads, strict=True):
        at = tuple(0 for _ in p.shape)
        old, eps = p[at], 1e-5
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-6


def test_scores_equal_plain_python(spark):
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.DIM)) for n in (1, 4, 2, 3)]
    model = quality.fit(bags, np.array([1.0, 0.0, 1.0, 0.0]), epochs=3)
    texts = ["One. Two, three!", "x" * 5000, None, "", "word " * 500, "É🙂\n\n- a\n- b"]
    got = quality.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA), model).collect()
    for r in got:
        assert abs(r["score"] - attention_score(model, next(iter(quality.encode(pa.array([r["text"]], pa.string())))))) < 1e-9


def test_training_takes_long_texts_whole_and_repeated_ids_once(spark):
    words = "alpha beta gamma delta " * 12
    docs = spark.createDataFrame([(1, words * 300 + "THE END!!"), (2, words), *[(2, words)] * 50, (4, "X!! " * 60)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    sample, counts = learning.labelled_sample(docs, learning.labels_of_fold(labels, "quality", 3, 9), 100, 1 << 30, Scratch(spark, "test"), "s")
    assert sorted((r["doc_id"], len(r["text"])) for r in sample.collect()) == [(1, len(words) * 300 + 9), (2, len(words)), (4, 240)] and counts == {0: 5, 1: 5}
    many = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(2000)], SCHEMA)
    some = learning.labelled_sample(many, labels.crossJoin(spark.range(200)).selectExpr("doc_id + 10 * id as doc_id", "quality as y"), 5000, 30_000, Scratch(spark, "test"), "t")[0]
    assert 30_000 < sum(len(r["text"]) for r in some.collect()) < 120_000


def test_unlabelled_risk_gradient():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (80, 3))
    for prior in (0.1, 0.9):
        first = toxicity.nnpu(p, u, prior, epochs=1)
        start = np.array([0.1, 0.1, 0.1, 0.0])

        def risk(c, prior=prior):
            s = lambda x: 1 / (1 + np.exp(-(np.hstack([x, np.ones((len(x), 1))]) @ c)))
            negative = s(u).mean() - prior * s(p).mean()
            # below zero the negative part alone is taken back
            return prior * (1 - s(p)).mean() + negative if negative >= 0 else -negative

        slope = np.array([(risk(start + e) - risk(start - e)) / 2e-6 for e in 1e-6 * np.eye(4)])
        assert np.array_equal(np.sign(first - start), -np.sign(slope + 1e-4 * np.append(start[:3], 0)))


def test_summaries_equal_plain_python():
    text = "Bad worse bad fine! wörter"
    lower = [w.encode() for w in ("bad", "worse", "bad", "fine", "wörter")]
    hashes = [h for _, h, _ in toxicity._features(pa.array([text]))][0]
    assert len(hashes) == len(lower) and len({int(h) for h in hashes[:, 0]}) == 4
    weights = {int(hashes[0, 0]): 5.0, int(hashes[1, 0]): 2.0}
    tokens = np.array(sorted(weights), np.uint64)
    got = toxicity.summaries(pa.array([text, None]), tokens, np.array([weights[int(t)] for t in tokens]))
    assert np.allclose(got, [[5, 7, 7, np.log1p(1), np.log1p(2), np.log1p(5)], [0] * 6])


def test_passages_of_rows_are_independent():
    texts = ["a b c", None, "X!! " * 200, " \n", "end", "q " * 48]
    together = list(quality.encode(pa.array(texts)))
    for text, m in zip(texts, together, strict=True):
        assert np.array_equal(m, next(iter(quality.encode(pa.array([text], pa.string()))))) and len(m) == max(1, -(-len((text or "").split()) // 48))


def test_archives_round_trip(spark):
    pages = [(1, "http://a/ x", "one"), (2, "b", "one"), (3, None, "two\r\n\r\nWARC/1.1\r\n"), (None, "c", None), (4, "d", ""), (5, "e", None), (6, "f", "é" * 5000), (6, "f", "é" * 5000), (None, "g", "alone")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit("x"))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in pages:
        top[digest(h)] = max((x for x in (top.get(digest(h)), i) if x is not None), default=None)
    want = Counter()
    for i, _, h in pages:
        best = top[digest(h)]
        want[i, len((h or "").encode()), digest(h), "response" if i == best else "revisit", None if i == best else best] += 1
    got = warc.archive_round_trip(frame).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    scratch = Scratch(spark, "test")
    warc.deduplicated(frame, scratch.path("w"))
    files = list(Path(scratch.path("w")).glob("*.warc.gz"))
    assert files and not list(Path(scratch.path("w")).glob("*.txt"))
    members = []
    for f in files:
        raw = f.read_bytes()
        while raw:
            d = zlib.decompressobj(31)
            members.append(d.decompress(raw))
            raw = d.unused_data
    assert len(members) == len(pages) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    bodies = warc.read_archives(spark, scratch.path("w")).where("record_type = 'response'").collect()
    assert {r["html"] for r in bodies} == {h or "" for _, _, h in pages}
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_long_records_and_dates(spark):
    frame = spark.createDataFrame([(1, "u", "x" * (17 << 20)), (2, "v", "y")], "page_id bigint, url string, html string")
    path = Scratch(spark, "test").path("long")
    warc.deduplicated(frame, path, "2024-05-06T07:08:09Z")
    assert {r["page_id"]: len(r["html"]) for r in warc.read_archives(spark, path).collect()} == {1: 17 << 20, 2: 1}
    assert all(b"WARC-Date: 2024-05-06T07:08:09Z\r\n" in gzip.decompress(f.read_bytes()) for f in Path(path).glob("*.warc.gz") if f.stat().st_size)


def test_shards_are_near_equal_and_cut_few_groups(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 200)) for i in range(2000)] + [(3000 + i, "copy of one text") for i in range(300)] + EDGE[:-2] + EDGE[-1:]
    got = shards.shard_by_bytes(spark.createDataFrame(rows, SCHEMA).withColumn("tie", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert sorted(total) == list(range(16)) and max(total.values()) < 1.05 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(len(s) > 1 for s in where.values()) <= 15


def test_shards_equal_a_tree_in_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ccc\n"]) for _ in range(rng.randint(0, 60)))) for i in range(500)] + [(600 + i, "copy of one text") for i in range(80)]
    dims = ["log_size", "log_lines", "log_words", "text_crc32"]
    got = {r["doc_id"]: r["shard"] for r in shards.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 6).collect()}
    points = shards.metadata(spark.createDataFrame(rows, SCHEMA)).collect()
    want = kd_shards([r.asDict() for r in points], dims, 6, shards.TIE, shards.ROW, shards.VALUE_TILT, shards.GROUP_TILT)
    assert got == {r["doc_id"]: s for r, s in zip(points, want, strict=True)}


def test_equal_rows_each_have_a_slot(spark):
    rows = [(None, None)] * 9000 + [(1, "x")] * 3 + [(2, "y")]
    got = shards.number_rows(spark.createDataFrame(rows, SCHEMA).withColumn("s", F.lit(0)), "s", Scratch(spark, "test"), 1)
    assert sorted(r["slot"] for r in got.collect()) == list(range(len(rows))) and Counter(tuple(r)[:2] for r in got.collect()) == Counter(rows)


def test_a_group_larger_than_a_shard_is_cut(spark):
    got = shards.shard_by_bytes(spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(1600)], SCHEMA)).collect()
    count = Counter(r["shard"] for r in got)
    assert len(count) == 16 and max(count.values()) < 1.2 * min(count.values())
    assert shards.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_media_round_trip(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(40_000))
    rows = [*EDGE, (20, base), (21, "intro " + base), (22, base[:20_000] + "changed" + base[20_000:]), (23, base)]
    got = media.media_features(spark.createDataFrame(rows, SCHEMA).withColumn("media_key", F.lit(1))).collect()
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = media.payload(raw)
        m = media.to_wav(p)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert media.media_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    a, b = media.split(data), media.split(b"in front" + data)
    assert b"".join(a) == data and all(len(c) <= media.MOST for c in a) and len(set(a) & set(b)) >= len(a) - 2
    h, slow = 0, []
    for byte in data[:500]:
        h = (h * 2 + int(media.GEAR[byte])) % 2**32
        slow.append(h)
    assert media.gear_hashes(np.frombuffer(data[:500], np.uint8)).tolist() == slow


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    docs, labels = corpus(300, 7)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs += [(1000, docs[0][1]), (1001, docs[1][1] + " extra"), (1002, f"words before {passage} words after"), (1003, None)]
    write_corpus(spark, tmp_path, docs, labels, [(1, passage), (2, "not in any of them at all")])
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(frame, table).where("predicted = 1").collect()}
    left = frame.where(~F.col("doc_id").isin(toxic)) if toxic else frame
    low = {r["doc_id"] for r in quality.quality(left, table).where("predicted = 0").collect()}
    rows = [(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] not in low]
    groups = near_duplicates(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    hits = contamination(rows, [(1, passage)])
    rows = [(i, t) for i, t in rows if not hits[i][1]]
    e = sentencepieces.Encoder(load())
    want = {i: (len(ids := e.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True) for i, t in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in got} == want
    assert toxic and low and 1002 not in want and 1000 not in want


def test_stages_return_the_columns_of_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).columns == docs.columns


def test_registered_names():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_a_class_of_few_huge_texts_is_not_lost(spark):
    docs, labels = corpus(400)
    huge = [(10_000 + i, " ".join([t.upper().replace(" ", "!! "), "grumblefoo snarkbar"] * 120)) for i, (_, t) in enumerate(docs[:3])]
    frame = spark.createDataFrame([*docs, *huge], SCHEMA)
    plain = [(i, 1, 0) for i, *_ in labels] + [(i, 0, 1) for i, _ in huge]
    own = learning.labels_of_fold(spark.createDataFrame(plain, "doc_id bigint, quality int, toxic int"), "quality", 3, 9)
    for most_bytes in (100, 4000, 1 << 14, 1 << 24):
        sample, counts = learning.labelled_sample(frame, own, 100, most_bytes, Scratch(spark, "test"), f"s{most_bytes}")
        held = Counter(r["y"] for r in sample.collect())
        assert held[0] == 3 and held[1] >= learning.LEAST and counts == {0: 3, 1: len(labels)}
    toxic = spark.createDataFrame(plain, "doc_id bigint, quality int, toxic int")
    assert toxicity.train(frame, toxic, most_bytes=4000) is not None
    assert len({r["score"] for r in quality.score(frame.limit(50), quality.train(frame, toxic, most_bytes=4000)).collect()}) > 1

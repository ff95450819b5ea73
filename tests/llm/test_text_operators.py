import random

import numpy as np
import pyarrow as pa
import pytest
from brute import bench_words, best_pieces, contamination, greedy_count, near_duplicates
from pyspark.sql import functions as F

from tidewire.llm import common, components, decontaminate, licenses, neardup, sentencepieces, wordpieces
from tidewire.llm.bytes_np import shingle_sets
from tidewire.llm.common import Scratch, lookup_join, salted_join
from tidewire.llm.components import connected_components
from tidewire.llm.pieces import load

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "a b c d e f"), (7, "a b c d e f"), (8, "é ü É"), (9, "x " * 30_000), (None, "a b c d e f"), (None, None), (10, "🙂 a▁b  c\x00")]
SCHEMA = "doc_id bigint, text string"


def frame(spark, rows):
    """Documents with an extra column under a name that operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("x")).withColumn("n", F.lit(1))


def mutated(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.6:
            w = list(rng.choice(made))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 30, 80]))]
        made.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = mutated()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), k=k).collect()}
    assert got == near_duplicates(rows, k)


def test_near_duplicates_on_edges(spark):
    rows = neardup.near_duplicates(frame(spark, [*EDGE, (6, "a b c d e f")]), k=2).collect()
    assert len(rows) == len(EDGE) + 1
    own = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert own[1, 0] == (1, True) and own[2, 0] == (2, True) and own[3, 0] == (3, True)
    assert own[4, 1] == (4, True) and own[5, 1] == (4, False)
    assert own[6, 5] == (6, True) and own[7, 5] == (6, False) and own[None, 5] == (6, False)
    assert own[None, 0] == (None, True)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_rows_without_an_id_are_linked_and_told_apart(spark):
    import corpus_pipeline

    words = [[f"{c}{i}" for i in range(80)] for c in "abcde"]
    near = lambda w, at: " ".join([*w[:at], "other", *w[at + 1 :]])
    texts = [" ".join(w) for w in words]
    gone = [texts[0], near(words[1], 40), near(words[4], 40)]
    stay = [texts[2], texts[3], near(words[3], 40), texts[3], None, None, ""]
    # the last one's chain: 5 is linked with the row without an id, which alone links it with 6
    last = [(5, near(words[4], 40).replace(" e20 ", " another ")), (6, texts[4])]
    rows = [(1, texts[0]), (2, texts[1]), *[(None, t) for t in gone + stay], *last]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").select("doc_id", "text").collect()]
    kept = [(1, texts[0]), (2, texts[1]), last[0], *[(None, t) for t in stay]]
    assert sorted(got, key=repr) == sorted(kept, key=repr)
    found = neardup.near_duplicates(frame(spark, rows)).where("doc_id is null and n_shingles > 0").collect()
    assert sorted((r["component_id"] or 0, r["kept"]) for r in found) == [(0, True)] * 4 + [(1, False), (2, False), (5, False)]


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (7, None), (8, b), (8, b)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("_id", "_key", "_gone_id", "text_key", "_key2")})
    got = neardup.without_copies(docs)
    assert got.columns == docs.columns and {r["_id"] for r in got.collect()} == {"own"}
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(3, a), (7, b), (7, None)], key=repr)


def test_near_duplicates_where_the_smallest_node_is_linked_with_none(spark):
    # one bucket for all: nodes 1.. are a chain of near copies, node 0 shares a third of each
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join([f"v{i}" for i in range(80)] + base[:60]))]
    for i in range(1, 40):
        own = [f"x{j}" if j % 3 == 0 and j < 4 * i else w for j, w in enumerate(base)]
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=2).collect()}
    assert got == near_duplicates(rows, 2)


@pytest.mark.parametrize("limit", [1000, 2])
def test_lookup_join_equals_a_join(spark, limit):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("k"), "id")
    found = Scratch(spark, "test").save(spark.createDataFrame([("hot", 1), *[(str(i), i) for i in range(30)]], "k string, v int"), "found")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (sorted(map(tuple, x.select(*sorted(x.columns)).collect()), key=repr) for x in (lookup_join(rows, found, "k", how, limit), rows.join(found, "k", how)))
        assert a == b, how


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 3000, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        bits = sum(int(a).bit_count() for a in (neardup.parity_sketch(x) ^ neardup.parity_sketch(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    x, y = base[:1200], base[300:]
    same = (neardup.circulant_signature(x, 1024) == neardup.circulant_signature(y, 1024)).mean()
    assert abs(same - 900 / 1500) < 0.06


def test_shingles_of_slices_and_short_texts():
    column = pa.array(["skip", "A b\tc", "a B c", None, "a", "a b"])
    sets = list(shingle_sets(column.slice(1), 3))
    assert np.array_equal(sets[0], sets[1]) and [len(s) for s in sets] == [1, 1, 0, 1, 1]
    assert not np.array_equal(sets[3], sets[4])


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 60).select((F.col("id") * 7 % 60).alias("a"), ((F.col("id") + 1) * 7 % 60).alias("b"))
    labels = connected_components(edges, Scratch(spark, "test"), "path").collect()
    assert {r["component"] for r in labels} == {0} and len(labels) == 60


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_contamination_equals_brute_force(spark, limit):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 25])))) for i in range(12)] + [(90, ""), (91, None), (92, "Solo")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 5, 130, 300]))]
        if i % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, "; ".join(text)))
    docs += [(100, "solo É"), (101, None)]
    found = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_rows=limit).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found} == contamination(docs, items)


def test_contamination_on_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (None, "é")], "item_id bigint, text string")
    rows = decontaminate.contamination(frame(spark, EDGE), items).collect()
    assert len(rows) == len(EDGE) and sum(r["contaminated"] for r in rows) == 4
    assert decontaminate.contamination(frame(spark, EDGE), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), items).count() == 0
    assert decontaminate.decontaminate(frame(spark, EDGE), items).count() == len(EDGE) - 4


def test_decontamination_keeps_columns_of_any_name(spark):
    names = ["_id", "_key", "_text_key", "_bad_id", "w", "kept", "a.b", "all"]
    docs = spark.createDataFrame([*EDGE, (6, "clean text")], SCHEMA).withColumns({c: F.lit(c) for c in names})
    got = decontaminate.decontaminate(docs, spark.createDataFrame([("x", "a b c d e f", 1)], "key string, body string, item_id int"), item_id_col="key", item_text_col="body")
    assert got.columns == docs.columns and got.count() == len(EDGE) - 2
    assert {tuple(r[2:]) for r in got.collect()} == {tuple(names)}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not in any of them")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_score", "score", "_id", "_key", "y", "a`b", "bands", "node"]
    docs = spark.createDataFrame([(1, "one text of some words"), (2, None), (None, "another text")], SCHEMA).withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


def test_viterbi_equals_plain_dynamic_programming():
    v = load()
    e = sentencepieces.Encoder(v)
    scores = {t: s for t, s, o in zip(v.texts, v.scores, v.ordinary, strict=True) if o}
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("thequick brown日é🙂") for _ in range(rng.randint(1, 40))).replace(" ", "▁")
        path = e.viterbi(text)
        assert sum(v.scores[p] if p >= 0 else e.unknown for _, p in path) == best_pieces(text, scores, e.unknown)


def test_many_cuts_at_a_time_equal_one_by_one():
    e = sentencepieces.encoder(load())
    rng = random.Random(11)
    cuts = ["".join(rng.choice("thequick brown日é🙂▁\u0300") for _ in range(rng.randint(1, 70))) for _ in range(400)] + ["a", " ", "\n", "x" * 5000]
    flat, sizes = e.encode_cuts(cuts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [tuple(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)] == [e._segment(c) for c in cuts]
    texts = pa.array(["a  b", None, "", "a  b\n\nc ", "é" * 3_000_000, " x"])
    got = [ids[i:j].tolist() for ids, begin in e.encode_texts(texts) for i, j in zip(begin[:-1], begin[1:], strict=True)]
    assert len(got) == len(texts) and got[:4] == [e.encode(t or "") for t in texts.to_pylist()[:4]] and e.decode(got[4]) == texts[4].as_py()


def test_ranks_stand_for_frequencies():
    from tidewire.llm.pieces import log_scores

    assert log_scores([-0.5, -3.25]) == [-0.5, -3.25] and log_scores([]) == []
    falling = log_scores([-2.0, -3.0, -31740.0])
    assert falling == sorted(falling, reverse=True) and max(falling) < 0


def test_encodings_come_near_to_the_library(sf_small):
    sentencepiece = pytest.importorskip("sentencepiece")
    import pyarrow.parquet as pq
    from collections import Counter

    from tidewire.llm.pieces import PIECE_MODEL

    library, e = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), sentencepieces.encoder(load())
    texts = [t or "" for t in pq.read_table(f"{sf_small}/documents.parquet").column("text").to_pylist()]
    pairs = [(e.encode(t), library.encode(t)) for t in texts]
    both = sum(sum((Counter(a) & Counter(b)).values()) for a, b in pairs)
    assert both > 0.85 * sum(len(b) for _, b in pairs) and sum(len(a) for a, _ in pairs) < 1.01 * sum(len(b) for _, b in pairs)


def test_encoding_round_trips(spark):
    texts = [*EDGE, (11, " lead"), (12, "trail \n\n x  "), (13, "▁"), (14, "<s>")]
    coded = sentencepieces.encode_column(frame(spark, texts).withColumn("token_ids", F.lit(0)))
    back = sentencepieces.decode_column(coded).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == len(texts)
    assert all(r["round_trip"] for r in sentencepieces.encoding_digest(frame(spark, texts)).collect())


def test_cutting_loses_nothing():
    e = sentencepieces.Encoder(load())
    whole = sentencepieces.Encoder(load())
    whole.cuts = False
    for text in ("a  b c\n d", "the end.\nThe beginning", "  x"):
        assert e.encode(text) == whole.encode(text)


def test_longest_match_counts(spark):
    initial, inner = ["a", "abcd", "un", "u"], ["b", "c", "bcx", "aff", "able", "a"]
    m = wordpieces.LongestMatch(initial, inner)
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abcdxunfle") for _ in range(rng.randint(0, 9)))
        assert m.count(word) == greedy_count(word, initial, inner), word
    rows = wordpieces.token_counts(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and all(r["n_tokens"] >= r["n_words"] for r in rows)


def test_longest_match_equals_the_word_piece_library():
    tokenizers = pytest.importorskip("tokenizers")
    initial, inner = wordpieces.vocabulary_pieces(load())
    names = {x: i for i, x in enumerate(dict.fromkeys([*initial, *(f"##{x}" for x in inner), "[UNK]"]))}
    library = tokenizers.Tokenizer(tokenizers.models.WordPiece(names, unk_token="[UNK]", max_input_chars_per_word=10**6))
    m = wordpieces.matcher(load())
    for word in ("internationalisation", "zzzz", "日本", "Éclair", "a1b2", "supercalifragilistic" * 20):
        tokens = library.encode(word).tokens
        assert m.count(word) == (-1 if tokens == ["[UNK]"] else len(tokens))


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    words = mit.split()
    altered = " ".join("zzz" if i == 20 else w for i, w in enumerate(words))
    filler = " ".join(f"f{i}" for i in range(40_000))
    rows = [*EDGE, (20, f"{filler} {mit.upper()} {filler}"), (21, altered), (22, " ".join(words[:8])), (23, "x. Licensed under CC BY-NC 4.0. y"), (24, "all rights"), (25, "reserved")]
    found = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert found[20] == ["MIT"] and found[21] == ["MIT"] and found[22] == [] and found[23] == ["CC-BY-NC-4.0"]
    assert found[24] == found[25] == found[1] == [] and licenses.bands_for(0.6, 0.999) == 16


def test_altered_notices_are_found_as_brute_force_finds_them():
    k, least = 3, 0.8
    index = licenses.Index(licenses.TEMPLATES, k, licenses.bands_for(0.75, 0.999), least)
    rng = random.Random(8)
    sets = {}
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            sets[name, text] = {tuple(w[i : i + k]) for w in (bench_words(text),) for i in range(len(w) - k + 1)}
    for (name, text), base in sets.items():
        w = bench_words(text)
        made = []
        for i in range(len(w) + 1):
            made += [w[:i] + ["zzz"] + w[i:], w[:i] + w[i + 1 :], w[:i] + ["qqq"] + w[i + 1 :]]
            made.append([x if rng.random() < 0.95 else "rrr" for x in w])
        column = pa.array([" ".join(["aa", "bb", *x, "cc", "dd"]) for x in made])
        found = [b for hashes, first in licenses.text_words(column) for b in index.scan(hashes, first, least)]
        for x, got in zip(made, found, strict=True):
            held = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            shares = {}
            for (other, _), s in sets.items():
                shares[other] = max(shares.get(other, 0), len(s & held) / len(s))
            # what is found is held; what is held is found, unless another license's template there is held more fully
            assert all(shares[n] >= least - 1e-9 for n in got)
            if len(base & held) >= least * len(base) - 1e-9:
                assert name in got or any(len(s & held) > len(base & held) for (other, _), s in sets.items() if other in got), (name, x)


def test_templates_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "My-License.txt").write_text("you may do with this work what you like\n")
    found = licenses.license_scan(spark.createDataFrame([(1, "X. You may do with this work, what you like.")], SCHEMA), templates=licenses.read_templates(spark, str(tmp_path))).first()
    assert found["licenses"] == ["My-License"] and found["containments"] == [1.0]


def test_texts_that_share_an_id_are_linked_by_what_each_of_them_is_like(spark):
    rng = random.Random(4)
    one, two = ([f"{c}{rng.randint(0, 999)}" for _ in range(80)] for c in "ab")
    near = [*two[:40], "new", *two[41:]]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, " ".join(near)), (7, " ".join([*one[:20], "other", *one[21:]])), (None, " ".join([*near, "end"]))]
    for own in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, own), k=2).collect()}
        assert got == {(5, 5, True), (9, 5, False), (7, 5, False), (None, 5, False)}
        assert sorted(r["text"] for r in neardup.without_copies(frame(spark, own), k=2).collect()) == sorted([rows[0][1], rows[1][1]])


@pytest.mark.parametrize("block", [2, 7, 256])
def test_large_buckets_are_compared_group_by_group(spark, monkeypatch, block):
    """Texts of one template that lie around the threshold, so that buckets stay torn after the drawn nodes."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(60), rng.choice([4, 5, 6, 7])):
            w[j] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), k=2).collect()}
    assert got == near_duplicates(rows, 2)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_hubs_are_dealt_out(spark, monkeypatch, few):
    monkeypatch.setattr(common, "SALTED_ROWS", few)
    monkeypatch.setattr(components, "HUB_EDGES", few)
    pairs = spark.createDataFrame([(7, i) for i in range(3000)] + [(i, i + 1) for i in range(50)] + [(None, 1), (99_999, 2)], "a bigint, b bigint").repartition(3)
    found = spark.createDataFrame([(i, "x" * 10) for i in range(60)], "a bigint, items string")
    rows = Scratch(spark, "test").save(pairs, "pairs")
    assert sorted(tuple(r) for r in salted_join(rows, found, "a").select("a", "b", "items").collect()) == sorted(tuple(r) for r in rows.join(found, "a").select("a", "b", "items").collect())
    edges = spark.createDataFrame([(10_000, i) for i in range(4000)] + [(i, i + 20_000) for i in range(0, 4000, 2)] + [(50_000, 50_001)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "test"), "hub").collect()}
    assert len(got) == 6003 and {v for k, v in got.items() if k < 50_000} == {0} and got[50_001] == got[50_000] == 50_000


def test_only_nodes_that_share_a_bucket_go_further(spark, monkeypatch):
    saved, real = {}, common.Scratch.save

    def save(self, df, name):
        out = real(self, df, name)
        saved[name] = sorted(tuple(r) for r in out.select("node").collect()) if "node" in out.columns else None
        return out

    monkeypatch.setattr(common.Scratch, "save", save)
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), *[(10 + n, " ".join(f"x{n}y{i}" for i in range(50))) for n in range(20)]]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 1 if i < 3 else i for i, _ in rows}
    assert len(saved["alike"]) == 2 and len(saved["nodes"]) == 22 and saved["sets"] == saved["alike"]
    # counts that are known already are not found again
    many = spark.createDataFrame([(i % 3 if i < 2900 else i, i) for i in range(3000)], "k bigint, v bigint")
    found = many.groupBy("k").agg(F.count("*").alias("n"))
    told, counted = (sorted(map(tuple, common.lookup_join(many, found, "k", limit=0, held=h).select("k", "v", "n").collect())) for h in ("n", None))
    assert told == counted and len(told) == 3000


def test_long_rows_are_not_dealt_out_to_find_nodes_and_members(spark, monkeypatch):
    """Nodes are found without a shuffle of sketches, members by one shuffle of two numbers, sets of large buckets alone move."""
    plans, real = {}, common.Scratch.save

    def save(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(common.Scratch, "save", save)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [*mutated(3, 60), (100, "a b c d"), (101, "A b c d"), (102, None)]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), k=2).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == near_duplicates(rows, 2)
    assert "hashpartitioning" not in plans["nodes"]
    assert plans["members"].count("hashpartitioning") == 1 and "Join" not in plans["members"]
    assert "bands" not in plans["rest"]


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    """Copies, nodes and sets that are too many for a broadcast are joined by a shuffle, with the same result."""
    monkeypatch.setattr(neardup, "sized", lambda df: df)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = [*mutated(4, 60), *[(200 + i, "the same text as all of these") for i in range(20)], (300, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), k=2).collect()}
    assert got == near_duplicates(rows, 2)

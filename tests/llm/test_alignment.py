import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewire.llm import alignment
from tidewire.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, n_a string, key double, groups int"
TRICKY = [
    None, "", " ", "one", "  two   spaces ", "tabs\tand\nlines\r\n\n end ", "<|endoftext|> and <s> </s>", "a▁b", "é ü Á ́x 🙂🙂 漢字かな", "a\x1cb \x1f c\x85d　e", "don't 's it'S 12345 6,789.0",
    "x" * 3000, "word " * 3000, "a\x00b", "\x00", "   ", "\n", "a  b", " lead", "trail ",
]


def brute(rows):
    """{row number: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}: whole texts, and ranges by their ends."""
    one = Tokenizer.from_file(alignment.tokenizer_paths()[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_paths()[1])
    to_byte = alignment.byte_alphabet()
    links, groups, sizes, held = {}, {}, {}, Counter()
    for at, text in enumerate(rows):
        links[at], groups[at], sizes[at] = [], [], (0, 0)
        if not text:
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        x = [bytes(to_byte[c] for c in one.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            continue
        p, q = (np.cumsum([0, *map(len, z)]) for z in (x, y))
        links[at] = [(a[i], b[j]) for i in range(len(a)) for j in range(np.searchsorted(q, p[i], "right") - 1, np.searchsorted(q, p[i + 1], "left"))]
        ends = sorted({*p[1:]} & {*q[1:]})
        before = 0
        for e in ends:
            inside = lambda z, ids: ",".join(map(str, ids[np.searchsorted(z, before) : np.searchsorted(z, e)]))  # noqa: B023, E731
            groups[at].append(f"{inside(p, a)}|{inside(q, b)}")
            before = e
        sizes[at] = len(a), len(b)
        held.update(set(links[at]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return {at: (*sizes[at], len(groups[at]), len(own), sum(held[x] == best[x[0]] for x in own), sum(held[x] for x in own), ";".join(groups[at])) for at, own in links.items()}


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gammas", "naïve", "don't", "42", "3.14", "tokenisation", "🙂", "weiß", "the", "of"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ", ", "\t", "."]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 22, 200])
def test_alignment_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(alignment.partial_counts, "__defaults__", (most,))
    rows = [*TRICKY, *texts(120), *[texts(1, 7)[0]] * 60]
    frame = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in enumerate(rows)], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in alignment.align_documents(frame).collect()}
    wanted = brute(rows)
    for i, t in enumerate(rows):
        assert got[i] == wanted[i], (i, repr(t)[:80])
    assert got[TRICKY.index("a▁b")] == (0, 0, 0, 0, 0, 0, "") and got[TRICKY.index("one")][0] > 0


def test_alignment_on_edges(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    own = spark.createDataFrame([("x1", "same text"), ("x1", "same text"), (None, "same text"), ("y", None)], "name string, text string")
    got = alignment.align_documents(own, id_col="name").collect()
    assert sorted((r["name"] or "", r["n_best"] == r["n_links"], r["count_sum"] == 3 * r["n_links"]) for r in got) == [("", True, True), ("x1", True, True), ("x1", True, True), ("y", True, True)]
    none = alignment.align_documents(spark.createDataFrame([(1, None, "", 0.0, 1)], SCHEMA)).collect()
    assert [(r["n_a"], r["groups"]) for r in none] == [(0, "")]


def test_runs_are_summed_and_shards_looked_up(spark, tmp_path):
    rng = np.random.default_rng(0)
    keys = (rng.integers(0, 9, 5000) << 32) | rng.integers(0, 300, 5000)
    partial = spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, rng.integers(1, 5, 5000), strict=True)], "key bigint, n bigint").repartition(6).cache()
    shards, best = alignment.write_shards(partial, str(tmp_path))
    wanted = Counter()
    for r in partial.collect():
        wanted[r["key"]] += r["n"]
    ordered = np.array(sorted(wanted), np.int64)
    assert [wanted[k] for k in ordered.tolist()] == alignment.Counts(shards)(ordered).tolist()
    assert all(x.last < y.first for x, y in zip(shards, shards[1:], strict=False)) and sum(s.size for s in shards) == len(wanted)
    assert {i: int(best[i]) for i in range(9)} == {i: max(n for k, n in wanted.items() if k >> 32 == i) for i in range(9)}


def test_query_hides_no_groups(spark, tmp_path):
    spark.createDataFrame([(1, "one two", "x", 0.0, 1), (2, None, "x", 0.0, 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op13_cross_tokenizer_alignment"](spark, str(tmp_path)).collect()}
    assert got[1]["groups_sha256"] == hashlib.sha256(brute(["one two"])[0][-1].encode()).hexdigest() and got[2]["groups_sha256"] == ""


def test_links_are_kept_in_half_the_bytes_and_come_back(spark):
    keys = np.array([0, 1 << 32 | 65535, 65535 << 32 | 7, 65535 << 32 | 65535], np.int64)
    for narrow, width in ((True, 4), (False, 8)):
        codes = alignment.codes_of(keys, narrow)
        assert codes.itemsize == width and alignment.keys_of(codes).tolist() == keys.tolist() and (np.diff(codes.astype(np.int64)) > 0).all()
        packed, counts = pa.array([b"", codes[:3].tobytes(), b"", codes[3:].tobytes()]), pa.array([0, 3, 0, 1])
        for i in range(4):
            flat, ends = alignment._flat(counts.slice(i), packed.slice(i))
            assert alignment.keys_of(flat).tolist() == keys[0 if i < 2 else 3 :].tolist() and ends.tolist() == np.cumsum(counts.to_pylist()[i:]).tolist()
    docs = spark.createDataFrame([(1, "some text of words"), (2, None)], "id int, text string")
    assert [len(r["links"]) == 4 * r["n_links"] for r in alignment.links(docs, alignment.tokenizer_paths()).collect()] == [True, True]


def test_parts_are_read_together_and_only_new_ones_are_aligned():
    own = alignment.tokens.__wrapped__(*alignment.tokenizer_paths())
    made, make = [], own.parts.make
    own.parts.make, own.parts.most = lambda words: made.extend(words) or make(words), 20
    first = alignment.align(["the same words of a text", "a▁b", " lead and the trail ", ""], own)
    assert (first.n_a[1], first.n_links[1], first.groups[1], first.groups[3]) == (0, 0, "", "") and len(set(made)) == len(made)
    again = alignment.align(["the same words of a text"], own)
    assert [x[0] for x in again] == [x[0] for x in first] and len(set(made)) == len(made)
    # what one run alone had goes first
    alignment.align([" ".join(f"w{i}" for i in range(30))], own)
    alignment.align(["other"], own)
    assert {" the", " same", " text", " other"} <= set(own.parts) and not {" w1", " lead"} & set(own.parts)
    assert [x[0] for x in alignment.align(["the same words of a text"], own)] == [x[0] for x in first]

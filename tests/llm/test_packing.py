import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewire.llm import packing
from tidewire.llm.common import Scratch
from tidewire.llm.pieces import Known, runs

SCHEMA = "doc_id bigint, text string, row string, length double, block int"
TRICKY = [
    None, "", " ", "one", "ONE  two\n\nthree", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "Á ́x", "ΣΑΣ ΣΣ", "a\x1cb \x1f", "a b　c\x85d", "it's 'S you'RE 12 3a", "İI ı 🙂🙂 ﬁ",
    "x" * 70_000, "word " * 9000, "a\x00b",
]


def placed_well(rows, capacity):
    """The number of sequences, after a look at each: none too long, no gaps."""
    own = {}
    for r in rows:
        own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in own.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(own)


def test_packed_documents_hold_the_tokenizers_ids(spark):
    rng = random.Random(1)
    docs = [(i, t, "x", 1.0, 2) for i, t in enumerate(TRICKY)] + [(None, "some text", "x", 1.0, 2), (4, "same id", "x", 1.0, 2), (4, "same id", "x", 1.0, 2)]
    docs += [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma!", "Delta"]) for _ in range(rng.randint(1, 900))), "x", 1.0, 2) for i in range(150)]
    got = packing.pack_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    library = Tokenizer.from_file(packing.tokenizer_path())
    wanted = []
    for i, text, *_ in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(wanted, key=key)
    assert placed_well(got, 4096) <= -(-sum(x[3] for x in wanted) // 4096) + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def packed(spark, lengths, capacity, effort):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row bigint, length bigint")
    got = packing.pack(rows, capacity, effort, Scratch(spark, "test")).collect()
    assert sorted(r["row"] for r in got) == list(range(len(lengths)))
    return placed_well(got, capacity)


def test_blocks_and_levels_leave_one_loose_sequence(spark):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 200), 200]) for _ in range(700)]
    assert packed(spark, lengths, 200, packing.Effort(block=40)) <= -(-sum(lengths) // 200) + 1
    assert packed(spark, [1] * 300, 200, packing.Effort(block=40)) == 2
    assert packed(spark, [200] * 5, 200, packing.Effort()) == 5
    assert packed(spark, [101] * 90, 200, packing.Effort(block=20)) == 90  # a bound tells that no two fit


def triples(n, capacity, seed):
    """Lengths that fill ``n`` bins of three without a gap, where best fit alone fails."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(capacity // 4 + 1, capacity // 2 - 1)
        b = rng.randint(capacity // 4, capacity - a - capacity // 4)
        out += [a, b, capacity - a - b]
    return out


def best_of(sizes, capacity):
    """The fewest bins, by trying everything."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(fills)
            return
        for f in sorted({x for x in fills if x + sizes[i] <= capacity}):
            at = fills.index(f)
            put(i + 1, [*fills[:at], f + sizes[i], *fills[at + 1 :]])
        put(i + 1, [*fills, sizes[i]])

    put(0, [])
    return best[0]


def test_islands_beat_best_fit_and_bound_holds(spark):
    beaten = 0
    for seed in range(8):
        sizes = np.array(sorted(triples(8, 100, seed), reverse=True))
        plain = packing.best_fit(sizes, np.arange(len(sizes)), np.full(len(sizes), -1), [], 100).max() + 1
        best = packed(spark, sizes.tolist(), 100, packing.Effort(epochs=4, generations=40)) if seed < 2 else packing.evolve(sizes, [], 100, packing.Effort(generations=160), [seed])[0].max() + 1
        assert 8 == packing.least_bins(sizes, 100) <= best <= plain
        beaten += best < plain
    assert beaten >= 3
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(1, 100, 8)
        least = best_of(sizes.tolist(), 100)
        assert packing.least_bins(sizes, 100) <= least <= packing.evolve(sizes, [], 100, packing.Effort(), [0])[0].max() + 1 <= least + 1


@pytest.mark.parametrize("seed", range(3))
def test_offspring_are_whole_packings(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 80)
    a, b = (packing.best_fit(sizes, rng.permutation(80), np.full(80, -1), [], 100) for _ in range(2))
    for child in (packing.crossover(sizes, a, b, 100, rng), packing.mutate(sizes, a, 100, rng)):
        assert child.min() == 0 and np.bincount(child, sizes).max() <= 100 and np.bincount(child).min() > 0


def test_known_words_are_bounded():
    known = Known(lambda words: [w.upper() for w in words], most=3)
    for part in (["a", "b"], ["c", "d" * 70, "e"], ["f", "g"], ["a", "d" * 70]):
        known.learn(part)
        assert all(known[w] == w.upper() for w in part)
    assert len(known) <= 5 and list(itertools.chain(*runs(["aa", "b", "c" * 9, ""], 3))) == ["aa", "b", "c" * 9, ""] and len(list(runs(["aa", "b", "c" * 9, ""], 3))) == 3

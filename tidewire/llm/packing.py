"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm.

Documents are cut into pieces no longer than a sequence, and the pieces dealt into blocks of bounded size by a hash.
A block is one packing problem.  Several islands evolve it apart: a crossover puts whole well-filled sequences of one
parent into the other, drops those of the other that hold the same pieces, and best-fits what that displaced; after each
epoch every island gets its neighbour's elite by a join.  A block is settled when it reaches a lower bound that no
packing can beat.  The least-filled sequences of each block are not kept: their pieces are packed again with those of
other blocks, so the last sequence of the whole table is the only one that need be far from full.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column
from .pieces import Known, byte_alphabet, runs

WORD_TOKENIZER = "word_bpe_49k.json"
#: One in so many sequences of a block, the least filled ones, is packed again with those of other blocks.
LOOSE = 8
#: The tokenizer's own parts of texts in small letters, for characters below U+0180.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Characters beyond, those that count as white space here alone, and special tokens, which the tokenizer takes out first.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x7e\xa0-\u017f]|<\\|")
#: Characters that byte-level vocabularies do not spell by themselves.
_UNLIKE = re.compile(r"[^!-~\n]")
#: The characters that byte-level vocabularies spell bytes with.
_SPELLING = str.maketrans({b: c for c, b in byte_alphabet().items()})
#: Ends each document.
END_ID = 1


@dataclass(frozen=True)
class Effort:
    """How hard a block is worked on: sizes of blocks and populations, and how long islands evolve."""

    block: int = 2048
    islands: int = 3
    members: int = 6
    epochs: int = 3
    generations: int = 20


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spelled(words: list[str]) -> list[str]:
    """Words as byte-level vocabularies spell them: UTF-8 bytes by one character each; words hold no line breaks."""
    text = "\n".join(words)
    return words if not _UNLIKE.search(text) else text.encode().decode("latin-1").translate(_SPELLING).split(_SPELLING[10])


@dataclass
class Encoder:
    """The ids of texts, as the tokenizer gives them.

    The tokenizer's own rules part texts in small letters into runs of letters, single digits, and runs of other marks,
    and each part is encoded by itself.  Texts of characters below U+0180 are parted here and the parts remembered;
    others go to the tokenizer word by word.
    """

    parts: Known
    words: Known

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        end = END_ID.to_bytes(4, sys.byteorder)
        for run in runs(texts):
            split: list[tuple[Known, list[str]]] = []
            for t in run:
                if _ODD.search(t) or not unicodedata.is_normalized("NFC", t):
                    # cut at white space alone, which no word of the tokenizer holds
                    split.append((self.words, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
                else:
                    split.append((self.parts, _PARTS.findall(t.lower())))
            for known in (self.parts, self.words):
                known.learn(chain.from_iterable(own for k, own in split if k is known))
            for known, own in split:
                yield b"".join(map(known.__getitem__, own)) + end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    bare = Tokenizer(whole.model)  # the same merges, for what the rules before them leave as it is
    ids = lambda own, words: [array("I", e.ids).tobytes() for e in own.encode_batch_fast(words, add_special_tokens=False)]
    return Encoder(Known(lambda words: ids(bare, spelled(words)), 1_000_000), Known(lambda words: ids(whole, words), 100_000))


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's tokens, cut only where they are more than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, found = [], []
            for i, ids in enumerate(encode(batch.column(1).fill_null("").to_pylist())):
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    at.append(i)
                    found.append((k, start, len(part) // 4, zlib.crc32(part)))
            numbers = np.array(found, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers[:, 0].astype(np.int32)), *[pa.array(numbers[:, c].copy()) for c in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat: for each k, items over capacity - k stand alone, and those of k or more
    fill at least what the items over half a bin leave free."""
    count = np.bincount(sizes, minlength=capacity + 1)
    upto, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)
    half, alone = capacity // 2, upto[-1] - upto[capacity - k]
    large = upto[capacity - k] - upto[half]
    large_sum = total[capacity - k] - total[half]
    small_sum = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(small_sum - (large * capacity - large_sum)) // capacity))
    return int(max((alone + large + more).max(), -(-int(sizes.sum()) // capacity)))


def best_fit(sizes: np.ndarray, items: np.ndarray, into: np.ndarray, fills: list[int], capacity: int) -> np.ndarray:
    """Put ``items``, in that order, each into the bin with the least room that suffices, or a new one; ``into`` is changed."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for i, size in zip(items.tolist(), sizes[items].tolist(), strict=True):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        into[i] = b
        if left > size:
            insort(room, (left - size, b))
    return into


def fitness(sizes: np.ndarray, into: np.ndarray) -> tuple[int, float]:
    """(bins, minus the sum of squared fills): smaller is better, and of equal counts the less even one."""
    fills = np.bincount(into, sizes)
    return len(fills), -float((fills**2).sum())


def _regroup(sizes: np.ndarray, kept: np.ndarray, displaced: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of ``kept`` (-1: none) numbered anew, and ``displaced`` items best-fitted, large ones first."""
    into = np.full(len(sizes), -1)
    have = kept >= 0
    if have.any():
        into[have] = np.unique(kept[have], return_inverse=True)[1]
    fills = np.bincount(into[have], sizes[have]).astype(int).tolist() if have.any() else []
    return best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], into, fills, capacity)


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``b`` in ``a``: bins of ``a`` that hold the same items go, and their other items are best-fitted."""
    fills = np.bincount(b, sizes)
    order = np.argsort(-fills + rng.random(len(fills)))[: max(1, (len(fills) + 1) // 2)]
    injected = np.isin(b, rng.choice(order, max(1, int(len(order) * rng.uniform(0.2, 0.8))), replace=False))
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    kept = np.where(injected, b + a.max() + 1, np.where(hit[a], -1, a))
    return _regroup(sizes, kept, np.flatnonzero(kept < 0), capacity)


def mutate(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A few bins, the least filled ones and some others, are emptied and their items best-fitted."""
    fills = np.bincount(a, sizes)
    few = max(2, len(fills) // 50)
    gone = np.union1d(np.argsort(fills, kind="stable")[:few], rng.choice(len(fills), min(few, len(fills)), replace=False))
    kept = np.where(np.isin(a, gone), -1, a)
    return _regroup(sizes, kept, rng.permutation(np.flatnonzero(kept < 0)), capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, effort: Effort, seed: list[int]) -> list[np.ndarray]:
    """One epoch of an island, best member first; without a population it makes one by best fit in several orders.

    It ends early when the best member needs no more bins than any packing must.
    """
    rng, least = np.random.default_rng(seed), least_bins(sizes, capacity)
    population = [np.asarray(p, np.int64) for p in population]
    rated = sorted(((fitness(sizes, p), p) for p in population), key=lambda x: x[0])
    empty = np.full(len(sizes), -1)
    while len(rated) < effort.members and (not rated or rated[0][0][0] > least):
        blur = sizes * (1 + rng.normal(0, 0.1 if rated else 0, len(sizes)))
        made = best_fit(sizes, np.argsort(-blur, kind="stable"), empty.copy(), [], capacity)
        rated = sorted([*rated, (fitness(sizes, made), made)], key=lambda x: x[0])
    for _ in range(effort.generations):
        if rated[0][0][0] <= least:
            break
        for _ in range(effort.members // 2):
            one, two = (min(rng.integers(len(rated), size=2)) for _ in range(2))  # tournaments: members are in order
            child = crossover(sizes, rated[one][1], rated[two][1], capacity, rng)
            child = mutate(sizes, child, capacity, rng) if rng.random() < 0.5 else child
            rated.append((fitness(sizes, child), child))
        rated = sorted(rated, key=lambda x: x[0])[: effort.members]
    return [p for _, p in rated]


def _evolved(state: DataFrame, capacity: int, effort: Effort, level: int, epoch: int) -> DataFrame:
    """``state`` (block, island, sizes, population ..) after an epoch, with the bins of its best member."""

    @F.pandas_udf("population array<array<int>>, bins int")
    def run(block: pd.Series, island: pd.Series, sizes: pd.Series, population: pd.Series) -> pd.DataFrame:
        out = []
        for b, i, s, p in zip(block, island, sizes, population, strict=True):
            members = evolve(np.asarray(s, np.int64), list(p), capacity, effort, [level, epoch, b, i])
            out.append((members, int(members[0].max()) + 1))
        return pd.DataFrame(out, columns=["population", "bins"])

    done = state.withColumn("_e", run("block", "island", "sizes", "population"))
    return done.select("block", "island", "sizes", "least", F.col("_e.population").alias("population"), F.col("_e.bins").alias("bins"))


def _solved(blocks: DataFrame, number: int, capacity: int, effort: Effort, level: int, scratch: Scratch) -> DataFrame:
    """(block, best): the bin of each item of each block, by islands that evolve apart and pass on elites in a ring."""

    @F.pandas_udf("int")
    def bound(sizes: pd.Series) -> pd.Series:
        return pd.Series([least_bins(np.asarray(s, np.int64), capacity) for s in sizes], dtype="int32")

    start = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(effort.islands - 1))).alias("island"), "sizes", bound("sizes").alias("least"))
    state = start.withColumn("population", F.lit(None).cast("array<array<int>>")).withColumn("population", F.coalesce("population", F.array().cast("array<array<int>>")))
    solved, tasks = None, -(-number * effort.islands // 8)  # said here, as few bytes may be much work
    for epoch in range(effort.epochs):
        state = scratch.save(_evolved(state.repartition(tasks, "block", "island"), capacity, effort, level, epoch), f"islands-{level}-{epoch}")
        ranked = state.groupBy("block").agg(F.min_by(F.col("population")[0], F.struct("bins", "island")).alias("best"), (F.min("bins") <= F.first("least")).alias("settled"))
        last = epoch == effort.epochs - 1
        own = ranked if last else ranked.where("settled")
        solved = own if solved is None else solved.unionByName(own)
        if last:
            break
        open_ = scratch.save(ranked.where("not settled").select("block"), f"open-{level}-{epoch}")
        if not open_.limit(1).count():
            break
        # the elite of each island joins its neighbour's population
        rest = state.join(open_, "block", "left_semi")
        elite = rest.select("block", F.pmod(F.col("island") + 1, F.lit(effort.islands)).alias("island"), F.slice("population", 1, 1).alias("elite"))
        state = rest.join(elite, ["block", "island"]).withColumn("population", F.concat("elite", "population")).drop("elite", "bins")
    return solved.select("block", "best")


def _laid_out(solved: DataFrame, capacity: int, keep_all: bool) -> DataFrame:
    """``solved`` with each item's bin, its offset there, and whether its bin is one of the least filled ones, which are packed again."""

    @F.pandas_udf("bin array<int>, offset array<bigint>, again array<boolean>")
    def run(sizes: pd.Series, best: pd.Series) -> pd.DataFrame:
        out = []
        for s, b in zip(sizes, best, strict=True):
            s, b = np.asarray(s, np.int64), np.asarray(b, np.int64)
            order = np.argsort(b, kind="stable")
            ends = np.cumsum(s[order])
            first = np.searchsorted(b[order], b[order])
            offset = np.empty(len(s), np.int64)
            offset[order] = ends - s[order] - (ends - s[order])[first]
            fills = np.bincount(b, s)
            loose = np.argsort(fills, kind="stable")[: -(-len(fills) // LOOSE)]
            again = np.isin(b, loose[fills[loose] < capacity]) & (not keep_all)
            out.append((b.tolist(), offset.tolist(), again.tolist()))
        return pd.DataFrame(out, columns=["bin", "offset", "again"])

    return solved.withColumn("_p", run("sizes", "best"))


def pack(rows: DataFrame, capacity: int, effort: Effort, scratch: Scratch) -> DataFrame:
    """``rows`` (row: a different number below 2**63 each, length: 1 to ``capacity``) with sequence_id and offset.

    Sequences hold at most ``capacity`` and have no gaps.  Only lengths go to Python, a block at a time.
    """
    full = rows.where(F.col("length") >= capacity).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left, out, level, before = rows.where(F.col("length") < capacity), full, 0, None
    while True:
        n, tokens = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            return out
        # a block of very short pieces has more of them, so that it fills some sequences
        blocks = max(1, min(n // effort.block, tokens // (capacity * LOOSE)))
        alone = blocks == 1 or (before is not None and n > 0.9 * before)
        item = F.struct("length", "row", *[c for c in rows.columns if c not in ("length", "row")])
        dealt = left.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks))).groupBy("block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
        dealt = scratch.save(dealt.withColumn("sizes", F.transform("items.length", lambda x: x.cast("int"))), f"blocks-{level}")
        solved = _solved(dealt.select("block", "sizes"), blocks, capacity, effort, level, scratch)
        placed = _laid_out(dealt.join(solved, "block"), capacity, alone)
        zipped = F.arrays_zip("items", F.col("_p.bin").alias("bin"), F.col("_p.offset").alias("offset"), F.col("_p.again").alias("again"))
        placed = placed.select("block", F.explode(zipped).alias("z")).select("block", "z.items.*", "z.bin", F.col("z.offset").alias("offset"), "z.again")
        placed = scratch.save(placed, f"placed-{level}")
        # a number for each level, block and bin, below those of the full pieces
        number = -(F.shiftleft(F.shiftleft(F.lit(level).cast("bigint"), 36) + F.col("block"), 20) + F.col("bin")) - 1
        out = out.unionByName(placed.where("not again").select(*rows.columns, number.alias("sequence_id"), "offset"))
        left, before, level = placed.where("again").select(*rows.columns), n, level + 1


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str | None = None, effort: Effort = Effort()
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): every document's tokens, placed in sequences.

    A document is its tokens, without special ones added, and an end.  It is cut only where it is longer than
    ``capacity``: its pieces then have ``capacity`` tokens each, the last one what is left.  A piece stands at ``offset``
    of its sequence; offsets have no gaps, and no sequence has more than ``capacity`` tokens.

    A null or empty text is the end alone.  Repeated rows, and rows without an id, are documents of their own.  An
    empty table gives none.  Other columns are ignored.  One text's words must fit a task's memory.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, id_col, text_col, capacity, path or tokenizer_path())
    rows = scratch.save(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(rows, capacity, effort, scratch).drop("row").withColumnRenamed("id", id_col)

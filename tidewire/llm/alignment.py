"""Alignment of two tokenizers over a corpus: groups of tokens that end together, and counts of linked token pairs.

A link is a pair of token occurrences whose byte ranges overlap; its key packs both ids into one 64-bit number.  Between
tasks a text's links are bytes, of 32-bit numbers where both vocabularies have at most 65536 ids.  Each
partition counts the documents of its keys by ``np.unique``; the partial counts are range-partitioned and sorted by
key, and runs of equal keys summed, which gives globally sorted shards of (key, count).  The shards are written to the
shared folder as plain arrays, and the tasks that describe documents map them into memory and look keys up by
``searchsorted``; nothing of them passes through the driver but one row for each shard.

Texts are cut where both tokenizers always end a token, before a space between two other characters.  A group ends there
too and no link reaches over it, so the groups and links of each such part are found once for many texts: from the tokens'
ends, in numpy, for many parts at a time.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import pieces
from .common import Scratch, column, shared_dir
from .pieces import SPACE, Proven, byte_alphabet, runs

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct keys that a task holds before it hands on its partial counts.
KEYS = 1 << 20
#: Parts of a text, each with the space before it.  White space here is more than either tokenizer takes for it.
_PARTS = re.compile(r"(?<=\S)(?= \S)")
_SHIFT = 32
#: Parts that are read at a time.
_TOGETHER = 100
#: Ids that half of a 32-bit number can tell apart.
_NARROW = 1 << 16


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)


#: Of a part of a text: the codes of its links as bytes, its groups in writing, and how many tokens of A and B and groups it has.
Part = tuple[bytes, str, int, int, int]


class Tokens(NamedTuple):
    """What both tokenizers say: parts of texts by their writing, and the room that a link's code takes."""

    parts: Proven
    width: int


@lru_cache(maxsize=2)
def tokens(byte_path: str, piece_path: str) -> Tokens:
    """Parts of texts, each of which begins with a space; none for a part that the tokens don't spell."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(byte_path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    alphabet = byte_alphabet()
    names = [two.id_to_piece(i) for i in range(two.get_piece_size())]
    a_bytes = [bytes(alphabet.get(c, 63) for c in one.id_to_token(i) or "") for i in range(one.get_vocab_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
        raise ValueError("pieces that go on behind a space: texts can't be cut before spaces")

    a_sizes, b_sizes = (np.array([len(x) for x in own]) for own in (a_bytes, b_bytes))

    narrow = max(len(a_sizes), len(b_sizes)) <= _NARROW
    written = [f"{i}{end}" for size, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for end in ends for i in range(size)]
    lengths = np.array([len(x) for x in written])

    def spelled(ids: np.ndarray, counts: np.ndarray, own: list[bytes], sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the bytes of each part's ids are those of ``raw``, one by one only where they differ as a whole."""
        said, ends = [own[i] for i in ids.tolist()], np.cumsum(counts)
        spans = np.concatenate([[0], np.cumsum(sizes[ids])])[ends]
        if b"".join(said) == b"".join(raw) and (spans == np.cumsum([len(r) for r in raw])).all():
            return np.ones(len(raw), bool)
        cuts = np.concatenate([[0], ends]).tolist()
        return np.array([b"".join(said[i:j]) == r for i, j, r in zip(cuts, cuts[1:], raw, strict=False)])

    def laid(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts

    def read(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in one.encode_batch_fast(texts, add_special_tokens=False)]

    def together(parts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of parts between which a text would be cut, many of them read at once; one by one should that not fit."""
        ids, _ = laid(read(["".join(parts[i : i + _TOGETHER]) for i in range(0, len(parts), _TOGETHER)]))
        ends, wanted = np.cumsum(a_sizes[ids]), np.cumsum([len(r) for r in raw])
        at = np.searchsorted(ends, wanted)
        if len(parts) and at[-1] == len(ids) - 1 and (ends[at] == wanted).all():
            return ids, np.diff(np.concatenate([[-1], at]))
        return laid(read(parts))

    def make(parts: list[str]) -> dict[str, Part | None]:
        plain = [len(p) > 1 and not p[1].isspace() and not p[-1].isspace() for p in parts]
        n, parts = sum(plain), [*compress(parts, plain), *[p for p, x in zip(parts, plain, strict=True) if not x]]
        raw = [p.encode() for p in parts]
        a, n_a = (np.concatenate(x) for x in zip(together(parts[:n], raw[:n]), laid(read(parts[n:])), strict=True))
        b, n_b = laid(two.encode([p[1:] for p in parts], num_threads=1))  # it puts the space before them
        good = spelled(a, n_a, a_bytes, a_sizes, raw) & spelled(b, n_b, b_bytes, b_sizes, raw)
        found = _aligned(a[np.repeat(good, n_a)], n_a[good], b[np.repeat(good, n_b)], n_b[good], a_sizes, b_sizes, written, lengths, narrow)
        return dict.fromkeys(parts) | dict(zip(compress(parts, good.tolist()), found, strict=True))

    return Tokens(Proven(make, 120_000), 4 if narrow else 8)


def _aligned(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, written: list[str], lengths: np.ndarray, narrow: bool) -> Iterator[Part]:
    """Groups and links of parts, all at once: their bytes are laid end to end, and so are both tokenizers' tokens."""
    end_a, end_b = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    # between two neighbouring ends, of whichever tokens, lies one overlap of one pair
    ends = np.concatenate([end_a, end_b])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    links = codes_of(a[at_a] << _SHIFT | b[at_b], narrow)
    shared = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)]
    part_end = np.concatenate([[0], end_a])[np.cumsum(n_a)]
    cuts = lambda of: np.concatenate([[0], np.searchsorted(of, part_end, "right")])
    # in writing: A's ids of a group, then B's
    group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
    last_a, last_b = (np.concatenate([g[1:] != g[:-1], np.ones(min(1, len(g)), bool)]) for g in (group_a, group_b))
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + np.where(last_a, len(a_sizes), 0)
    order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * len(a_sizes) + np.where(last_b, len(b_sizes), 0)
    data, text = links.tobytes(), "".join([written[i] for i in order.tolist()])
    at_link, at_char = (cuts(ends) * links.itemsize).tolist(), np.concatenate([[0], np.cumsum(lengths[order])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    counts = n_a.tolist(), n_b.tolist(), np.diff(cuts(shared)).tolist()
    for i, j, k, m, x, y, n in zip(at_link, at_link[1:], at_char, at_char[1:], *counts, strict=False):
        yield data[i:j], text[k : m - 1], x, y, n


class Aligned(NamedTuple):
    """Of texts: the codes of all links in order as bytes, the groups in writing, and the numbers of tokens, groups and links."""

    links: list[bytes]
    groups: list[str]
    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    n_links: list[int]


def align(texts: list[str], own: Tokens) -> Aligned:
    """Groups and links of ``texts``: both tokenizers end a token where a text is cut, so those of its parts follow each other."""
    split = [_PARTS.split(" " + t) if t else [] for t in texts]
    own.parts.learn(chain.from_iterable(split))
    out = Aligned([], [], [], [], [], [])
    for parts in split:
        found = [*map(own.parts.__getitem__, parts)]
        links, groups, *counts = zip(*found, strict=True) if found and None not in found else ((), (), (), (), ())
        data = b"".join(links)
        for column_, value in zip(out, (data, ";".join(groups), *map(sum, counts), len(data) // own.width), strict=True):
            column_.append(value)
    return out


def codes_of(keys: np.ndarray, narrow: bool) -> np.ndarray:
    """Keys as they are kept: 32-bit numbers in the same order if both ids are ``narrow``, else unchanged."""
    return (keys >> _SHIFT << 16 | keys & 0xFFFF).astype(np.uint32) if narrow else keys


def keys_of(codes: np.ndarray) -> np.ndarray:
    """What ``codes_of`` was made of."""
    wide = codes.astype(np.int64)
    return wide >> 16 << _SHIFT | wide & 0xFFFF if codes.dtype == np.uint32 else wide


def _flat(counts: pa.Array, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of an array of bytes, ``counts`` of them in each, and where each one's end."""
    ends = np.cumsum(counts.to_numpy())
    packed = packed.cast(pa.large_binary())
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, np.uint32), ends
    _, offsets, data = packed.buffers()
    first, last = np.frombuffer(offsets, np.int64)[[packed.offset, packed.offset + len(packed)]].tolist()
    return np.frombuffer(data, np.uint8)[first:last].view(np.uint32 if last - first == 4 * total else np.int64), ends


def links(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, links) of ``docs`` (id, text): the codes of all links of a text in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(*paths)
        for batch in batches:
            at = 0
            slices = (batch.column(1).slice(i, 200).fill_null("").to_pylist() for i in range(0, batch.num_rows, 200))
            for texts in chain.from_iterable(runs(x, 1 << 18) for x in slices):
                x = align(texts, own)
                columns = [batch.column(0).slice(at, len(texts)), *[pa.array(n, pa.int64()) for n in (x.n_a, x.n_b, x.n_groups, x.n_links)], pa.array(x.groups, pa.string()), pa.array(x.links, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
                at += len(texts)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary")


def partial_counts(rows: DataFrame, most: int = KEYS) -> DataFrame:
    """(key, n): of each partition of ``rows`` (n_links, links), in how many rows each key is."""

    def batch(found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []
        for b in batches:
            flat, ends = _flat(b.column(0), b.column(1))
            for own in np.split(flat, ends[:-1]):
                new.append(np.unique(own))
                if len(new) >= 500:
                    found, n = _summed(found, n, new)
                    new = []
                    if len(found) > most:
                        yield from batch(found, n)
                        found, n = found[:0], n[:0]
        yield from batch(*_summed(found, n, new))

    return rows.mapInArrow(run, "key bigint, n bigint")


def _summed(keys: np.ndarray, n: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key with one more for each code of each array of ``new``."""
    own, count = np.unique(np.concatenate(new or [keys[:0]]), return_counts=True)
    return run_sums(np.concatenate([keys, keys_of(own)]), np.concatenate([n, count]))


def run_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, rising, each once, with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def local_folder(spark) -> str:
    """The shared folder as a path that every executor can open; arrays can be mapped into memory only there."""
    found = urlparse(shared_dir(spark))
    if found.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir is {found.scheme}://, where files can't be mapped into memory: give a mounted shared folder as shards_dir")
    return unquote(found.path)


class Shard(NamedTuple):
    """A file of sorted keys and, behind them, their counts."""

    first: int
    last: int
    size: int
    path: str


def write_shards(partial: DataFrame, folder: str) -> tuple[list[Shard], np.ndarray]:
    """Sum ``partial`` (key, n) into shards of sorted keys below ``folder``; also the highest count by first id.

    The counts are range-partitioned and sorted by key, so that shards follow each other and none shares a key.  A
    file gets its name when it is whole, so a task that runs twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}.counts"
        own = f"{path}.{task.taskAttemptId()}"
        size, first, last, best = 0, None, None, {}
        carry = np.zeros(0, np.int64), np.zeros(0, np.int64)
        with open(own, "wb") as keys_file, open(f"{own}-n", "wb") as n_file:

            def put(keys: np.ndarray, n: np.ndarray) -> None:
                nonlocal size, first, last
                if len(keys):
                    keys.tofile(keys_file)
                    n.tofile(n_file)
                    size, first, last = size + len(keys), int(keys[0]) if first is None else first, int(keys[-1])
                    ids = keys >> _SHIFT
                    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                    for i, most in zip(ids[at].tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                        best[i] = max(best.get(i, 0), most)

            for b in batches:
                keys, n = run_sums(*(np.concatenate([c, b.column(i).to_numpy()]) for i, c in enumerate(carry)))
                put(keys[:-1], n[:-1])  # the last run may go on
                carry = keys[-1:], n[-1:]
            put(*carry)
        with open(f"{own}-n", "rb") as n_file, open(own, "ab") as keys_file:
            while block := n_file.read(1 << 24):
                keys_file.write(block)
        os.remove(f"{own}-n")
        os.replace(own, path)
        if size:
            listed = [pa.array([list(x)], pa.list_(pa.int64())) for x in (best.keys(), best.values())]
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([size]), pa.array([path]), *listed], ["first", "last", "size", "path", "ids", "best"])

    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    rows = ordered.mapInArrow(run, "first bigint, last bigint, size bigint, path string, ids array<bigint>, best array<bigint>").collect()
    # as many numbers as there are first ids, besides one row a shard
    best = np.zeros(1 + max((i for r in rows for i in r["ids"]), default=0), np.int64)
    for r in rows:
        np.maximum.at(best, np.array(r["ids"], np.int64), np.array(r["best"], np.int64))
    return sorted(Shard(r["first"], r["last"], r["size"], r["path"]) for r in rows), best


class Counts:
    """Counts by key, looked up in shards that are mapped into memory when first met."""

    def __init__(self, shards: list[Shard]):
        self.shards, self.lasts = shards, np.array([s.last for s in shards], np.int64)
        self.maps: dict[int, np.ndarray] = {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted ``keys``, all of which have one."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(keys, self.lasts, "right")
        begin = 0
        for s, end in enumerate(cuts.tolist()):
            if begin < end:
                if s not in self.maps:
                    self.maps[s] = np.memmap(self.shards[s].path, np.int64, "r", shape=(2, self.shards[s].size))
                own, n = self.maps[s]
                at = np.searchsorted(own, keys[begin:end])
                out[begin:end] = n[at]
            begin = max(begin, end)
        return out


def align_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, shards_dir: str | None = None
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row: both tokenizers' tokens, aligned.

    Tokenizer A, byte-level, reads a space and the text; B, a piece model, puts that space there itself.  ``groups``
    lists, between offsets where tokens of both end, A's and B's ids, as ``a1,a2|b1;a3|b2,b3``.  A link is a pair of
    token occurrences whose bytes overlap; the count of its two ids is the number of rows of ``docs`` that hold them
    linked.  ``n_best`` is how many links have the highest count of their A id, ties included, ``count_sum`` the sum of
    the links' counts.

    A text that is null or empty, or whose tokens do not spell it (a literal U+2581 reads as a space), has no
    tokens: zeros, and no groups.  Repeated rows count one by one; ids may be null and of any type.  An empty table gives
    none.  Other columns are ignored.  The counts lie below ``shards_dir``, by default the shared folder, which has to
    be one that executors can open; they hold 16 bytes for each pair of ids that occurs, whatever the corpus holds.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    folder = f"{shards_dir or local_folder(spark)}/{os.path.basename(scratch.root)}-shards"
    os.makedirs(folder)
    own = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    found = scratch.save(links(own, paths or tokenizer_paths()), "links")
    shards, best = write_shards(scratch.save(partial_counts(found.select("n_links", "links")), "partial"), folder)
    scratch.drop("partial")
    counts = Counts(shards)

    @F.arrow_udf("n_best bigint, count_sum bigint")
    def judged(n_links: pa.Array, packed: pa.Array) -> pa.Array:
        most, total = (np.zeros(len(packed), np.int64) for _ in range(2))
        offsets = np.concatenate([[0], np.cumsum(n_links.to_numpy())])
        for i, j in pieces(offsets, 1 << 18):  # a batch may hold millions of links
            flat, ends = _flat(n_links.slice(i, j - i), packed.slice(i, j - i))
            codes, back = np.unique(flat, return_inverse=True)
            keys = keys_of(codes)
            count = counts(keys)
            best_of = (count == best[keys >> _SHIFT]).astype(np.int64) if len(keys) else keys
            for out, x in ((most, best_of), (total, count)):
                out[i:j] = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x[back])])[ends]]))
        return pa.StructArray.from_arrays([pa.array(most), pa.array(total)], ["n_best", "count_sum"])

    out = found.withColumn("_j", judged("n_links", "links"))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "_j.n_best", "_j.count_sum", "groups")
